"""Full-text search over a stored index that follows its documents.

An index is a list of segments. A segment holds documents that were new or changed when it was written
and the keys of documents that were gone: their postings sorted by term, and a table of keys that hides
these keys in all earlier segments. An update writes a segment of what differs and nothing else; a merge
folds the segments into one. A segment counts once its row is in the list, which is written last, so
an update that breaks off leaves the index as it was. A query opens the files that hold its terms; a
frequent term goes over as many files as it fills.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.expressions import counted, words_of
from ledgerspark.operators.search import K1, B
from ledgerspark.plans.sorted_copy import read_prefixes, read_values, write_sorted
from ledgerspark.plans.stored import shared_folder, stored

_KNOWN: dict[tuple, tuple[str, int]] = {}


def segments(spark: SparkSession, folder: str) -> list[str]:
    """The segments that count, the latest last; a merged one takes the place of all before it."""
    rows = spark.read.schema("number int, name string, merged boolean").parquet(f"{folder}/segments").orderBy("number").collect()
    first = max((i for i, r in enumerate(rows) if r["merged"]), default=0)
    return [r["name"] for r in rows[first:]]


def _keys(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}/keys")


def live_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key, fingerprint, size) of the documents that the index holds."""
    parts = [_keys(spark, folder, name).withColumn("_at", F.lit(i)) for i, name in enumerate(segments(spark, folder))]
    if len(parts) == 1:
        return parts[0].where("NOT gone").drop("_at", "gone")
    last = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max(F.struct("_at", "fingerprint", "size", "gone")).alias("_x"))
    return last.where("NOT _x.gone").select("key", "_x.fingerprint", "_x.size")


def _fingerprinted(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    return docs.select(F.col(key).alias("key"), text.alias("text"), F.xxhash64(*columns).alias("fingerprint"))


def _write_segment(spark: SparkSession, folder: str, docs: DataFrame, gone: DataFrame | None, merged: bool = False) -> None:
    """docs: (key, text, fingerprint). The list's row comes last."""
    name = f"segment-{uuid.uuid4().hex}"
    words = docs.select("key", "fingerprint", words_of(F.col("text")).alias("w"))
    rows = stored(words.select("key", "fingerprint", F.size("w").alias("size"), counted(F.col("w")).alias("w")), "words")  # the sort samples its input: texts are cut once
    keys = rows.select("key", "fingerprint", "size", F.lit(False).alias("gone"))
    if gone is not None:
        keys = keys.unionByName(gone.select("key", F.lit(None).cast("long").alias("fingerprint"), F.lit(0).alias("size"), F.lit(True).alias("gone")))
    keys.write.parquet(f"{folder}/{name}/keys")
    each = rows.select("key", "size", F.inline("w"))  # counted in the row: one shuffle, that of the sort
    write_sorted(each.select("term", "key", "frequency", "size"), ["term", "key"], f"{folder}/{name}/postings")
    _listed(spark, folder, name, merged)


def _listed(spark: SparkSession, folder: str, name: str, merged: bool) -> None:
    """Adds a segment to the list; from now on it counts."""
    number = 1 + spark.read.parquet(f"{folder}/segments").agg(F.max("number")).first()[0] if _exists(spark, f"{folder}/segments") else 0
    spark.createDataFrame([(number, name, merged)], "number int, name string, merged boolean").coalesce(1).write.mode("append").parquet(f"{folder}/segments")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build_index(docs: DataFrame, key: str, columns: list[str], folder: str) -> None:
    """The first segment: all documents."""
    _write_segment(docs.sparkSession, folder, _fingerprinted(docs, key, columns), None)


def update_index(docs: DataFrame, key: str, columns: list[str], folder: str) -> bool:
    """A segment of the documents that differ from the index, and of the keys that are gone; False if nothing differs."""
    spark = docs.sparkSession
    now, known = _fingerprinted(docs, key, columns), live_keys(spark, folder)
    same = now.select("key", "fingerprint").join(known, ["key", "fingerprint"], "left_semi")
    changed = now.join(same, ["key", "fingerprint"], "left_anti")
    gone = known.select("key").join(now.select("key"), "key", "left_anti")
    if changed.isEmpty() and gone.isEmpty():
        return False
    _write_segment(spark, folder, changed, gone)
    return True


def merge_segments(spark: SparkSession, folder: str) -> None:
    """All segments as one: what is hidden goes. Readers that began before keep their files."""
    name = f"segment-{uuid.uuid4().hex}"
    live_keys(spark, folder).withColumn("gone", F.lit(False)).write.parquet(f"{folder}/{name}/keys")
    everything = _visible(spark, folder, lambda part: spark.read.parquet(f"{part}/data"))
    write_sorted(everything, ["term", "key"], f"{folder}/{name}/postings")
    _listed(spark, folder, name, True)


def _visible(spark: SparkSession, folder: str, read) -> DataFrame:
    """What `read` finds in the postings of every segment, without what later segments hide."""
    names, out, hidden = segments(spark, folder), None, None
    for name in reversed(names):
        part = read(f"{folder}/{name}/postings")
        part = part if hidden is None else part.join(hidden, "key", "left_anti")
        out = part if out is None else out.unionByName(part)
        keys = _keys(spark, folder, name).select("key")
        hidden = keys if hidden is None else hidden.unionByName(keys)
    return out


def files_fingerprint(docs: DataFrame) -> int:
    """A number of the files that a table is read from, with their sizes and times."""
    m = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return m.agg(F.sum(F.xxhash64("*") % (1 << 40))).first()[0] or 0


def stored_index(docs: DataFrame, name: str, key: str, columns: list[str]) -> str:
    """The folder of this application's index of a table: built once, updated where the table's files changed."""
    known, print_ = (docs.sparkSession.sparkContext.applicationId, name), files_fingerprint(docs)
    folder, last = _KNOWN.get(known, (None, None))
    if folder is None:
        folder = shared_folder(docs.sparkSession, "text-index")
        build_index(docs, key, columns, folder)
    elif last != print_:
        update_index(docs, key, columns, folder)
    _KNOWN[known] = (folder, print_)
    return folder


def hits(spark: SparkSession, folder: str, terms: list[str], prefix: bool = False) -> DataFrame:
    """Postings of the terms, or of all terms that begin with one of them."""
    terms = sorted({t.lower() for t in terms})
    return _visible(spark, folder, lambda part: (read_prefixes if prefix else read_values)(spark, part, "term", terms))


def ranked(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """(key, score) of every document with a term; smaller is better."""
    found = hits(spark, folder, terms)
    totals = live_keys(spark, folder).agg(F.count("*").alias("n"), F.avg("size").alias("mean"))  # one row
    counts = found.groupBy("term").agg(F.count("*").alias("df"))  # a row a term
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("frequency") * (K1 + 1) / (F.col("frequency") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return found.join(F.broadcast(counts), "term").join(F.broadcast(totals)).groupBy("key").agg((-F.sum(part)).alias("score"))


def highlighted(text, terms: list[str], before: int = 80, size: int = 200):
    """The text around the earliest hit, escaped, with hits marked; the beginning if nothing hits."""
    lower = F.lower(text)
    places = [F.nullif(F.locate(t.lower(), lower), F.lit(0)) for t in terms]
    at = F.least(*places) if len(places) > 1 else places[0]
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - before)
    cut = F.substring(text, start, F.lit(size))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        cut = F.replace(cut, F.lit(sign), F.lit(name))
    from ledgerspark.functions.text import literal_pattern

    marked = F.regexp_replace(cut, "(?i)(" + "|".join(map(literal_pattern, terms)) + ")", "<mark>$1</mark>")
    return F.concat(F.when(start > 1, F.lit("...")).otherwise(""), marked, F.when(F.length(text) > start + size - 1, F.lit("...")).otherwise(""))
