"""Token counts of documents in flat token files that have no index.

A flat file is a run of little-endian numbers of 16 bits (32 for large vocabularies), each an id plus
one; END, zero, ends every document. Files are cut into blocks, and every block is searched for END at once. Small files are read whole; of larger ones Spark
deals out byte ranges, read as records of one length, so a file of any size is many tasks. The length
is the largest up to a block that divides all their sizes: those written here are padded to whole
blocks, others may have short records (slower). A block knows nothing of its neighbours: it
reports the place of its last END, its number of ENDs and the lengths between them. A prefix scan over
the blocks' reports then gives each block the tokens that its first document has in earlier blocks.

Defined results: ids after a file's last END are an unfinished document; an empty file has none; a
null or empty text is a document of no tokens; rows that repeat are counted each; a null doc_id is
kept; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ledgerspark.llm.bpe import Encoder, broadcast_model, small_batches, vocabulary_size
from ledgerspark.llm.shared import materialize, shared_dir

#: The end-of-document number. Its bytes are a valid text.
END = 0
BLOCK_TOKENS = 1 << 16
#: Larger files are read in ranges; where written here, pads (all bits set) and an END fill their last block.
WHOLE_BYTES = 1 << 25


def width_of(vocabulary: int) -> int:
    """Bytes of a number in the flat files of a vocabulary of that size: ids plus one, END and the pad fit."""
    return 2 if vocabulary < (1 << 16) - 1 else 4


def pad_of(width: int) -> int:
    return (1 << 8 * width) - 1


def write_token_files(docs: DataFrame, path: str, folder: str | None = None) -> str:
    """Encode every document and write flat files, one a task, with END behind each document.

    The same pass writes, under the folder's kind=rows, each document's place in the task's file and
    its doc_id; the flat files are in the returned kind=ids. Both bear the task's number, so they
    belong together however docs was planned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = broadcast_model(spark, path)
    width = width_of(vocabulary_size(path))
    code, end_text = {2: "H", 4: "I"}[width], "\0" * width

    def run(batches):
        encoder, place, size = Encoder(model.value, lambda ids: array(code, [i + 1 for i in ids]).tobytes(), f"stored {code}"), 0, 0
        for b in batches:
            ids = [b"".join(parts) for parts in encoder.batch(b.column(0).to_pylist())]
            rows = [f"{place + i} {row}".encode() for i, row in enumerate(b.column(1).to_pylist())]
            place, size = place + len(ids), size + sum(map(len, ids)) // width + len(ids)
            yield pa.record_batch([pa.array(ids + rows, pa.binary()), pa.array(["ids"] * len(ids) + ["rows"] * len(rows))], names=["value", "kind"])
        if width * size > WHOLE_BYTES:
            fill = array(code, [pad_of(width)] * (BLOCK_TOKENS - (size + 1) % BLOCK_TOKENS)).tobytes()
            yield pa.record_batch([pa.array([fill], pa.binary()), pa.array(["ids"])], names=["value", "kind"])

    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    named = docs.select("text", F.to_json(F.struct(F.col("doc_id").alias("id"))).alias("row"))
    out = named.mapInArrow(run, "value binary, kind string").withColumn("value", F.col("value").cast("string"))
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "8")  # both files open at once: rows are not sorted by kind, which could change their order
    try:
        out.write.partitionBy("kind").option("lineSep", end_text).option("maxRecordsPerFile", 0).text(folder)
    finally:
        spark.conf.set(key, before)
    for kind in ("ids", "rows"):  # a table without rows writes neither
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/kind={kind}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return f"{folder}/kind=ids"


def rows_of(spark: SparkSession, folder: str, doc_id: T.DataType, width: int) -> DataFrame:
    """(part, ordinal, doc_id) of the documents written with the flat files in this folder."""
    rows = spark.read.schema("value string").option("lineSep", "\0" * width).text(folder.removesuffix("kind=ids") + "kind=rows")
    cut = F.split("value", " ", 2)
    row = F.from_json(cut[1], T.StructType([T.StructField("id", doc_id)]))
    return rows.select(_part(F.col("_metadata.file_name")).alias("part"), cut[0].cast("long").alias("ordinal"), row["id"].alias("doc_id"))


def _part(name: Column) -> Column:
    return F.regexp_extract(name, r"part-(\d+)[^/]*$", 1).cast("long")


def block_report(ids: np.ndarray, first: int, end: int) -> tuple[int, int, list[int]]:
    """(number of ends, absolute place of the last or -1, lengths): the first length is up to the first end."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return 0, -1, []
    return len(at), first + int(at[-1]), np.diff(at, prepend=-1).astype(np.int64).__sub__(1).tolist()


def _record_tokens(sizes: list[int], block: int, width: int) -> int:
    """The most tokens, a block at most, of which all these sizes in bytes are a multiple."""
    tokens, rest = divmod(math.gcd(*sizes), width)
    if rest:
        raise ValueError("a flat file is not a whole number of ids")
    return next(n for n in range(min(block, tokens), 0, -1) if tokens % n == 0)


def _joined(records: Iterable[tuple[int, bytes]], size: int) -> Iterator[tuple[int, bytes]]:
    """Neighbouring records (byte offset, bytes) put together up to this size."""
    parts, first, held = [], 0, 0
    for at, value in records:
        if parts and (held + len(value) > size or at != first + held):
            yield first, b"".join(parts)
            parts, held = [], 0
        first = first if parts else at
        parts.append(bytes(value))
        held += len(value)
    if parts:
        yield first, b"".join(parts)


def count_tokens(spark: SparkSession, folder: str, end: int = END, block: int = BLOCK_TOKENS, pad: int | None = None, whole: int = WHOLE_BYTES, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, finished) of every document in the folder's files of numbers of `width` bytes.

    Numbers `pad` and an end behind one are no document. Files of more than `whole` bytes are read in ranges.
    """

    stored = f"<u{width}"

    def report(ids: np.ndarray, first: int) -> tuple[int, int, int, int, list[int]]:
        if pad is not None:
            drop = ids == pad
            drop[1:] |= (ids[1:] == end) & drop[:-1]
            ids = ids[~drop]
        return first, len(ids), *block_report(ids, first, end)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), stored)
                k, n, ends, last, lengths = zip(*[report(ids[a : a + block], a) for a in range(0, len(ids), block)], strict=True)
                yield pa.record_batch([pa.array([name] * len(k)), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(ends, pa.int64()), pa.array(last, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["file", "block", "n", "ends", "last", "lengths"])

    small_batches(spark, 1000)
    fields = "block long, n long, ends long, last long, lengths array<long>"
    files = spark.read.format("binaryFile").load(folder)
    reports = files.where((F.col("length") > 0) & (F.col("length") <= whole)).select("path", "content").mapInArrow(run, f"file string, {fields}")
    large = files.where((F.col("length") > 0) & (F.col("length") > whole)).select("path", "length").collect()  # a name and a size a file
    if large:
        size = width * _record_tokens([r["length"] for r in large], block, width)
        paths = ",".join(re.sub(r"([\\\[\]{}?*,])", r"\\\1", r["path"]) for r in large)
        hadoop = [f"org.apache.hadoop.{x}" for x in ("mapreduce.lib.input.FixedLengthInputFormat", "io.LongWritable", "io.BytesWritable")]
        records = spark.sparkContext.newAPIHadoopFile(paths, *hadoop, conf={"fixedlengthinputformat.record.length": str(size)}, batchSize=max(1, min(1000, (1 << 18) // size)))
        found = records.mapPartitions(lambda it: (report(np.frombuffer(v, stored), at // width) for at, v in _joined(it, width * block)))
        ranges = spark.createDataFrame(found, fields, verifySchema=False)
        reports = reports.unionByName(ranges.select(F.input_file_name().alias("file"), *ranges.columns))
    lengths = materialize(reports)
    reports = lengths.drop("lengths")  # the scan passes a file's blocks through one task, but not its documents
    before = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    reports = reports.withColumn("done", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("since", F.coalesce(F.max("last").over(before), F.lit(-1))).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    reports = reports.join(lengths.select("file", "block", "lengths"), ["file", "block"])
    carried = F.col("start") - F.col("since") - 1  # of the first document, in earlier blocks
    ended = reports.select("file", "done", carried.alias("carried"), F.posexplode("lengths").alias("at", "n"))
    ended = ended.select("file", (F.col("done") + F.col("at")).alias("ordinal"), (F.col("n") + F.when(F.col("at") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("finished"))
    totals = reports.groupBy("file").agg(F.sum("ends").alias("ordinal"), (F.sum("n") - F.max("last") - 1).alias("n_tokens")).where("n_tokens > 0")
    return ended.unionByName(totals.withColumn("finished", F.lit(False)))


def count_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every row of docs: written to flat files, counted from them.

    A row is known by its task's file and its place there, both stored by the pass that wrote the
    file. A document without a count, or a count without its document, is an error.
    """
    folder = write_token_files(docs, path)
    width = width_of(vocabulary_size(path))
    counts = count_tokens(docs.sparkSession, folder, pad=pad_of(width), width=width).select(_part(F.col("file")).alias("part"), "ordinal", "n_tokens", "finished")
    rows = rows_of(docs.sparkSession, folder, docs.schema["doc_id"].dataType, width).withColumn("known", F.lit(True))
    whole = F.coalesce(F.col("known") & F.col("finished"), F.lit(False))
    n_tokens = F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document and its token count do not match")).cast("long"))
    return rows.join(counts, ["part", "ordinal"], "full").select("doc_id", n_tokens.alias("n_tokens"), "part", "ordinal")
