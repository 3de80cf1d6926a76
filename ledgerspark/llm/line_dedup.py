"""Line deduplication with DataFrame functions only.

Lines are exploded with their normalised key's hash, documents are counted per hash, and the lines
whose key occurs in too many documents go, except in the largest doc_id that holds the key. Texts
are shuffled once, at the end; counting moves 128-bit hashes only and is combined before the shuffle.
A line that holds more than one in HOT_LINES of the frequent lines' rows is matched by a broadcast:
there are fewer than HOT_LINES such lines, whatever the table. The others are matched by a shuffle,
where none of them is large.

Defined results: a null or empty text is one empty line and is kept; rows that share a doc_id count
as one document, and each row loses its own lines; a null doc_id counts for no document, so such a
row loses every line that is frequent elsewhere; no table is too small (an empty one gives no rows);
input columns of the counts' names are replaced, all others are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.shared import materialize

#: Most lines (some 40 bytes each) to a broadcast.
HOT_LINES = 1_000_000
#: The white space that keys are stripped of (space, and tab to carriage return).
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped at both ends, with A-Z lower-cased and nothing else changed."""
    plain = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.length(plain) == F.octet_length(plain), F.lower(plain)).otherwise(F.translate(plain, UPPER, LOWER))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot_lines: int = HOT_LINES, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """All columns of docs with `text` reassembled from the kept lines, and both counts of lines."""
    names = [c for c in docs.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())]
    base = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    # a row is told by its doc_id and a hash of its text: equal rows lose the same lines
    base = base.select("row", F.split("_text", "\n").alias("_lines"), F.col("row.doc_id").alias("_doc"), F.xxhash64("_text", F.length("_text")).alias("_row"))
    keys = base.select("_doc", "_row", F.posexplode("_lines").alias("_pos", "_line")).withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= min_chars)
    keys = keys.select("_doc", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    counted = keys.groupBy("_h1", "_h2").agg(F.countDistinct("_doc").alias("_n"), F.max("_doc").alias("_last"), F.count("*").alias("_rows"))
    frequent = materialize(counted.where(F.col("_n") >= min_docs).drop("_n"))
    rows = frequent.agg(F.sum("_rows")).first()[0] or 0
    hot = F.col("_rows") * hot_lines > rows
    found = [keys.join(F.broadcast(frequent.where(hot)), ["_h1", "_h2"])]
    if not frequent.where(~hot).isEmpty():
        found.append(keys.join(frequent.where(~hot), ["_h1", "_h2"]))
    gone = None
    for part in found:
        part = part.where(~F.col("_doc").eqNullSafe(F.col("_last"))).select("_doc", "_row", "_pos")
        gone = part if gone is None else gone.unionByName(part)
    gone = gone.groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_gone"))
    gone = gone.select(F.col("_doc").alias("_doc2"), F.col("_row").alias("_row2"), "_gone")
    joined = base.join(gone, base["_row"].eqNullSafe(gone["_row2"]) & base["_doc"].eqNullSafe(gone["_doc2"]), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("_lines", i + 1)), "\n")
    out = joined.withColumn("_kept", F.when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(kept))
    columns = [F.col("_kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names]
    return out.select(*columns, F.size("_lines").cast("long").alias(n_lines), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(n_dropped))


#: The same rows by DuckDB, for tables with one row a doc_id.
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keep_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, (f.k IS NOT NULL AND doc_id <> keep_doc) AS gone FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
