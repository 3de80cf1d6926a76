"""The labelled rows that classifiers may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classifiers are fitted on at most about so many labelled rows, chosen by a hash of doc_id.
TRAINING_ROWS = 20_000
#: Shares of the hashes are counted in so many parts, so that the sample of any number of labels has rows.
FINENESS = 1 << 48


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, y) of the sample; distinct texts, so that copies do not weigh more. Null labels are
    skipped; of different labels of one text or id the larger counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    share = rows / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(FINENESS)) < int(share * FINENESS))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y").groupBy("text").agg(F.max("y").alias("y"))
