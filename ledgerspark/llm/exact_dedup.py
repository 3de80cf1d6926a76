"""Exact deduplication by Grace hashing: records are dealt to spill files by a hash of their content,
again and again, until each bucket fits an open-addressing table that compares complete contents.

Level 0 combines copies where the documents are read, so that a text that fills a third of the table
leaves each task as a single record. Each further level deals the records left by a new hash of the
content, one bucket to a task. A bucket whose distinct texts exceed the table is emptied in parts
whose records go to the next level; the others are finished. Records of one text that outweigh a
bucket by themselves meet in salted groups first. A level is written to the shared folder before the
next one reads it. Each record names the one it was combined into, and these links are followed back
to the documents by joins on numbers; texts move once where each bucket fits.

Defined results: texts are equal when identical after lower-casing A-Z; null is equal to empty; of
equal texts the row with the largest id stays, null being the least; of rows with that id one stays;
rows with a null id take part; an empty table gives no rows; a text longer than the table is a bucket
of its own; input columns are carried inside one struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.bpe import small_batches
from ledgerspark.llm.shared import materialize

#: Bytes of distinct texts that a task holds; bytes of records that a bucket is meant to get.
TABLE_BYTES, BUCKET_BYTES = 128 << 20, 48 << 20
#: Records of one text to a salted group.
MEET = 64
#: Bytes of texts to an Arrow batch.
BATCH_BYTES = 16 << 20


class ContentTable:
    """Distinct contents by open addressing with linear probing; at most half of the slots are taken."""

    def __init__(self) -> None:
        self.slots, self.bytes = array("q", [-1]) * 1024, 0
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []

    def place(self, digest: bytes, content: bytes) -> int:
        """The number of this content, a new one if it is not there."""
        slots, mask = self.slots, len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (i := slots[at]) >= 0:
            if self.digests[i] == digest and self.contents[i] == content:
                return i
            at = (at + 1) & mask
        slots[at] = i = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * i > mask:
            self._grow()
        return i

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, digest in enumerate(self.digests):
            at = int.from_bytes(digest[:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


class Combiner:
    """Combines the records of one task; what it hands out are rows of the level's table."""

    def __init__(self, level: int, table_bytes: int, schema: pa.Schema):
        self.level, self.table_bytes, self.schema = level, table_bytes, schema
        self.next, self.overflowed = TaskContext.get().partitionId() << 33, level == 0
        self._clear()

    def _clear(self) -> None:
        self.table, self.rows, self.keep, self.again = ContentTable(), [], [], []

    def add(self, digest: bytes, content: bytes, rows: int, keep: tuple, again: bool) -> int:
        """keep: (id is not null, id, row number) of the row that stays. Returns the record's class."""
        i = self.table.place(digest, content)
        if i == len(self.rows):
            self.rows.append(rows), self.keep.append(keep), self.again.append(again)
        else:
            self.rows[i] += rows
            self.keep[i] = max(self.keep[i], keep)
        return self.next + i

    def full(self) -> bool:
        return self.table.bytes > self.table_bytes and len(self.rows) > 1

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The distinct contents as records; those that may have copies elsewhere keep their text."""
        self.overflowed |= self.full()
        texts, at = self.table.contents, 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < BATCH_BYTES:
                size += len(texts[end])
                end += 1
            live = [self.overflowed or x for x in self.again[at:end]]
            columns = {
                "class": range(self.next + at, self.next + end), "sha": [x.hex() for x in self.table.digests[at:end]], "text": [t if x else None for t, x in zip(texts[at:end], live, strict=True)],
                "bytes": [len(t) for t in texts[at:end]], "rows": self.rows[at:end], "keep_id": [x[1] for x in self.keep[at:end]], "keep_row": [x[2] for x in self.keep[at:end]], "live": live,
            }
            yield filled(self.schema, end - at, columns)
            at = end
        self.next += len(texts)
        self._clear()


def filled(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    """A batch of the schema; columns that are not given are null."""
    arrays = [c if isinstance(c := columns.get(f.name), (pa.Array, pa.ChunkedArray)) else pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for f in schema]
    return pa.record_batch(arrays, schema=schema)


def level_schema(id_type: T.DataType, carried: T.DataType | None) -> T.StructType:
    """Records have a text or its length, members have a class; a table holds both."""
    kinds = {"member": T.LongType(), "id": id_type, "class": T.LongType(), "sha": T.StringType(), "text": T.BinaryType(), "bytes": T.LongType(), "rows": T.LongType(), "keep_id": id_type, "keep_row": T.LongType(), "live": T.BooleanType()}
    return T.StructType([T.StructField(k, v) for k, v in (kinds | ({"row": carried} if carried else {})).items()])


def combine_where_read(docs: DataFrame, id_column: str, text_column: str, carry: list[str]) -> DataFrame:
    """Level 0: a member for each document and a record for each distinct text of a task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    taken = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"), *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []))
    schema = level_schema(taken.schema["id"].dataType, taken.schema["row"].dataType if carry else None)
    wanted, table_bytes = to_arrow_schema(schema), TABLE_BYTES

    def run(batches):
        out, row = Combiner(0, table_bytes, wanted), TaskContext.get().partitionId() << 33
        for b in batches:
            classes = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                content = text.lower() if text else b""  # of bytes: A-Z only
                classes.append(out.add(hashlib.sha256(content).digest(), content, 1, (key is not None, key, row + len(classes)), False))
            yield filled(wanted, len(classes), {"member": range(row, row + len(classes)), "id": b.column(0), "class": classes} | ({"row": b.column(2)} if carry else {}))
            row += len(classes)
            if out.full():
                yield from out.flush()
        yield from out.flush()

    return taken.mapInArrow(run, schema)


def combine_dealt(records: DataFrame, level: int, buckets: int) -> DataFrame:
    """A level: records (class, sha, text, rows, keep_id, keep_row, salt) dealt to buckets and combined."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = level_schema(records.schema["keep_id"].dataType, None)
    wanted, table_bytes = to_arrow_schema(schema), TABLE_BYTES

    def run(batches):
        out = Combiner(level, table_bytes, wanted)
        for b in batches:
            classes = []
            for sha, text, rows, key, row, salt in zip(*(b.column(c).to_pylist() for c in ("sha", "text", "rows", "keep_id", "keep_row", "salt")), strict=True):
                classes.append(out.add(bytes.fromhex(sha), text, rows, (key is not None, key, row), salt is not None))
            yield filled(wanted, len(classes), {"member": b.column("class"), "class": classes})
            if out.full():
                yield from out.flush()
        yield from out.flush()

    dealt = records.repartition(buckets, F.xxhash64(F.lit(level), "sha"), "salt")
    return dealt.select("class", "sha", "text", "rows", "keep_id", "keep_row", "salt").mapInArrow(run, schema)


def _salted(live: DataFrame) -> DataFrame:
    """Adds salt: a group's number for records of a text whose copies outweigh a bucket, else null."""
    heavy = materialize(live.groupBy("sha").agg(F.count("*").alias("copies"), F.sum("bytes").alias("weight")).where((F.col("weight") > BUCKET_BYTES) & (F.col("copies") > MEET)).select("sha", F.ceil(F.col("copies") / MEET).alias("groups")))
    if heavy.isEmpty():
        return live.withColumn("salt", F.lit(None).cast("long"))
    return live.join(heavy, "sha", "left").withColumn("salt", F.pmod(F.xxhash64("class"), F.col("groups"))).drop("groups")


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and the columns of carry in a struct `row`."""
    small_batches(docs.sparkSession)
    levels = [materialize(combine_where_read(docs, id_column, text_column, carry or []))]
    while True:
        live = levels[-1].where("member IS NULL AND live")
        weight = live.agg(F.sum(F.col("bytes") + 100)).first()[0]
        if weight is None:
            break
        levels.append(materialize(combine_dealt(_salted(live), len(levels), 1 + len(levels) * weight // BUCKET_BYTES)))  # more room at each level
    found = None
    for table in levels[:0:-1]:  # from the last level back to the first: what each member came to
        ended = table.where("member IS NULL AND NOT live").select("class", "keep_id", "keep_row", F.col("rows").alias("group_size"), F.col("sha").alias("text_sha256"))
        ended = ended if found is None else ended.unionByName(found)
        found = table.where("member IS NOT NULL").select("member", "class").join(ended, "class").drop("class").withColumnRenamed("member", "class")
    rows = levels[0].where("member IS NOT NULL").select("member", F.col("id").alias("doc_id"), "class", *(["row"] if carry else []))
    if found is None:  # no rows at all
        found = levels[0].select("class", "keep_id", "keep_row", F.col("rows").alias("group_size"), F.col("sha").alias("text_sha256"))
    out = rows.join(found, "class")
    return out.select("doc_id", "keep_id", "group_size", (F.col("member") == F.col("keep_row")).alias("kept"), "text_sha256", *(["row"] if carry else []))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    kept = mark_copies(docs, id_column, text_column, docs.columns).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


#: The same rows by DuckDB, for tables with one row a doc_id.
ORACLE_SQL = """
WITH keyed AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY k) AS kept, sha256(k) AS text_sha256
FROM keyed
"""
