"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents are encoded in one pass; only documents longer than a sequence are cut. A full piece is a
sequence of its own. The other pieces are dealt at random into problems of bounded size. On every
problem several islands evolve their own populations: crossover injects whole well-filled bins of
one parent into the other, bins that hold a duplicate are dissolved, and displaced pieces are put
back best-fit. After an epoch each island's best solution migrates to the next island. The badly
filled bins of all problems are pooled and packed once more.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an
empty table gives no pieces; a null doc_id is kept; a text of any length is cut whole; bins that fill
alike are told apart by their number, so ties only decide where a piece lies; other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ledgerspark.llm.bpe import broadcast_model, small_batches
from ledgerspark.llm.bpe_blocks import BlockEncoder
from ledgerspark.llm.shared import materialize

#: Bins to a problem, islands to a problem, solutions to an island, generations to an epoch, epochs.
PROBLEM_BINS, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 400, 2, 6, 6, 2
#: Pieces to a problem at most, about: texts of a few tokens would otherwise come by the million.
PROBLEM_PIECES = 50_000
#: A bin with more than this share free is packed again with those of other problems.
LOOSE = 1 / 256


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length and the CRC-32 of its ids as little-endian 32-bit."""
    small_batches(docs.sparkSession)
    model = broadcast_model(docs.sparkSession, path)

    def run(batches):
        encoder, end = BlockEncoder(model.value), np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for at, ids in enumerate(encoder.batch(b.column(1).to_pylist())):
                ids += end
                for k, i in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[i : i + 4 * size]
                    doc.append(at), piece.append(k), start.append(i // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
            yield pa.record_batch([b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Packing:
    """A solution: bins as lists of items. Items are put back by best fit, the longest first."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fill = [sum(map(lengths.__getitem__, b)) for b in bins]

    def insert(self, items: list[int]) -> Packing:
        free = sorted((self.size - f, i) for i, f in enumerate(self.fill))
        for x in sorted(items, key=self.lengths.__getitem__, reverse=True):
            n = self.lengths[x]
            at = bisect_left(free, (n, -1))
            if at == len(free):
                room, i = self.size, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            else:
                room, i = free.pop(at)
            self.bins[i].append(x)
            self.fill[i] += n
            insort(free, (room - n, i))
        return self

    def cost(self) -> tuple[int, float]:
        return len(self.bins), -sum((f / self.size) ** 2 for f in self.fill)

    def crossed(self, other: Packing, rng: np.random.Generator) -> Packing:
        """Whole well-filled bins of the other parent go in; bins with duplicates are dissolved."""
        order = sorted(range(len(other.bins)), key=lambda i: -other.fill[i])
        good = order[: max(1, len(order) // 2)]
        given = [other.bins[i] for i, take in zip(good, rng.random(len(good)) < 0.5, strict=True) if take]
        taken = {x for b in given for x in b}
        stay = [b for b in self.bins if taken.isdisjoint(b)]
        displaced = [x for b in self.bins if not taken.isdisjoint(b) for x in b if x not in taken]
        return Packing([list(b) for b in stay + given], self.lengths, self.size).insert(displaced)

    def mutated(self, rng: np.random.Generator) -> Packing:
        """The loosest bins and a few others are dissolved and put back."""
        order = sorted(range(len(self.bins)), key=self.fill.__getitem__)
        gone = {*order[: max(1, len(order) // 20)], *rng.integers(0, len(order), max(1, len(order) // 20)).tolist()}
        return Packing([list(b) for i, b in enumerate(self.bins) if i not in gone], self.lengths, self.size).insert([x for i in gone for x in self.bins[i]])


def evolve(lengths: list[int], size: int, start: list[list[int]], seed: int) -> list[np.ndarray]:
    """One epoch of an island. start: solutions as bin numbers of the items; more are made if few."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // size)
    people = []
    for solution in start:
        bins: list[list[int]] = [[] for _ in range(max(solution) + 1)]
        for x, b in enumerate(solution):
            bins[b].append(x)
        people.append(Packing(bins, lengths, size))
    if not people:
        people.append(Packing([], lengths, size).insert(list(range(len(lengths)))))
    while len(people) < POPULATION:  # a random part of the items first, the rest best-fit
        some = rng.permutation(len(lengths))[: max(1, len(lengths) // 3)].tolist()
        first = Packing([], lengths, size).insert(some)
        people.append(first.insert(sorted(set(range(len(lengths))) - set(some))))
    people.sort(key=Packing.cost)
    for _ in range(GENERATIONS):
        if len(people[0].bins) <= least:
            break
        for _ in range(POPULATION // 2):
            a, b = (int(x) for x in np.minimum(rng.integers(0, POPULATION, 2), rng.integers(0, POPULATION, 2)))
            child = people[a].crossed(people[b], rng)
            people[-1] = child.mutated(rng) if rng.random() < 0.5 else child
            people.sort(key=Packing.cost)
    out = []
    for p in people:
        of = np.zeros(len(lengths), np.int32)
        for i, b in enumerate(p.bins):
            of[b] = i
        out.append(of)
    return out


def _epoch(state: DataFrame, size: int, last: bool) -> DataFrame:
    """Evolve every (problem, island); solutions: bin numbers of a piece in the island's population."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid", ignore_index=True)
        known = np.array(pdf["solutions"].tolist(), dtype=np.int32).reshape(len(pdf), -1)
        seed = int(pdf["problem"].iloc[0]) * 1009 + int(pdf["island"].iloc[0]) * 31 + known.shape[1]
        people = evolve(pdf["length"].tolist(), size, [known[:, j].tolist() for j in range(known.shape[1])][:POPULATION], seed)
        pdf["solutions"] = list(np.stack(people[: 1 if last else POPULATION], axis=1))
        return pdf

    return state.groupBy("problem", "island").applyInPandas(run, state.schema)


def _solve(pieces: DataFrame, size: int) -> DataFrame:
    """(pid, length) -> (pid, length, problem, bin): the best island's best solution of each problem."""
    total, n = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    problems = max(1, round(total / size / PROBLEM_BINS), n // PROBLEM_PIECES)
    state = pieces.withColumn("problem", F.pmod(F.xxhash64("pid"), F.lit(problems)).cast("int"))
    state = state.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("solutions", F.array().cast("array<int>"))
    for epoch in range(EPOCHS):
        last = epoch == EPOCHS - 1
        state = materialize(_epoch(state, size, last))
        if not last:  # the best solution of each island goes to the next one, in front of its own
            elite = state.select("pid", "problem", ((F.col("island") + 1) % ISLANDS).alias("island"), F.element_at("solutions", 1).alias("elite"))
            state = state.join(elite, ["pid", "problem", "island"]).withColumn("solutions", F.concat(F.array("elite"), "solutions")).drop("elite").select(*state.columns)
    state = state.withColumn("bin", F.element_at("solutions", 1)).drop("solutions")
    best = state.groupBy("problem", "island").agg(F.max("bin").alias("bins")).groupBy("problem").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    return state.join(best, ["problem", "island"]).select("pid", "length", "problem", "bin")


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces; sequence ids are negative for full pieces.

    A piece's number is stored with it: a second plan of the same scan may number rows otherwise.
    """
    pieces = materialize(pieces.withColumn("pid", F.monotonically_increasing_id()))
    open_pieces = pieces.where(F.col("length") < size).select("pid", "length")
    first = materialize(_solve(open_pieces, size))
    bins = first.groupBy("problem", "bin").agg(F.sum("length").alias("fill"))
    loose = bins.where(F.col("fill") < size * (1 - LOOSE)).select("problem", "bin")
    again = _solve(materialize(first.join(loose, ["problem", "bin"], "left_semi").select("pid", "length")), size)
    number = lambda level: ((F.col("problem").cast("long") * 2 + level) * (1 << 24) + F.col("bin")).alias("sequence_id")
    placed = first.join(loose, ["problem", "bin"], "left_anti").select("pid", number(0)).unionByName(again.select("pid", number(1)))
    out = pieces.join(placed, "pid", "left").withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("pid")))
    before = W.Window.partitionBy("sequence_id").orderBy("pid").rowsBetween(W.Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("pid")


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces_of(docs, path, size, end_id), size)
