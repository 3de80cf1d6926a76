"""Nearest vectors: an exact Voronoi join and an inverted file with product quantisation.

Both deal the data into cells around pivots or centroids, cells into chunks of bounded size, and send
to a chunk only the queries that may find something there, in blocks of bounded size. A (chunk, query
block) is one group; it is solved with matrix products and returns at most k rows per query.

Defined results: vectors that are null, hold a null or non-finite component, or differ in length from
most vectors take no part, nor do rows with a null id; a query never finds rows of its own id; of rows
that share a query's id the least vector asks; repeated rows are separate candidates; ties go to the
smaller id; fewer candidates than k give fewer rows; an empty table none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ledgerspark.llm.bpe import small_batches
from ledgerspark.llm.shared import materialize, release

#: Rows to a chunk of data and queries to a block: a group's memory.
CHUNK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Cells grow with the square root of the rows up to this number (broadcast: 8 bytes a component each).
MAX_CELLS = 4096
#: Pivots and the index are fitted on at most so many vectors, or CELL_SAMPLE a cell, chosen by hash of the id.
SAMPLE, CELL_SAMPLE = 20_000, 16
#: Rows to a cell at least; bands of distance that a large cell is split into, and cells solved first, in the exact join.
CELL_ROWS, BANDS, HOME_CELLS = 1024, 16, 3
#: Rows whose distances to all centres are held at once when centres are fitted (32 MB for MAX_CELLS centres).
KMEANS_BLOCK = 1024
#: Queries scored at once in a group, pairs reranked at once, and what rounding may add to a score.
RERANK_QUERIES, RERANK_PAIRS, ROUNDING = 64, 1 << 15, 1e-9


def _as_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of usable vectors of this length, and the vectors as a matrix of doubles."""
    good = [(i, v) for i, v in enumerate(column.to_pylist()) if v is not None and len(v) == dim and None not in v]
    at = np.array([i for i, _ in good], np.int64)
    rows = np.array([v for _, v in good], np.float64).reshape(-1, dim)
    fine = np.isfinite(rows).all(axis=1)
    return at[fine], rows[fine]


def _list(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends[: len(matrix) + 1]), pa.array(matrix.reshape(-1)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def usual_length(vectors: DataFrame) -> int:
    found = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def prepared(vectors: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, v): the usable vectors, changed; a changed row of NaN takes no part either."""
    dim = usual_length(vectors)
    small_batches(vectors.sparkSession, 4000)

    def run(batches):
        for b in batches:
            at, rows = _as_rows(b.column(1), dim)
            rows = change(rows)
            fine = ~np.isnan(rows).any(axis=1)
            if fine.any():
                yield pa.record_batch([b.column(0).take(pa.array(at[fine])), _list(rows[fine])], names=["id", "v"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    return vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").where("id IS NOT NULL").mapInArrow(run, schema)


def sample_of(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most so many vectors, the same ones each time."""
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow()["v"].combine_chunks()
    return got.values.to_numpy(zero_copy_only=False).reshape(len(got), -1).copy() if len(got) else np.zeros((0, 1))


def cells_of(count: int) -> int:
    """Cells for so many rows."""
    return max(1, min(MAX_CELLS, count // CELL_ROWS, int(count**0.5) // 2))


def asking(data: DataFrame, every: int) -> DataFrame:
    """(query_id, q): the rows that are queries, one an id."""
    return data.where(F.col("id") % every == 0).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("q"))


def kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = rows[rng.permutation(len(rows))[: min(k, len(rows))]].copy()
    for _ in range(rounds):
        own = (centres**2).sum(1)[None, :]
        near = np.concatenate([(own - 2 * rows[a : a + KMEANS_BLOCK] @ centres.T).argmin(axis=1) for a in range(0, len(rows), KMEANS_BLOCK)])
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, rows)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def best_k(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best scores, ties to the smaller id; the query's own id is left out."""
    scores = np.where(query_ids[:, None] == ids[None, :], -np.inf, scores)
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
        row, col = np.nonzero((scores >= edge) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def solve(data: DataFrame, wanted: DataFrame, queries: DataFrame, found: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Runs found(query block, chunk) -> (query_id, id, score).

    data: (cell, id, v, ...); wanted: (query_id, cell); queries: (query_id, ...) the columns a block needs.
    """
    chunks = data.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    blocks = wanted.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    plan = chunks.join(blocks, "cell")  # a row for each cell, of which there are few
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.join(F.broadcast(plan), "cell").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(11)), "chunks").cast("int")).withColumn("block", every("blocks"))
    right = wanted.join(queries, "query_id").join(F.broadcast(plan), "cell").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(13)), "blocks").cast("int")).withColumn("chunk", every("chunks"))
    key = ["cell", "chunk", "block"]

    def run(chunk: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk) or not len(block):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        return found(block, chunk)

    return left.drop("chunks", "blocks").groupBy(key).cogroup(right.drop("chunks", "blocks").groupBy(key)).applyInPandas(run, "query_id long, id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of the local results."""
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


# --- exact: Voronoi join -------------------------------------------------------------------------


def _whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * rows)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k largest inner products of floor(256 x) for each id divisible by `every`.

    Cells around pivots are split into bands by the distance from the pivot. First each query is solved in
    the HOME_CELLS cells of the largest q.p (pivot p); its k-th score there is a bound. By Cauchy-Schwarz no
    row of a band exceeds q.p + |q| d (its largest distance d), so only bands that reach the bound get the
    query. A query without k rows in its first cells goes to every band.
    """
    spark = vectors.sparkSession
    base = materialize(prepared(vectors, _whole))
    count = base.count()
    if not count:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    cells = cells_of(count)
    pivots = kmeans(sample_of(base, max(SAMPLE, CELL_SAMPLE * cells)), cells, np.random.default_rng(3))
    shared = spark.sparkContext.broadcast(pivots)  # MAX_CELLS vectors at most

    def assign(batches):
        p = shared.value
        for b in batches:
            rows = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            cell = ((p**2).sum(1)[None, :] - 2 * rows @ p.T).argmin(axis=1)
            dist = np.sqrt(((rows - p[cell]) ** 2).sum(1))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["id", "v", "near", "dist"])

    data = materialize(base.mapInArrow(assign, T.StructType([*base.schema.fields, T.StructField("near", T.IntegerType()), T.StructField("dist", T.DoubleType())])))
    edges = F.percentile_approx("dist", F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)]), F.lit(1000))
    wanted_bands = F.least(F.lit(BANDS), F.ceil(F.count("*") / CHUNK_ROWS).cast("int"))
    bands = data.groupBy("near").agg(F.when(wanted_bands > 1, edges).otherwise(F.array().cast("array<double>")).alias("edges"))  # MAX_CELLS rows at most
    data = data.join(F.broadcast(bands), "near").withColumn("cell", F.col("near") * BANDS + F.size(F.filter("edges", lambda x: x < F.col("dist")))).drop("edges")
    data = materialize(data)
    radius = np.full(len(pivots) * BANDS, -np.inf)
    for r in data.groupBy("cell").agg(F.max("dist").alias("r")).collect():  # MAX_CELLS * BANDS rows at most
        radius[r["cell"]] = r["r"]
    queries = materialize(asking(data, every))
    rows = data.select("cell", "id", "v")

    def local(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        ids, own = chunk["id"].to_numpy(), block["query_id"].to_numpy()
        scores = _matrix(block["q"]) @ _matrix(chunk["v"]).T
        row, col = best_k(scores, own, ids, k)
        return pd.DataFrame({"query_id": own[row], "id": ids[col], "score": scores[row, col]})

    def reach(batches):
        p, there = shared.value, np.flatnonzero(radius > -np.inf)
        for b in batches:
            q = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            to_pivot = q @ p.T
            first = np.argsort(-to_pivot, axis=1, kind="stable")[:, :HOME_CELLS]
            at_home = (there[None, :, None] // BANDS == first[:, None, :]).any(axis=2)
            if b.num_columns == 2:
                row, part = np.nonzero(at_home)
            else:
                low = np.array([-np.inf if x is None else x for x in b.column(2).to_pylist()])
                most = to_pivot[:, there // BANDS] + np.sqrt((q**2).sum(1))[:, None] * radius[there][None, :]
                slack = 1e-9 * np.abs(most) + 1e-6  # rounding of the root and the radius
                row, part = np.nonzero((most + slack >= low[:, None]) & ~at_home)
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(there[part].astype(np.int32))], names=["query_id", "cell"])

    home = materialize(solve(rows, materialize(queries.mapInArrow(reach, "query_id long, cell int")), queries, local))
    bound = ranked(home, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    wanted = materialize(queries.join(bound, "query_id", "left").select("query_id", "q", "bound").mapInArrow(reach, "query_id long, cell int"))
    release(base)
    return ranked(home.unionByName(solve(rows, wanted, queries, local)), k).withColumn("score", F.col("score").cast("long"))


# --- approximate: inverted file, product quantisation ----------------------------------------------


class IvfPq:
    """Coarse centroids, codebooks of the residuals' parts, the number of lists to probe, and a margin of scores.

    Fitted on a bounded sample. The probe count is the least at which queries from the sample find `target`
    of their exact neighbours within the sample's probed lists. The margin is how far below the k-th best
    score by codes all but few (`missed`) of the exact neighbours score by codes.
    """

    def __init__(self, sample: np.ndarray, lists: int, parts: int, k: int, target: float = 0.965, missed: float = 0.015):
        rng = np.random.default_rng(5)
        self.centres = kmeans(sample, lists, rng)
        dim = sample.shape[1]
        self.edges = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        near = self.lists_of(sample)
        rest = sample - self.centres[near]
        self.books = [kmeans(rest[:, a:b], 256, rng, 6) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        ask = rng.permutation(len(sample))[:300]
        scores = sample[ask] @ sample.T
        scores[np.arange(len(ask)), ask] = -np.inf
        best = np.argsort(-scores, axis=1)[:, :k]
        order = np.argsort(np.argsort(-sample[ask] @ self.centres.T, axis=1), axis=1)  # place of each list
        place = np.take_along_axis(order, near[best], axis=1).reshape(-1)
        self.probes = int(np.sort(place)[min(len(place) - 1, int(np.ceil(target * len(place))))]) + 1 if len(place) else 1
        self.margin = np.inf
        if len(sample) > k + 1:
            guess = sample[ask] @ self.decoded(near, self.codes(sample, near)).T
            guess[np.arange(len(ask)), ask] = -np.inf
            below = _edge(guess, k) - np.take_along_axis(guess, best, axis=1)
            self.margin = max(0.0, float(np.quantile(below, 1 - missed))) + ROUNDING

    def lists_of(self, rows: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1)[None, :] - 2 * rows @ self.centres.T).argmin(axis=1)

    def codes(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest, out = rows - self.centres[lists], []
        for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True):
            out.append(((book**2).sum(1)[None, :] - 2 * rest[:, a:b] @ book.T).argmin(axis=1).astype(np.uint8))
        return np.stack(out, axis=1)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[lists] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)

    def approximate(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric scores of all queries against all codes of one list."""
        scores = np.repeat((queries @ self.centres[cell])[:, None], len(codes), axis=1)
        for j, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            scores += (queries[:, a:b] @ self.books[j].T)[:, codes[:, j]]
        return scores


def probed(model: IvfPq, queries: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) of the nearest `probes` lists that hold rows, and of more until they hold `least` rows."""
    order = np.argsort(np.where(sizes > 0, -queries @ model.centres.T, np.inf), axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]  # rows in the lists that are nearer
    row, place = np.nonzero((sizes[order] > 0) & ((np.arange(len(sizes)) < model.probes) | (before < least[:, None])))
    return row, order[row, place]


def _edge(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row, as a column."""
    return np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else np.full((len(scores), 1), -np.inf)


def _blocks(model: IvfPq, cell: int, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, codes: np.ndarray):
    """(start, queries, scores by codes) of some queries at a time, the query's own id at minus infinity."""
    for start in range(0, len(queries), RERANK_QUERIES):
        q, mine = queries[start : start + RERANK_QUERIES], own[start : start + RERANK_QUERIES]
        yield start, q, np.where(mine[:, None] == ids[None, :], -np.inf, model.approximate(q, cell, codes))


def rerank(model: IvfPq, cell: int, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray, edges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best exact scores of each unit query among the rows of one list whose score by
    codes reaches the query's edge: however many those are, so near copies with equal codes are all scored exactly."""
    out = []
    for start, q, guess in _blocks(model, cell, queries, own, ids, codes):
        may = (guess >= edges[start : start + len(q), None]) & (guess > -np.inf)
        some = np.flatnonzero(may.any(axis=0))
        near = np.where(may[:, some], q @ rows[some].T, -np.inf)
        row, col = np.nonzero((near >= _edge(near, k) - ROUNDING) & (near > -np.inf))
        col = some[col]
        # A matrix product rounds by place: rows near the edge are summed alike, so that copies tie.
        exact = np.concatenate([(q[row[i : i + RERANK_PAIRS]] * rows[col[i : i + RERANK_PAIRS]]).sum(1) for i in range(0, max(1, len(row)), RERANK_PAIRS)])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[first] + start, col[first], exact[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero vectors become NaN. The largest component is scaled to one first: squares may underflow."""
    most = np.abs(rows).max(axis=1, initial=0.0)[:, None]
    rows = np.divide(rows, most, out=np.full_like(rows, np.nan), where=most > 0)
    return rows / np.sqrt((rows**2).sum(1))[:, None]


def approximate_top_k(vectors: DataFrame, k: int = 5, every: int = 50, parts: int = 16) -> DataFrame:
    """The k largest cosines found for each id divisible by `every`.

    First only codes are shuffled: every probed list gives the query's k best scores by codes. The k-th best of
    them all, less the index's margin, is the query's edge. Then vectors go only where a list has scores that
    reach the edge of a query, and the rows that do are scored exactly.
    """
    spark = vectors.sparkSession
    base = materialize(prepared(vectors, _unit))
    count = base.count()
    if not count:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    lists = max(1, min(MAX_CELLS, int(count**0.5) // 4))
    model = IvfPq(sample_of(base, max(SAMPLE, CELL_SAMPLE * lists)), lists, parts, k)
    shared = spark.sparkContext.broadcast(model)  # MAX_CELLS centroids and 256 codewords a part

    def index(batches):
        for b in batches:
            rows = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            lists = shared.value.lists_of(rows)
            codes = [bytes(c) for c in shared.value.codes(rows, lists)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lists.astype(np.int32)), pa.array(codes, pa.binary())], names=["id", "v", "cell", "codes"])

    data = materialize(base.mapInArrow(index, T.StructType([*base.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType())])))
    release(base)
    own = data.where(F.col("id") % every == 0).groupBy(F.col("id").alias("query_id")).agg(F.count("*").alias("own"))
    queries = materialize(asking(data, every).join(own, "query_id"))
    sizes = np.zeros(len(model.centres), np.int64)
    for r in data.groupBy("cell").count().collect():  # MAX_CELLS rows at most
        sizes[r["cell"]] = r["count"]

    def probe(batches):
        for b in batches:
            q = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            row, cell = probed(shared.value, q, sizes, k + b.column(2).to_numpy())
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["query_id", "cell"])

    def coded(chunk: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(chunk["codes"]), np.uint8).reshape(len(chunk), -1)

    def by_codes(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        cell, ids, mine = int(chunk["cell"].iloc[0]), chunk["id"].to_numpy(), block["query_id"].to_numpy()
        found = []
        for start, _, guess in _blocks(shared.value, cell, _matrix(block["q"]), mine, ids, coded(chunk)):
            top = np.sort(np.partition(guess, -k, axis=1)[:, -k:] if guess.shape[1] > k else guess, axis=1)
            row, place = np.nonzero(top > -np.inf)
            found.append(pd.DataFrame({"query_id": mine[start + row], "id": np.full(len(row), cell), "score": top[row, place]}))
        return pd.concat(found, ignore_index=True)

    def exactly(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        ids, mine = chunk["id"].to_numpy(), block["query_id"].to_numpy()
        row, col, exact = rerank(shared.value, int(chunk["cell"].iloc[0]), _matrix(block["q"]), mine, _matrix(chunk["v"]), ids, coded(chunk), block["edge"].to_numpy(), k)
        return pd.DataFrame({"query_id": mine[row], "id": ids[col], "score": exact})

    wanted = materialize(queries.mapInArrow(probe, "query_id long, cell int"))
    guesses = materialize(solve(data.select("cell", "id", "codes"), wanted, queries.select("query_id", "q"), by_codes))
    kth = ranked(guesses, k).where(F.col("rank") == k).select("query_id", (F.col("score") - model.margin).alias("edge"))
    edged = materialize(queries.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("edge", F.lit(float("-inf"))).alias("edge")))
    best = guesses.groupBy("query_id", F.col("id").cast("int").alias("cell")).agg(F.max("score").alias("best"))
    reached = materialize(best.join(edged.select("query_id", "edge"), "query_id").where("best >= edge").select("query_id", "cell"))
    return ranked(solve(data.select("cell", "id", "v", "codes"), reached, edged, exactly), k)
