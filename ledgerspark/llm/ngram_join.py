"""Exact Jaccard self-join over word n-grams, by token-combination prefixes, down to its components.

Every document becomes the set of its distinct 64-bit shingle hashes; documents with equal sets form
a class, and all further work is on classes. Tokens (shingles) are ordered by how many documents share
their bucket of a counting table over all documents, then by hash: an order by estimated frequency. If two sets reach the similarity, they share so many tokens that within a prefix of
each they share either one rare token or two frequent tokens of one of FREQUENT_GROUPS groups: the
prefix is extended until the possible mismatches cannot explain less. So rare tokens are indexed
alone and frequent ones only in pairs. Sets too small for pairs also index single frequent tokens.

Candidates are not expanded into all pairs of a posting list. First every member is compared with
two leaders of its list. Lists that a bounded sample shows to be long are dealt into PARTS parts with
leaders of their own, which are compared across parts, so that no task holds such a list. Then only members of different components are compared: in short lists by a
join, in long ones blockwise. Long lists with the same largest component are pooled, and the members
outside it are compared with all members by their sketches, in groups of two blocks of bounded size.
That loses no link between components, which is what the result holds.

A class carries a parity sketch: for each of some buckets, whether it holds an odd number of the
class's tokens. Two sketches differ in no more buckets than the sets have tokens apart, so a pair
whose sketches differ in too many is no link, for certain. Only the others' whole sets are compared.

Defined results: a null or empty text has no shingles and is its own component; so is a row with a
null doc_id (component null). Fewer words than n: the whole sequence is the one shingle. Rows that
share a doc_id are separate documents, equal texts are linked, further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ledgerspark.llm.bpe import forget_words, small_batches
from ledgerspark.llm.shared import materialize, release

#: Size of the table that counts documents by shingle hash, whatever the corpus: fixed memory.
BUCKETS = 1 << 18
#: A token is frequent if its bucket lies so many standard deviations and documents over the mean.
FREQUENT_SD, FREQUENT_DOCS = 5, 8
FREQUENT_GROUPS = 16
#: Documents of the sample that shows long lists, sightings there that make a list long, members that one
#: has at least, and its parts.
LIST_SAMPLE, LONG_SIGHTINGS, LONG_LIST, PARTS = 20_000, 8, 512, 64
#: Posting lists up to this size are compared by a join where components differ.
SHORT_LIST = 16
#: Sets to a block of members outside, and of all members, of pooled long lists.
OUTSIDE_BLOCK, MEMBER_BLOCK = 512, 1024

#: Texts hashed at once; that takes some 30 times their bytes.
BATCH_ROWS = 200

#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[[32, *range(9, 14)]] = 0
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text, computed over the bytes of all texts at once."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none] * len(texts)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = ~space[first]
    begins = np.flatnonzero(begins)
    if not len(begins):
        return [none] * len(texts)
    spans = np.diff(np.append(begins, len(data)))
    inside = np.arange(begins[0], len(data)) - np.repeat(begins, spans)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(spans.max()), _BASE, np.uint64)]))
    words = _mix(np.add.reduceat(_BYTE[data[begins[0] :]] * powers[inside], begins - begins[0]))
    starts = np.searchsorted(begins, offsets)
    counts = np.diff(starts)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    full = np.zeros(len(words), np.uint64)
    for j in range(n):
        full += padded[j : j + len(words)] * _PLACE[j]
    full = _mix(full)
    out = []
    for a, b, m in zip(starts[:-1].tolist(), starts[1:].tolist(), counts.tolist(), strict=True):
        if m >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif m:
            out.append(_mix((words[a:b] * _PLACE[:m]).sum(keepdims=True) + np.uint64(m)))
        else:
            out.append(none)
    return out


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        return int(_mix(_mix(tokens + np.uint64(77)).sum(keepdims=True) + np.uint64(len(tokens)))[0].astype(np.int64))


def small_set(percent: int) -> int:
    """Sets up to this size also index single frequent tokens. A set can lack pairs only if it has at most
    FREQUENT_GROUPS / similarity tokens, its partners at most that / similarity."""
    return -(-FREQUENT_GROUPS * 10_000 // percent**2)


def signatures(tokens: np.ndarray, counts: np.ndarray, limit: int, percent: int) -> np.ndarray:
    """The index keys of a set. counts: documents by bucket of the hash; over the limit is frequent."""
    size = len(tokens)
    need = size - -(-percent * size // 100) + 1
    seen = counts[(tokens % BUCKETS).astype(np.int64)]
    order = np.lexsort((tokens, seen))
    tokens, often = tokens[order], seen[order] > limit
    rare, often = tokens[~often], tokens[often]
    if need <= len(rare):
        return rare[:need]
    need -= len(rare)
    keys = [rare]
    if size <= small_set(percent):
        keys.append(_mix(often[:need] + np.uint64(1)))
    group = (often >> np.uint64(20)) % FREQUENT_GROUPS
    order = np.argsort(group, kind="stable")
    again = np.zeros(len(often), bool)  # not the first of its group
    again[order[1:]] = group[order[1:]] == group[order[:-1]]
    enough = np.searchsorted(np.cumsum(again), need) + 1
    often, group = often[:enough], group[:enough]
    for g in range(FREQUENT_GROUPS):
        x = often[group == g]
        if len(x) > 1:
            i, j = np.triu_indices(len(x), 1)
            keys.append(_mix(_mix(x[i]) * np.uint64(3) + x[j]))
    return np.concatenate(keys)


def sketch(tokens: np.ndarray) -> bytes:
    """The parities of a set's buckets, one to two of them to a token and 64 at least."""
    buckets = 1 << max(6, int(len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(11) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer buckets, as rows of so many 64-bit words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_link(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with that sum of sizes and at least so many tokens apart can reach the similarity."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def close_sketches(left: list[bytes], right: list[bytes], n_left: np.ndarray, n_right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs that may link, by blocks of bounded memory."""
    by_size = lambda sketches: {k: np.flatnonzero(np.array([len(x) for x in sketches]) == k) for k in {len(x) for x in sketches}}
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, a in by_size(left).items():
        for m, b in by_size(right).items():
            if percent * max(k, m) > 200 * min(k, m):
                continue  # a sketch has one to two buckets to a token: the sets' sizes are too far apart
            words = min(k, m) // 8
            x = _folded(np.frombuffer(b"".join(left[i] for i in a), np.uint64).reshape(len(a), -1), words)
            y = _folded(np.frombuffer(b"".join(right[j] for j in b), np.uint64).reshape(len(b), -1), words)
            step = max(1, (1 << 22) // (len(b) * words))
            for start in range(0, len(a), step):
                apart = np.bitwise_count(x[start : start + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                i, j = np.nonzero(may_link(apart, n_left[a[start : start + step], None] + n_right[None, b], percent))
                out_i.append(a[start + i])
                out_j.append(b[j])
    return np.concatenate(out_i), np.concatenate(out_j)


def _fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (doc_id, n_shingles, cls, sketch) and, with a bucket, of document counts by bucket."""

    def run(batches):
        forget_words()
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            sets = shingle_sets(b.column(1), n)
            for s in sets:
                counts += np.bincount(np.unique(s % BUCKETS).astype(np.int64), minlength=BUCKETS) if len(s) > 5000 else 0
            small = [np.unique(s % BUCKETS).astype(np.int64) for s in sets if 0 < len(s) <= 5000]
            if small:
                counts += np.bincount(np.concatenate(small), minlength=BUCKETS)
            none = pa.nulls(len(sets), pa.int32())
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()), none], names=names)
        there = np.flatnonzero(counts)
        yield pa.record_batch([pa.nulls(len(there), id_type), pa.array(counts[there]), pa.nulls(len(there), pa.int64()), pa.nulls(len(there), pa.binary()), pa.array(there, pa.int32())], names=names)

    id_type, names = pa.int64(), ["doc_id", "n_shingles", "cls", "sketch", "bucket"]
    schema = "doc_id long, n_shingles long, cls long, sketch binary, bucket int"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _entries(docs: DataFrame, n: int, percent: int, counts: np.ndarray, limit: int, long: np.ndarray) -> DataFrame:
    """Rows (sig, part, cls): the index. A task enters a class once, however many copies it has.

    long: the sorted signatures of long lists; their members are dealt into parts from 1 by class.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts, long))  # BUCKETS numbers, and a bounded list

    def run(batches):
        forget_words()
        known: set[int] = set()
        counts, long = shared.value
        for b in batches:
            sigs, keys = [], []
            for s in shingle_sets(b.column(0), n):
                if len(s) and (key := set_key(s)) not in known:
                    known.add(key)
                    sigs.append(signatures(s, counts, limit, percent))
                    keys.append(np.full(len(sigs[-1]), key, np.int64))
            if sigs:
                sig, cls = np.concatenate(sigs).view(np.int64), np.concatenate(keys)
                part = np.zeros(len(sig), np.int32)
                if len(long):
                    at = np.minimum(np.searchsorted(long, sig), len(long) - 1)
                    part = np.where(long[at] == sig, 1 + cls % PARTS, 0).astype(np.int32)
                yield pa.record_batch([pa.array(sig), pa.array(part), pa.array(cls)], names=["sig", "part", "cls"])

    return docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(run, "sig long, part int, cls long")


def _long_lists(docs: DataFrame, rows: int, n: int, percent: int, counts: np.ndarray, limit: int) -> np.ndarray:
    """The sorted signatures that many classes of a bounded sample share; what is missed only costs time."""
    share = min(1.0, LIST_SAMPLE / max(1, rows))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    seen = _entries(some, n, percent, counts, limit, np.zeros(0, np.int64)).groupBy("sig").agg(F.count("*").alias("m"))
    found = seen.where(F.col("m") >= max(LONG_SIGHTINGS, LONG_LIST * share)).select("sig").toArrow()["sig"]
    return np.sort(found.to_numpy())


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        forget_words()
        for b in batches:
            sets = [s for s in shingle_sets(b.column(0), n) if len(s)]
            if sets:
                flat = pa.array(np.concatenate(sets).view(np.int64))
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                yield pa.record_batch([pa.array([set_key(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["cls", "tokens"])

    return docs.select("text").mapInArrow(run, T.StructType([T.StructField("cls", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component) for every node with a link, by repeated contraction.

    Every node moves to its least neighbour's least neighbour; links are renamed, loops and doubles go.
    Least neighbours are aggregated before the shuffle. In the joins the other side has one row a node, so
    the links of a hub are one side's rows of one key, which adaptive execution splits.
    """
    labels, old = None, []
    edges = edges.select("a", "b")
    while True:
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        near = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")))
        move = near.join(near.select(F.col("node").alias("to"), F.col("to").alias("end")), "to").select("node", F.col("end").alias("to"))
        if labels is None:
            labels = materialize(move.toDF("node", "component"))
        else:
            moved = labels.join(move.select(F.col("node").alias("component"), "to"), "component", "left")
            fresh = materialize(moved.select("node", F.coalesce("to", "component").alias("component")))
            old.append(labels)
            labels = fresh
        hop = lambda df, c: df.join(move.select(F.col("node").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        edges = hop(hop(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = materialize(edges)
        release(near, *old)
        old = [edges]
        if edges.isEmpty():
            release(edges)
            return labels


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with these ids. A short list of ids is broadcast, which saves a shuffle of texts."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _pairs(left, right) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


class _Verifier:
    """Tests candidate pairs of classes and remembers the links found."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, percent: int):
        self.docs, self.classes, self.n, self.percent = docs, classes, n, percent
        self.links = None

    def _by_sketch(self, pairs: DataFrame) -> DataFrame:
        """The pairs that may link, with sizes and representatives."""
        percent = self.percent

        def run(batches):
            for b in batches:
                size = np.add(b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
                apart = np.zeros(b.num_rows, np.int64)
                for i, (x, y) in enumerate(zip(b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist(), strict=True)):
                    words = min(len(x), len(y)) // 8
                    x, y = (_folded(np.frombuffer(z, np.uint64)[None, :], words) for z in (x, y))
                    apart[i] = np.bitwise_count(x ^ y).sum()
                yield b.filter(pa.array(may_link(apart, size, percent))).select(names)

        names = ["a", "b", "n_a", "n_b", "rep_a", "rep_b"]
        side = lambda c: self.classes.select("cls", "n_shingles", "rep", "sketch").toDF(c, f"n_{c}", f"rep_{c}", f"sketch_{c}")
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        return pairs.mapInArrow(run, ", ".join(f"{c} long" for c in names))

    def add(self, pairs: DataFrame) -> bool:
        """Whether there are new links."""
        close = materialize(self._by_sketch(pairs.where("a <> b").distinct()))
        reps = materialize(close.select(F.col("rep_a").alias("doc_id")).union(close.select("rep_b")).distinct())
        sets = materialize(_sets(_only(self.docs, reps), self.n))
        of = lambda c: (sets if sets.count() == reps.count() else sets.dropDuplicates(["cls"])).toDF(c, f"t_{c}")  # noqa: E731  rows that share a doc_id repeat
        keys = close.select("a", "b", "n_a", "n_b")
        both = of("a").join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "a").join(of("b"), "b")
        both = both.withColumn("same", F.size(F.array_intersect("t_a", "t_b")))
        links = materialize(both.where(100 * F.col("same") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b"))
        release(close, reps, sets)
        self.links = links if self.links is None else self.links.union(links)
        return not links.isEmpty()


def similar_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialize(_fingerprints(docs, n))
    prints = seen.where("bucket IS NULL").drop("bucket")
    table = seen.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n_shingles").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    mean = counts.mean()
    limit = int(mean + FREQUENT_SD * mean**0.5 + FREQUENT_DOCS)
    classes = materialize(prints.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))

    # posting lists without repeats; lists of one are dropped at once
    long = _long_lists(docs, prints.count(), n, percent, counts, limit)
    entries = _entries(docs, n, percent, counts, limit, long).withColumn("r", F.xxhash64("cls"))  # lists of one group of copies agree on their leaders
    run = W.Window.partitionBy("sig", "part").orderBy("r", "cls")
    whole = run.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    entries = entries.withColumn("before", F.lag("cls").over(run)).where("before IS NULL OR before <> cls").drop("before")
    lists = entries.select("sig", "part", "cls", F.count("*").over(whole).alias("m"), F.first("cls").over(whole).alias("l1"), F.nth_value("cls", 2).over(whole).alias("l2"))
    lists = materialize(lists.where("m > 1 OR part > 0"))
    check = _Verifier(docs, classes, n, percent)
    leaders = lists.where("m > 1").select("cls", F.explode(F.array("l1", "l2")).alias("l")).select(*_pairs(F.col("cls"), F.col("l")))
    if len(long):
        parts = lists.where("part > 0").groupBy("sig", "part").agg(F.first("l1").alias("l1"))  # PARTS rows a list at most
        first = parts.groupBy("sig").agg(F.min("l1").alias("l"))
        leaders = leaders.unionByName(parts.join(first, "sig").select(*_pairs(F.col("l1"), F.col("l"))))
    check.add(leaders)

    # what leaders did not settle: lists of four and more with members in different components
    rest = lists.where("m > 3 OR part > 0").select("sig", "cls", F.when(F.col("part") > 0, SHORT_LIST + 1).otherwise(F.col("m")).alias("m"))
    labels = components(check.links)
    short = _open(rest.where(F.col("m") <= SHORT_LIST), labels)
    other = short.toDF("sig", "cls2", "m2", "c2")
    if check.add(short.join(other, "sig").where("cls < cls2 AND c <> c2").select(*_pairs(F.col("cls"), F.col("cls2")))):
        labels = components(check.links)
    open_lists = materialize(_open(rest.where(F.col("m") > SHORT_LIST), labels))
    if not open_lists.isEmpty() and check.add(_pooled_pairs(open_lists, classes, percent)):
        labels = components(check.links)
    tags = classes.drop("sketch").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = tags.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = materialize(tags.join(least, "component").select(F.col("cls").alias("k"), "component_id"))
    prints = prints.drop("sketch")
    out = prints.join(names, prints["cls"] == names["k"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of posting lists that still span several components, with their component c."""
    tagged = lists.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", "m", F.coalesce("component", "cls").alias("c"))
    split = tagged.groupBy("sig").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("sig")
    return tagged.join(split, "sig", "left_semi")


def _pooled_pairs(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link between members of lists that lie in different components."""
    main = lists.groupBy("sig", "c").agg(F.count("*").alias("k")).groupBy("sig").agg(F.max_by("c", F.struct("k", "c")).alias("pool"))
    members = lists.join(main, "sig").select("pool", "cls", "c").distinct()
    members = materialize(members.join(classes.select("cls", "n_shingles", "sketch"), "cls"))
    block = lambda count, size: F.ceil(count / size).cast("int")
    outside = F.count_if(F.col("c") != F.col("pool"))
    plan = materialize(members.groupBy("pool").agg(block(F.count("*"), MEMBER_BLOCK).alias("mbs"), block(outside, OUTSIDE_BLOCK).alias("obs")))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    dealt = members.join(plan.where("obs > 0"), "pool")
    left = dealt.where("c <> pool").withColumn("ob", F.pmod(F.xxhash64("cls", F.lit(1)), "obs")).withColumn("mb", every("mbs"))
    right = dealt.withColumn("mb", F.pmod(F.xxhash64("cls", F.lit(2)), "mbs")).withColumn("ob", every("obs"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        i, j = close_sketches(list(x["sketch"]), list(y["sketch"]), x["n_shingles"].to_numpy(), y["n_shingles"].to_numpy(), percent)
        apart = x["c"].to_numpy()[i] != y["c"].to_numpy()[j]
        a, b = x["cls"].to_numpy()[i[apart]], y["cls"].to_numpy()[j[apart]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    columns, key = ["pool", "ob", "mb", "cls", "c", "n_shingles", "sketch"], ["pool", "ob", "mb"]
    return left.select(columns).groupBy(key).cogroup(right.select(columns).toDF(*columns).groupBy(key)).applyInPandas(run, "a long, b long")


def keep_first(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The columns of docs for one document of each component: the one with the least doc_id.

    Of rows that share that doc_id all stay, and so do rows with a null doc_id.
    """
    parts = similar_components(docs, n, percent)
    drop = parts.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
