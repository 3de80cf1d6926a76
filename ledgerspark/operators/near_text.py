"""Texts within a few edits of each other, found by equal segments; connected groups; order-dependent merging.

A text with at most k edits to another one has one of the k + 1 segments of the other unchanged, and
not far from its place. Segments and the substrings they can be equal to are joined by equality, so
no text meets all others; the exact distance is computed for what meets. The places where segment i
(from 0) of k + 1 can stand are at most i from its own, and at most k - i from it counted from the
end: edits before it and behind it share the k (multi-match-aware selection of the Pass-Join papers).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.expressions import edit_budget
from ledgerspark.plans.stored import stored

#: Titles are one where their edits are under this share of the shorter one: 1 in 5.
SHORTER_PER_EDIT = 5


def segments(df: DataFrame, keys: list[str], text: str, edits: Column) -> DataFrame:
    """A row for each of the edits + 1 segments of a text, with `_meet`, the number of segment, place and key."""
    k, n = edits, F.length(text)
    rows = df.withColumn("_n", n).withColumn("_k", k).where("_k >= 0 AND _n > _k").withColumn("_i", F.explode(F.expr("sequence(0, _k)")))
    return rows.withColumn("_meet", F.xxhash64(*keys, "_n", "_i", F.substr(text, F.expr(_START) + 1, F.expr(_LENGTH)))).drop("_n", "_k", "_i")


#: Place and length of segment _i of _k + 1 of a text of _n characters; the last ones take the rest.
_START = "CAST(_i * (_n DIV (_k + 1)) + greatest(0, _i - (_k + 1 - _n % (_k + 1))) AS INT)"
_LENGTH = "CAST(_n DIV (_k + 1) + CASE WHEN _i >= _k + 1 - _n % (_k + 1) THEN 1 ELSE 0 END AS INT)"


def substrings(df: DataFrame, keys: list[str], text: str, least: Column, most: Column, edits: Callable[[Column], Column]) -> DataFrame:
    """A row for each substring that can equal a segment of a text of `least` to `most` characters."""
    rows = df.withColumn("_m", F.length(text)).withColumn("_from", F.greatest(least, F.lit(1)).cast("int")).withColumn("_to", most.cast("int")).where("_from <= _to")
    rows = rows.withColumn("_n", F.explode(F.expr("sequence(_from, _to)"))).withColumn("_k", edits(F.col("_n"))).where("_k >= 0 AND _n > _k AND abs(_m - _n) <= _k")
    rows = rows.withColumn("_i", F.explode(F.expr("sequence(0, _k)"))).withColumn("_p", F.expr(_START)).withColumn("_l", F.expr(_LENGTH))
    low, high = "greatest(0, _p - _i, _p + _m - _n - (_k - _i))", "least(_m - _l, _p + _i, _p + _m - _n + (_k - _i))"
    rows = rows.withColumn("_s", F.explode(F.expr(f"CASE WHEN {low} <= {high} THEN sequence({low}, {high}) END")))
    return rows.withColumn("_meet", F.xxhash64(*keys, "_n", "_i", F.substr(text, F.col("_s") + 1, F.col("_l")))).drop("_m", "_from", "_to", "_n", "_k", "_i", "_p", "_l", "_s")


def fuzzy_terms(terms: DataFrame, words: DataFrame, term: str = "term", word: str = "word") -> DataFrame:
    """(word, term, edits) of all terms within a word's edit budget, of three characters and more both.

    Words and terms meet by segments, so there is no product of the two.
    """
    at_least = lambda df, c: df.select(c).where(F.length(c) >= 3).distinct()
    budget = lambda n: F.when(n <= 4, 1).when(n <= 8, 2).otherwise(3)
    cut = segments(at_least(words, word), [], word, edit_budget(F.col(word)))
    met = substrings(at_least(terms, term), [], term, F.length(term) - 3, F.length(term) + 3, budget)
    pairs = cut.join(met, "_meet").select(word, term).distinct()
    return pairs.withColumn("edits", F.levenshtein(word, term)).where(F.col("edits") <= edit_budget(F.col(word)))


def alike_titles(titles: DataFrame, keys: list[str], title: str, node: str) -> DataFrame:
    """Pairs (a, b) of nodes, both ways, of one key: one title begins with the other, or few edits lie between."""
    t = titles.where(F.length(title) > 0).select(*keys, title, node)
    other = t.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col(title).alias("_other"), F.col(node).alias("_b"))
    same_key = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)], F.lit(True))
    begins = t.where(F.length(title) > 1).withColumn("_n", F.explode(F.sequence(F.lit(1), F.length(title) - 1)))
    begins = begins.withColumn("_meet", F.xxhash64(*keys, F.substr(title, F.lit(1), F.col("_n"))))
    whole = other.withColumn("_meet", F.xxhash64(*[f"_o{i}" for i in range(len(keys))], "_other"))
    prefix = begins.join(whole, "_meet").where(same_key & F.startswith(title, F.col("_other"))).select(F.col(node).alias("a"), F.col("_b").alias("b"))
    edits = lambda n: F.floor((n - 1) / SHORTER_PER_EDIT).cast("int")  # noqa: E731  the most that are under the share
    shorter = segments(other.where(F.length("_other") > SHORTER_PER_EDIT), [f"_o{i}" for i in range(len(keys))], "_other", edits(F.length("_other")))
    least = F.greatest(F.lit(SHORTER_PER_EDIT + 1), F.ceil(F.length(title) * SHORTER_PER_EDIT / (SHORTER_PER_EDIT + 1)))
    longer = substrings(t, keys, title, least, F.length(title), edits)
    met = shorter.join(longer, "_meet").where(same_key & (F.col(node) != F.col("_b")))
    close = met.where(F.levenshtein(title, "_other") * SHORTER_PER_EDIT < F.length("_other")).select(F.col(node).alias("a"), F.col("_b").alias("b"))
    one_way = prefix.unionByName(close).distinct()
    return one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """(node, part) for pairs given both ways: the least node that a node is linked to over any number of pairs.

    Each round a node takes the least label around it and then that label's own label; rounds grow with
    the logarithm of a chain's length. Labels are stored, so a lost executor costs a round at most.
    """
    labels = stored(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("part")).withColumnRenamed("a", "node"))
    while True:
        around = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("part").alias("_near"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", "part", F.least("part", "_near").alias("_new"))
        further = labels.select(F.col("node").alias("_new"), F.col("part").alias("_next"))
        after = stored(near.join(further, "_new").select("node", F.least("_new", "_next").alias("after"), F.col("part").alias("before")))
        changed = not after.where("after <> before").isEmpty()
        labels = after.select("node", F.col("after").alias("part"))
        if not changed:
            return labels


def same_titles(rows: DataFrame, keys: list[str], title: str, order: list[str]) -> DataFrame:
    """Rows with `cluster`, the title that stands for theirs: within a key, in this order, a row joins the first
    cluster whose title begins with its own, or the other way round, or differs in less than a fifth of the
    shorter one; the longest title, of equal ones the first, stands for a cluster from then on.

    Only titles that are linked, over others if need be, can come into one cluster: rows of one such part
    stand together and in order, and one pass over them keeps the clusters of the part at hand, no rows.
    A title that is linked with none is a cluster of its own, by an aggregate. Empty and null titles join
    nothing; case does not count; orders that leave rows equal leave their order open.
    """
    named = rows.withColumn("_lower", F.lower(title))
    titles = stored(named.where("_lower <> ''").groupBy(*keys, "_lower").agg(F.min_by(title, F.struct(*order)).alias("_first")).withColumn("_node", F.monotonically_increasing_id()))
    pairs = stored(alike_titles(titles, keys, "_lower", "_node"))
    near = pairs.groupBy("a").agg(F.collect_set("b").alias("_near"))
    parts = connected(pairs)
    known = titles.join(parts, titles["_node"] == parts["node"], "left").drop("node").join(near, F.col("_node") == near["a"], "left").drop("a")
    known = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_lower").alias("_l"), "_first", "_node", "part", "_near")
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_lower") == F.col("_l"))
    joined = named.join(known, on, "left").drop("_lower", "_l", *[f"_k{i}" for i in range(len(keys))])
    alone = joined.where(F.col("part").isNull()).withColumn("cluster", F.coalesce("_first", F.lit(""))).select(*rows.columns, "cluster")
    linked = joined.where(F.col("part").isNotNull()).select(*rows.columns, "_node", "part", "_near")
    schema = linked.select(*rows.columns, "part", F.lit(0).alias("_cluster")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, clusters = None, []  # of a cluster: the node and the length of the title that names it
        for b in batches:
            out = []
            for text, node, at, around in zip(*(b.column(c).to_pylist() for c in (title, "_node", "part", "_near")), strict=True):
                if at != part:
                    part, clusters = at, []
                joins = {node, *around}
                i = next((i for i, c in enumerate(clusters) if c[0] in joins), len(clusters))
                if i == len(clusters):
                    clusters.append([node, len(text)])
                elif len(text) > clusters[i][1]:
                    clusters[i] = [node, len(text)]
                out.append(i)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.int32())], names=[*kept, "_cluster"])

    kept = [*rows.columns, "part"]
    merged = stored(linked.repartition("part").sortWithinPartitions("part", *order).mapInArrow(run, schema))
    names = merged.groupBy("part", "_cluster").agg(F.min_by(title, F.struct(-F.length(title), *order)).alias("cluster"))
    return alone.unionByName(merged.join(names, ["part", "_cluster"]).select(*rows.columns, "cluster"))
