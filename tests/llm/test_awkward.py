"""Nulls, repeats, ties, clashing names and empty tables, operator by operator, and the pipeline's stages."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, licenses, ngram_join, packing, queries, token_files, vector_search

SF = "/root/testdata/sf0.001"
VECTOR = "vec_id long, embedding array<double>, id string, v string, cell string, query_id string, score string"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(str(queries.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


def test_packing_of_repeated_rows_and_null_ids(spark, tokenizer):
    rows = [(None, "a b c"), (None, "a b c"), (7, "x"), (7, "x"), (7, None), (8, ""), (9, "word " * 9000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, piece string")
    out = packing.pack_documents(docs, queries.TOKENIZER).collect()
    lengths = Counter()
    for r in out:
        lengths[r["doc_id"]] += r["length"]
    want = Counter()
    for k, t in rows:
        want[k] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert lengths == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 4096


def test_encoding_and_decoding_are_a_round_trip(spark, tokenizer):
    texts = ["Two words", None, "", "<|endoftext|> inside <|startoftext|>x", "naïve Σίσυφος", "two words"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = bpe.encode_ids(docs, queries.TOKENIZER)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded, queries.TOKENIZER).collect()}
    assert decoded == {i: tokenizer.decode(ids, skip_special_tokens=False) for i, ids in got.items()}


def brute_top(rows, score, k=5):
    out = []
    for q, v in rows:
        if q is not None and q % 50 == 0:
            ranked = sorted((-score(v, w), i) for i, w in rows if i is not None and i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked[:k])]
    return out


def test_exact_search_of_repeated_rows_ties_and_clashing_names(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(200)]
    rows += [(201, rows[3][1]), (202, rows[3][1]), (7, rows[7][1]), (7, rows[7][1])]
    odd = [(None, rows[0][1]), (300, []), (350, None)]
    df = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows + odd], VECTOR)
    got = sorted(tuple(r) for r in vector_search.exact_top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    whole = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    assert got == sorted(brute_top(whole, lambda a, b: int(a @ b)))


def test_exact_search_prunes_clustered_vectors_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_ROWS", 50)
    monkeypatch.setattr(vector_search, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(5)
    middle = 4 * np.eye(12)
    rows = [(i, (middle[i % 12] + 0.05 * rng.normal(size=12)).tolist()) for i in range(1200)]
    pairs, solved = [], vector_search.solve
    monkeypatch.setattr(vector_search, "solve", lambda data, wanted, *rest: pairs.append(wanted.count()) or solved(data, wanted, *rest))
    got = sorted(tuple(r) for r in vector_search.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    whole = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    assert got == sorted(brute_top(whole, lambda a, b: int(a @ b)))
    assert pairs[1] < pairs[0]  # beyond the first cells a query goes to few bands


def test_index_search_of_zero_tiny_repeated_and_tied_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(301, [2 * x for x in rows[5][1]]), (302, rows[5][1]), (9, rows[9][1]), (304, [1e-200 * x for x in rows[50][1]])]
    odd = [(400, [0.0] * 8), (350, None), (None, rows[0][1]), (450, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows + odd], VECTOR)
    found = vector_search.approximate_top_k(df).collect()
    unit = {}
    for i, v in rows:
        v = np.array(v) / np.abs(v).max()
        unit[i] = v / np.linalg.norm(v)
    asked = {i for i, _ in rows if i % 50 == 0}
    per = Counter(r["query_id"] for r in found)
    assert set(per) == asked and all(n == 5 for n in per.values())
    assert all(r["score"] == pytest.approx(unit[r["query_id"]] @ unit[r["vec_id"]], abs=1e-12) for r in found)
    assert next(r["vec_id"] for r in found if r["query_id"] == 50 and r["rank"] == 1) == 304
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert vector_search.approximate_top_k(two).count() == 1


def test_long_lists_are_dealt_into_parts_and_lose_no_link(spark, monkeypatch):
    """Near copies that share frequent shingles, and texts that share only a passage with them."""
    words = [f"w{i}" for i in range(60)]
    near = [(i, " ".join(words[:40] + [f"n{i}a", f"n{i}b"])) for i in range(120)]
    other = [(200 + i, " ".join(words[:12] + [f"o{i}x{j}" for j in range(60)])) for i in range(40)]
    docs = spark.createDataFrame(near + other + [(500, near[3][1]), (501, other[3][1])], "doc_id long, text string").repartition(5)
    want = sorted(map(tuple, ngram_join.similar_components(docs).collect()))
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    monkeypatch.setattr(ngram_join, "PARTS", 4)
    assert sorted(map(tuple, ngram_join.similar_components(docs).collect())) == want
    groups = Counter(c for *_, c in want)
    assert groups[0] == 121 and groups[203] == 2 and len(groups) == 1 + 40


def test_licenses_of_repeats_ties_and_empty_tables(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    docs = spark.createDataFrame([(1, text, "clash"), (1, text, "clash"), (None, text, "clash"), (2, None, None), (3, "", None), (4, "word " * 50_000 + text, None)], "doc_id long, text string, license string")
    rows = licenses.scan_licenses(docs).collect()
    assert len([r for r in rows if r["doc_id"] == 1]) == 2 and len({tuple(r) for r in rows if r["doc_id"] == 1}) == 1
    assert licenses.scan_licenses(docs.where(F.lit(False))).count() == 0


def test_token_counts_of_special_tokens_repeats_and_one_file_of_many_blocks(spark, tokenizer, monkeypatch):
    texts = ["a <|endoftext|> b", "a <|endoftext|> b", None, "word " * 70_000, ""]
    docs = spark.createDataFrame([(i if i != 1 else 0, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, part string, value string").coalesce(1)
    want = sorted((i if i != 1 else 0, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    for whole in (token_files.WHOLE_BYTES, 0):  # 0: read in ranges, many to a file
        monkeypatch.setattr(token_files, "WHOLE_BYTES", whole)
        assert sorted((r["doc_id"], r["n_tokens"]) for r in token_files.count_documents(docs, queries.TOKENIZER).collect()) == want
    assert token_files.width_of(49_408) == 2 and token_files.width_of(100_000) == 4


@pytest.fixture(scope="module")
def small_corpus(spark):
    """Documents as the pipeline gets them, with awkward rows and columns named like results."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "x", 0), (None, "some text here", "en", "x", 14)], docs.schema)
    out = docs.unionByName(odd).withColumn("quality_score", F.lit("clash")).withColumn("n_lines", F.lit("clash")).withColumn("_toxic", F.lit("clash"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def test_pipeline_stages_by_brute_force(spark, small_corpus):
    """What a stage keeps is what its operator's decision says, with every column as it was."""
    import corpus_pipeline
    from ledgerspark.llm import quality, toxicity
    from test_llm import brute_components, brute_lines

    stages, rows = dict(corpus_pipeline.STAGES), small_corpus.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)

    model = quality.fit_quality(small_corpus, labels)
    stats = np.array([quality.statistics(r["text"]) for r in rows])
    good = quality.marks_of(model.rules, stats) @ np.array(model.weights) + model.bias >= 0
    assert plain(stages["quality"](spark, small_corpus, SF)) == sorted((tuple(r) for r, g in zip(rows, good) if g), key=repr)

    toxic = toxicity.fit_toxicity(small_corpus, labels)
    score = lambda t: 1 / (1 + np.exp(-(toxic.slope * toxic.evidence(t, {}) + toxic.bias)))
    assert plain(stages["toxicity"](spark, small_corpus, SF)) == sorted((tuple(r) for r in rows if score(r["text"]) < 0.7), key=repr)

    lines = brute_lines([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None])
    out = stages["line_dedup"](spark, small_corpus, SF)
    assert out.columns == small_corpus.columns and out.where("n_lines = 'clash'").count() == len(rows)
    assert {r["doc_id"]: r["text"] for r in out.where("doc_id IS NOT NULL").collect()} == lines

    parts = brute_components([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None])
    kept = {r["doc_id"] for r in stages["near_duplicates"](spark, small_corpus, SF).collect()}
    assert kept == {None} | {k for k, (_, c) in parts.items() if k == c}


def test_pipeline_stages_on_empty_tables(spark, small_corpus):
    import corpus_pipeline

    nothing = small_corpus.where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from ledgerspark.llm import shared

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match=re.escape("spark.checkpoint.dir")):
        shared.shared_dir(Session())


def test_very_many_tiny_pieces_are_dealt_into_bounded_problems(spark, monkeypatch):
    monkeypatch.setattr(packing, "PROBLEM_PIECES", 500)
    pieces = spark.range(6000).select("id", (F.col("id") % 3 + 1).alias("length"))
    solved = packing._solve(pieces.withColumnRenamed("id", "pid"), 4096).groupBy("problem").agg(F.count("*").alias("n"), F.max("bin").alias("bins")).collect()
    assert len(solved) == 12 and sum(r["n"] for r in solved) == 6000 and max(r["n"] for r in solved) < 700


def test_centres_do_not_depend_on_the_block(monkeypatch):
    rows = np.random.default_rng(3).normal(size=(3000, 8))
    want = vector_search.kmeans(rows, 20, np.random.default_rng(1))
    monkeypatch.setattr(vector_search, "KMEANS_BLOCK", 7)
    assert np.allclose(vector_search.kmeans(rows, 20, np.random.default_rng(1)), want)
