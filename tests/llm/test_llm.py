"""The text and vector operators against brute force, the tokenizers library and awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, labelled, licenses, line_dedup, ngram_join, packing, quality, queries, token_files, toxicity, vector_search

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, _text string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(str(queries.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, very long and repeated texts, and columns whose names could clash."""
    base = "one two three four five six seven eight nine ten"
    texts = [None, "", " \n\t", base, base, base.upper(), LONG, LONG + " tail", "ab", "Ünïcode naïve café x", "a\r\nb\n\nshared line of twenty chars\nc", "  SHARED line of twenty chars \nd", "shared line of twenty chars"]
    rows = [(i, t, None if i % 2 else "en", None, None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], DOCUMENTS)


def empty(df):
    return df.where(F.lit(False))


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_components(rows):
    sets, parent = [(k, shingles(t)) for k, t in rows], {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {k: (len(x), find(k)) for k, x in sets}


def components(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_ngram_join_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert components(ngram_join.similar_components(docs)) == brute_components([tuple(r) for r in docs.collect()])


def test_ngram_join_finds_all_links_of_a_large_group(spark):
    """Near copies around the threshold, enough for long posting lists and pooled blocks."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(260):
        words = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            words[at] = f"v{rng.integers(0, 6)}"
        rows.append((k, " ".join(words)))
    got = components(ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_components(rows)


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64)]))
        if not len(b):
            continue
        same = len(np.intersect1d(a, b))
        i, _ = ngram_join.close_sketches([ngram_join.sketch(a)], [ngram_join.sketch(b)], np.array([len(a)]), np.array([len(b)]), 75)
        assert len(i) or 100 * same < 75 * (len(a) + len(b) - same)


def test_ngram_join_awkward_rows(awkward):
    got = [tuple(r) for r in ngram_join.similar_components(awkward).select("doc_id", "n_shingles", "component_id").collect()]
    want = brute_components([(r["doc_id"], r["text"]) for r in awkward.dropDuplicates(["doc_id"]).collect()])
    assert len(got) == awkward.count() and all(want[k] == (n, c) for k, n, c in got)
    assert ngram_join.similar_components(empty(awkward)).count() == 0
    kept = ngram_join.keep_first(awkward)
    assert kept.columns == awkward.columns and {5, 7}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(df).collect()}
    assert got == {None: None, 1: 1, 2: 2}
    assert line_dedup.dedup_lines(df).count() == 3


def test_bpe_is_the_library(spark, awkward, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(awkward.select("doc_id", "text"))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(docs, queries.TOKENIZER).collect())
    want, sha = [], lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode_decode(empty(awkward), queries.TOKENIZER).count() == 0


def check_packing(rows, texts, tokenizer):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert pieces.keys() == texts.keys()
    for k, ps in pieces.items():
        ids = tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [1]
        for n, p in enumerate(sorted(ps, key=lambda p: p["piece"])):
            part = ids[n * 4096 : (n + 1) * 4096]
            assert (p["piece"], p["start"], p["length"], p["ids_crc32"]) == (n, n * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert len(ps) == -(-len(ids) // 4096)
    return len(bins), sum(r["length"] for r in rows)


def test_packing_is_whole_and_dense(spark, awkward, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    n, total = check_packing(packing.pack_documents(docs, queries.TOKENIZER).collect(), texts, tokenizer)
    assert n <= -(-total // 4096) + 2
    one = awkward.dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(one, queries.TOKENIZER).collect(), {r["doc_id"]: r["text"] for r in one.collect()}, tokenizer)
    assert packing.pack_documents(empty(awkward), queries.TOKENIZER).count() == 0


def test_packing_does_not_depend_on_how_a_scan_is_split(spark, tmp_path, monkeypatch):
    """As if executors were lost between two plans: the stored pieces are split otherwise after the first solve."""
    rng = np.random.default_rng(9)
    pieces = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(50, 4097, 4000))]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    for part in range(8):
        spark.createDataFrame(pieces[part::8], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    solve, keys = packing._solve, ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def solved(*args):
        out = solve(*args)
        for k in keys:
            spark.conf.set(k, "1000b")
        return out

    monkeypatch.setattr(packing, "_solve", solved)
    try:
        rows = packing.pack(spark.read.parquet(f"{tmp_path}/p")).collect()
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in rows) == list(range(4000))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 4096


def brute_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(k)
    gone = lambda k, x: len(x) >= 20 and len(holders[x]) >= 3 and k != max(holders[x])
    return {k: "\n".join(x for x in (t or "").split("\n") if not gone(k, key(x))) for k, t in rows}


def test_line_dedup(awkward):
    one = awkward.dropDuplicates(["doc_id"])
    out = line_dedup.dedup_lines(one)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines([(r["doc_id"], r["text"]) for r in one.collect()])
    assert {*awkward.columns} <= {*out.columns}
    assert line_dedup.dedup_lines(awkward).count() == awkward.count()
    assert line_dedup.dedup_lines(empty(awkward)).count() == 0


def vectors(spark, n=600, size=16):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, size))
    rows = [(i, (middle[i % 12] + rng.normal(size=size) * 0.4).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [float("nan")] * size), (n + 2, rows[0][1]), (n + 3, [None, *rows[1][1][1:]]), (n + 4, [float("inf")] * size)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_exact_top_k(spark):
    rows, df = vectors(spark)
    good = {k: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (k for k in good if k % 50 == 0):
        ranked = sorted((-int(good[q] @ v), k) for k, v in good.items() if k != q)[:5]
        want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(ranked)}
    got = vector_search.exact_top_k(df).select("query_id", "rank", "vec_id", "score").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert vector_search.exact_top_k(df.where(F.lit(False))).count() == 0
    assert vector_search.exact_top_k(df.where("vec_id <= 2")).count() == 2


def test_approximate_top_k_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in rows.items()}
    got = defaultdict(list)
    for r in vector_search.approximate_top_k(df).orderBy("query_id", "rank").collect():
        assert abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-9
        got[r["query_id"]].append(r["vec_id"])
    hits = []
    for q in (k for k in rows if k % 50 == 0):
        want = sorted(((-unit[q] @ v, k) for k, v in unit.items() if k != q))[:5]
        assert len(got[q]) == 5
        hits.append(len({k for _, k in want} & {*got[q]}) / 5)
    assert np.mean(hits) >= 0.9
    rows, odd = vectors(spark)
    assert vector_search.approximate_top_k(odd).count() == 5 * 12
    assert vector_search.approximate_top_k(odd.where(F.lit(False))).count() == 0


def test_approximate_top_k_recall_in_a_group_of_near_copies(spark):
    """Near copies share their codes, far more of them than any short list of candidates."""
    rng = np.random.default_rng(4)
    near = rng.normal(size=64) + 0.02 * rng.normal(size=(2000, 64))
    rows = np.concatenate([near, rng.normal(size=(1000, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in vector_search.approximate_top_k(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    scores = unit @ unit.T
    np.fill_diagonal(scores, -np.inf)
    asked = range(0, 2000, 50)
    assert np.mean([len(got[q] & {*np.argsort(-scores[q])[:5].tolist()}) / 5 for q in asked]) >= 0.9


def test_approximate_top_k_fills_small_lists(spark, monkeypatch):
    """A list of one row and one that is empty: a query probes on until it has seen k other rows."""
    rng = np.random.default_rng(3)
    fit = vector_search.IvfPq.__init__

    def fitted(self, *args):
        fit(self, *args)
        self.probes = 1

    monkeypatch.setattr(vector_search.IvfPq, "__init__", fitted)
    rows = [(0, [-1.0, *[0.0] * 7]), (50, [-1.0, *[0.1] * 7]), (50, [-1.0, *[0.1] * 7])]
    rows += [(i, (np.eye(8)[i % 7 + 1] + 0.01 * rng.normal(size=8)).tolist()) for i in range(1, 3000) if i != 50]
    got = vector_search.approximate_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).groupBy("query_id").count().collect()
    assert len(got) == 60 and all(r["count"] == 5 for r in got)


def test_empty_lists_use_up_no_probe():
    model = vector_search.IvfPq(np.eye(8), 8, 2, 5)
    model.probes = 2
    row, cell = vector_search.probed(model, np.ones((1, 8)), np.array([0, 0, 1, 1, 9, 1, 0, 1]), np.array([6]))
    assert (sorted(cell.tolist())) == [2, 3, 4]


def test_rerank_is_exact_in_a_chunk():
    rng = np.random.default_rng(6)
    rows = np.concatenate([rng.normal(size=16) + 0.01 * rng.normal(size=(700, 16)), rng.normal(size=(300, 16))])
    rows = np.concatenate([rows, rows[:50]])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    model, ids = vector_search.IvfPq(rows, 1, 4, 5), rng.permutation(len(rows))
    codes = model.codes(rows, np.zeros(len(rows), int))
    row, col, score = vector_search.rerank(model, 0, rows[::5], ids[::5], rows, ids, codes, np.full(len(rows[::5]), -np.inf), 5)
    for n, q in enumerate(rows[::5]):
        want = sorted((-s, i) for s, i in zip((q * rows).sum(1).tolist(), ids.tolist()) if i != ids[5 * n])[:5]
        assert [(-s, i) for s, i in zip(score[row == n].tolist(), ids[col[row == n]].tolist())] == want


def held_out_accuracy(spark, name, label):
    out = queries.queries()[name](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").where(F.col(label).isNotNull()).select("predicted", label, "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return rows, np.mean([r["predicted"] == r[label] for r in rows])


def test_toxicity_held_out(spark):
    rows, accuracy = held_out_accuracy(spark, "op1_toxicity", "toxic")
    assert accuracy >= 0.9 and not any(r["predicted"] for r in rows if not r["toxic"])
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) >= 0.7  # a model that catches nothing is nine tenths right


def test_quality_rules_do_not_depend_on_row_order(spark):
    docs, labels = queries.read(spark, SF, "documents"), queries.read(spark, SF, "labels")
    fitted = [quality.fit_quality(d, labels, trees=3, depth=2) for d in (docs, docs.repartition(5, "source").orderBy(F.desc("doc_id")))]
    assert fitted[0].rules == fitted[1].rules
    assert np.allclose(fitted[0].weights, fitted[1].weights)


def test_quality_held_out(spark):
    assert held_out_accuracy(spark, "op10_quality", "quality")[1] >= 0.85


def test_segments_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        scores = rng.integers(-3, 4, 12).astype(float).tolist()
        found = toxicity.maximal_segments(scores)
        best = max([sum(scores[i:j]) for i in range(12) for j in range(i + 1, 13)])
        if best > 0:
            assert max(s for *_, s in found) == pytest.approx(best)
        assert all(sum(scores[a:b]) == pytest.approx(s) and s > 0 for a, b, s in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_classifiers_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    for fit, score, column in ((quality.fit_quality, quality.score_quality, "quality_score"), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic_score")):
        for known in (labels, empty(labels)):
            model = fit(awkward, known)
            out = score(awkward, model)
            assert {*awkward.columns} <= {*out.columns}
            assert all(0 <= r[column] <= 1 for r in out.collect()) and out.count() == awkward.count()
            assert score(empty(awkward), model).count() == 0
    assert labelled.held_out(F.col("doc_id")) is not None


def test_licenses(spark, awkward):
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny"), (2, "released under THE mit license"), (3, "nothing of the kind is here"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["n_matches"]) for r in licenses.scan_licenses(df).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[3] == got[4] == (None, 0)
    assert licenses.scan_licenses(awkward).where("n_matches > 0").count() == 0
    assert licenses.scan_licenses(empty(awkward)).count() == 0


def test_licenses_inside_longer_texts():
    texts = {n: max((x for m, x in licenses.TEMPLATES if m == n), key=len) for n, _ in licenses.TEMPLATES}
    other = " ".join(f"word{i}" for i in range(200))
    gpl = next(x for n, x in licenses.TEMPLATES if n == "GPL-3.0" and x.startswith("This program"))
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    found = lambda text: [x[3] for x in scanner.scan(text)]
    assert found("All the code here is Released under the MIT License, as far as anyone knows today.") == ["MIT"]
    assert found(gpl.replace("This program is distributed", "\n\nThis program is distributed") + "\n\n" + other) == ["GPL-3.0"]
    assert found("Copyright (c) 2020 A. Author\n\n" + texts["BSD-2-Clause"] + "\n" + other) == ["BSD-2-Clause"]
    assert found(other + "\n" + texts["BSD-3-Clause"].replace("copyright holder nor", "University nor") + other) == ["BSD-3-Clause"]
    for name in ("Apache-2.0", "MIT", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"):
        assert found(f"{other}\n{texts[name]}\n{other}") == [name], name
    assert found(other) == []


def test_license_windows_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(300):
        template = " ".join(rng.choice(list("abcd"), rng.integers(3, 8)))
        scanner, own = licenses.Scanner([("x", template)], 0.8), len(template.split())
        lines = [" ".join(rng.choice(list("abcdefg"), rng.integers(0, 7))) for _ in range(4)]
        words = " ".join(lines).split()
        sets = lambda w: set(zip(w, w[1:]))
        dice = lambda w: 2 * len(sets(w) & sets(template.split())) / max(1, len(sets(w)) + len(sets(template.split())))
        windows = [words[i : i + own] for i in range(len(words) - own + 1)]
        got = scanner.scan("\n".join(lines))
        blank = [i for i, x in enumerate(lines) if not x] + [4]
        paragraphs = [" ".join(lines[a + 1 : b]).split() for a, b in zip([-1, *blank], blank)]
        best = max([dice(w) for w in [*windows, words, *paragraphs, *[x.split() for x in lines]]])
        assert bool(got) == (best >= 0.8) and all(0.8 <= x[2] <= best + 1e-12 for x in got)


def test_matches_do_not_overlap_and_the_best_unit_is_reported(spark):
    """Matches by their own definition: taken by weight, none over another; the best is that of the largest coefficient."""
    mit, short = "Released under the MIT License.", "Licensed under the MIT License."
    texts = [f"{mit}\n\nx y z\n{short}", f"a b {mit} {mit} c", f"{short} {mit}", mit + " and more words behind it than it has itself, so no line", "x\n" * 50 + short, "", None]
    got = {r["doc_id"]: (r["n_matches"], r["unit"], r["line"], r["dice"]) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(7)] == [2, 2, 2, 1, 1, 0, 0]
    assert got[0][1:] == ("line", 0, 1.0) and got[3][1:] == ("window", 0, 1.0) and got[4][1:] == ("line", 50, 1.0) and got[6][1:] == (None, None, None)
    very_long = "word " * 200_000 + "\n" + mit
    assert licenses.scan_licenses(spark.createDataFrame([(1, very_long)], "doc_id long, text string")).first()["n_matches"] == 1


def test_token_counts(spark, awkward, tokenizer, tmp_path):
    awkward.coalesce(2).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_files.count_documents(docs, queries.TOKENIZER).collect())
    assert got == sorted((r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())


def test_token_counts_do_not_depend_on_how_a_scan_is_split(spark, tokenizer, tmp_path, monkeypatch):
    """As if executors were lost between two plans: the documents are split otherwise once the files are written."""
    texts = {i: "word " * (i % 50) for i in range(400)}
    for part in range(8):
        spark.createDataFrame([(i, t) for i, t in texts.items() if i % 8 == part], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    write, keys = token_files.write_token_files, ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def written(*args):
        out = write(*args)
        for k in keys:
            spark.conf.set(k, "1000b")
        return out

    monkeypatch.setattr(token_files, "write_token_files", written)
    try:
        got = sorted((r["doc_id"], r["n_tokens"]) for r in token_files.count_documents(spark.read.parquet(f"{tmp_path}/d"), queries.TOKENIZER).collect())
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)
    assert got == [(i, len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in sorted(texts.items())]


def test_token_counts_without_their_document_fail(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "a"), (2, "a b"), (3, None)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in token_files.count_documents(docs, queries.TOKENIZER).collect()} == {None, 2, 3}
    assert token_files.count_documents(empty(docs), queries.TOKENIZER).count() == 0
    count = token_files.count_tokens
    monkeypatch.setattr(token_files, "count_tokens", lambda *args, **named: count(*args, **named).where("ordinal <> 1"))
    with pytest.raises(Exception, match="do not match"):
        token_files.count_documents(docs, queries.TOKENIZER).collect()


def test_blocks_are_stitched(spark, tmp_path):
    ids = np.array([5, 6, 65536, 65536, 1, 2, 3, 4, 5, 65536, 9], "<u4")
    (tmp_path / "part-0").write_bytes(ids.tobytes())
    (tmp_path / "part-1").write_bytes(b"")
    for block in (1, 2, 3, 100):
        got = sorted((r["ordinal"], r["n_tokens"], r["finished"]) for r in token_files.count_tokens(spark, str(tmp_path), end=65536, block=block, width=4).collect())
        assert got == [(0, 2, True), (1, 0, True), (2, 5, True), (3, 1, False)]


def test_large_flat_files_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(7)
    want = []
    for name, n in (("a", 4000), ("b", 999), ("c", 0)):
        ids = np.where(rng.random(n) < 0.01, 65536, rng.integers(0, 60000, n)).astype("<u4")
        (tmp_path / name).write_bytes(ids.tobytes())
        cut = np.flatnonzero(ids == 65536)
        want += [(name, k, int(x), True) for k, x in enumerate(np.diff(cut, prepend=-1) - 1)]
        if n and cut[-1] < n - 1:
            want.append((name, len(cut), int(n - 1 - cut[-1]), False))
    conf, key = spark._jsc.hadoopConfiguration(), "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(key, "1000")
    try:
        for block, whole in ((64, 0), (1, 0), (50, 4000)):
            out = token_files.count_tokens(spark, str(tmp_path), end=65536, block=block, whole=whole, width=4)
            assert sorted((r["file"].rsplit("/", 1)[1], r["ordinal"], r["n_tokens"], r["finished"]) for r in out.collect()) == sorted(want)
    finally:
        conf.unset(key)


def test_padded_token_files(spark, tokenizer, monkeypatch):
    texts = {i: "word " * (i % 30) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(token_files, "WHOLE_BYTES", 0)
    folder = token_files.write_token_files(docs, queries.TOKENIZER)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(folder).select("length").collect()]
    counts = token_files.count_tokens(spark, folder, pad=token_files.pad_of(2), whole=0).collect()
    assert len(counts) == 300 and all(r["finished"] for r in counts)
    assert sum(r["n_tokens"] for r in counts) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts.values())
    assert len(sizes) == 2 and all(n % (2 * token_files.BLOCK_TOKENS) == 0 for n in sizes)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns), name
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() <= docs.count() and packed.count() > 0
