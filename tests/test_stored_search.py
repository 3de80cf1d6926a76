"""Sorted copies, the segmented index and the trigram index against plain filters."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import substring_index, text_index
from ledgerspark.plans import sorted_copy
from ledgerspark.plans.stored import shared_folder

WORDS = "alpha beta gamma delta license error the a of ring".split()


def texts(n, step=7):
    return {i: " ".join(WORDS[(i * step + j * j) % 10] for j in range(i % 13)) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "id long, text string")


def postings(rows, terms):
    out = set()
    for k, t in rows.items():
        words = Counter(re.findall(r"\w+", (t or "").lower()))
        out |= {(w, k, n, sum(words.values())) for w, n in words.items() if w in terms}
    return out


def found(spark, folder, terms):
    return {tuple(r) for r in text_index.hits(spark, folder, terms).select("term", "key", "frequency", "size").collect()}


def size_of(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder.removeprefix("file:")) for f in names)


def test_index_follows_its_documents(spark):
    rows, folder = texts(3000), shared_folder(spark, "index")
    text_index.build_index(frame(spark, rows), "id", ["text"], folder)
    terms = ["License", "ring", "nowhere"]
    assert found(spark, folder, terms) == postings(rows, {"license", "ring"})
    whole = size_of(folder)
    for k in range(0, 3000, 100):
        rows[k] = f"ring {k} license license"
    for k in range(50, 3000, 100):
        del rows[k]
    rows |= {5000: "new ring", 5001: None}
    assert text_index.update_index(frame(spark, rows), "id", ["text"], folder)
    assert found(spark, folder, terms) == postings(rows, {"license", "ring"})
    assert len(text_index.segments(spark, folder)) == 2 and size_of(folder) - whole < whole / 3
    assert not text_index.update_index(frame(spark, rows), "id", ["text"], folder)  # nothing differs, nothing is written
    rows[50] = "back again: ring"  # a key that was gone
    text_index.update_index(frame(spark, rows), "id", ["text"], folder)
    fresh = shared_folder(spark, "index")
    text_index.build_index(frame(spark, rows), "id", ["text"], fresh)
    score = lambda f: {r["key"]: round(r["score"], 9) for r in text_index.ranked(spark, f, ["ring", "license"]).collect()}
    assert found(spark, folder, terms) == postings(rows, {"license", "ring"}) and score(folder) == score(fresh)
    text_index.merge_segments(spark, folder)
    assert len(text_index.segments(spark, folder)) == 1
    assert found(spark, folder, terms) == postings(rows, {"license", "ring"}) and score(folder) == score(fresh)
    prefix = {r["key"] for r in text_index.hits(spark, folder, ["lic", "bet"], prefix=True).collect()}
    assert prefix == {k for k, t in rows.items() if re.search(r"\b(lic|bet)", t or "")}


def test_an_update_that_breaks_off_changes_nothing(spark, monkeypatch):
    rows, folder = texts(100), shared_folder(spark, "index")
    text_index.build_index(frame(spark, rows), "id", ["text"], folder)

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(text_index, "_listed", broken)
    with pytest.raises(RuntimeError):
        text_index.update_index(frame(spark, {1: "ring"}), "id", ["text"], folder)
    assert found(spark, folder, ["ring"]) == postings(rows, {"ring"})


def test_stored_index_sees_a_rewritten_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    frame(spark, texts(60)).write.parquet(path)
    first = text_index.stored_index(spark.read.parquet(path), path, "id", ["text"])
    rows = texts(60, 3)
    frame(spark, rows).coalesce(1).write.mode("overwrite").parquet(path)
    folder = text_index.stored_index(spark.read.parquet(path), path, "id", ["text"])
    assert folder == first and found(spark, folder, ["ring"]) == postings(rows, {"ring"})


def test_deep_pages_open_few_files(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).alias("k"), F.col("id").alias("v"))
    folder = shared_folder(spark, "sorted")
    sorted_copy.write_sorted(df, ["k"], folder, rows_per_file=300)
    want = sorted(r["k"] for r in df.collect())
    for page, size in ((0, 7), (41, 100), (49, 100), (60, 100), (3, 1000)):
        got = sorted_copy.read_page(spark, folder, ["k"], page, size)
        assert [r["k"] for r in got.collect()] == want[page * size : (page + 1) * size]
        assert page == 60 or len(got.inputFiles()) <= size // 300 + 3
    assert {r["k"] for r in sorted_copy.read_values(spark, folder, "k", [5, 4999, -1]).collect()} == {5, 4999} & set(want)


@pytest.mark.parametrize("part", ["Ring of", "a", "eta g", "nowhere at all", "éÜ r", "ING", ""])
def test_substrings_by_trigrams(spark, part):
    rows = texts(400) | {900: "ÉÜ ring OF", 901: None, 902: "", 903: "line\nof ring of"}
    folder = shared_folder(spark, "substrings")
    substring_index.build_substring_index(frame(spark, rows), "id", "text", folder, rows_per_file=50)
    out = substring_index.rows_with(spark, folder, "id", "text", part)
    assert {r["id"] for r in out.collect()} == {k for k, t in rows.items() if t is not None and part.lower() in t.lower()}
    if part == "éÜ r":
        assert len([f for f in out.inputFiles() if "/rows/" in f]) == 1


def test_typed_search_reaches_the_scan(spark):
    from ledgerspark.operators.searches import where_search
    from ledgerspark.plans.facts import facts

    out = where_search(facts(spark, "/root/testdata/sf0.001", ["order_key", "appropriation_code", "amount"]), "approp:BUILDING amount>=5000", [], {"appropriation_code": ["BUILDING"]})
    assert "EqualTo(c_mktsegment,BUILDING)" in out._jdf.queryExecution().toString()


def test_indexes_are_built_with_one_shuffle(spark, tmp_path, monkeypatch):
    """What is sorted comes from stored rows, whose words are counted already: nothing is grouped before."""
    from ledgerspark.functions.expressions import counted
    from ledgerspark.operators import substring_index, text_index

    words = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "w array<string>").select(counted(F.col("w")).alias("c"))
    assert [r["c"] and [tuple(x) for x in r["c"]] for r in words.collect()] == [[("a", 1), ("b", 2)], [], None]
    sorted_ = []
    for module in (substring_index, text_index):
        plain = module.write_sorted
        monkeypatch.setattr(module, "write_sorted", lambda df, keys, *more, plain=plain: (sorted_.append((keys, df)), plain(df, keys, *more))[1])
    docs = spark.createDataFrame([(1, "b a b ab"), (2, None), (3, "ab")], "k long, t string")
    text_index.build_index(docs, "k", ["t"], f"{tmp_path}/text")
    substring_index.build_substring_index(docs, "k", "t", f"{tmp_path}/sub")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for keys, df in sorted_ if len(keys) == 2]
    assert len(plans) == 2 and not any("Aggregate" in p or "regexp_extract_all" in p for p in plans)
    assert sorted(map(tuple, text_index.hits(spark, f"{tmp_path}/text", ["b", "ab"]).collect())) == [("ab", 1, 1, 4), ("ab", 3, 1, 1), ("b", 1, 2, 4)]
