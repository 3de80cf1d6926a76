"""Exact deduplication and fill-in-the-middle on awkward rows, against plain programs."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import exact_dedup, queries
from ledgerspark.llm import fill_in_middle as fim

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, n string, form string, output string, row string, class string, member string"
LONG = "Ünï 🎈 word\n" * 40_000


def lower(text):
    return (text or "").encode().lower()


def awkward(spark):
    texts = [None, "", "Same Text", "same text", "SAME TEXT", "sAmé", "samÉ", LONG, LONG.upper(), "a", "<P>", "tab\t", "\x1e0\x1f1 \x1e\x1f🎈", "\x1f", LONG]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(3, "same text"), (3, "same text"), (99, None)]
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], WIDE), rows


def copies(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[lower(text)].append(key)
    best = {t: max(ids, key=lambda k: (k is not None, k or 0)) for t, ids in groups.items()}
    return sorted(((k, best[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for k, t in rows), key=repr)


def marked(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.mark_copies(df).collect()), key=repr)


def check_kept(df, rows):
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    out = [(r["doc_id"], r["text"]) for r in kept.collect()]
    keep = {sha: k for _, k, _, sha in copies(rows)}
    assert len(out) == len(keep) == len({lower(t) for _, t in out})
    assert all(keep[hashlib.sha256(lower(t)).hexdigest()] == k for k, t in out)
    assert all(r in rows for r in out)


def test_copies_in_awkward_rows(spark):
    df, rows = awkward(spark)
    df = df.repartition(4)
    assert marked(df) == copies(rows)
    check_kept(df, rows)


def test_buckets_that_overflow_are_dealt_again(spark, monkeypatch):
    """Tables of a few texts, salted groups of a few records: several levels, same rows."""
    rng = random.Random(4)
    rows = [(i, f"text number {rng.randrange(900)} " * rng.randrange(1, 9)) for i in range(2000)] + [(5000 + i, "The one of which a third are copies. " * 30) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", 9000)
    monkeypatch.setattr(exact_dedup, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(exact_dedup, "MEET", 4)
    levels, dealt = [], exact_dedup.combine_dealt
    monkeypatch.setattr(exact_dedup, "combine_dealt", lambda records, level, buckets: levels.append((level, records.where("salt IS NOT NULL").count())) or dealt(records, level, buckets))
    assert marked(df) == copies(rows)
    assert len(levels) >= 3 and levels[0][1] > 4
    check_kept(df, rows)


def test_table_compares_contents_where_digests_agree():
    table = exact_dedup.ContentTable()
    same = b"\0" * 32
    assert [table.place(same, str(i % 40).encode()) for i in range(80)] == [*range(40), *range(40)]
    places = [table.place(hashlib.sha256(str(i).encode()).digest(), str(i).encode()) for i in range(5000)]
    assert len(set(places)) == 5000 and places == [table.place(hashlib.sha256(str(i).encode()).digest(), str(i).encode()) for i in range(5000)]


def test_no_documents_to_deduplicate(spark):
    docs = queries.read(spark, SF, "documents").where(F.lit(False))
    assert exact_dedup.mark_copies(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def middle(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def cut(df, **how):
    out = fim.fill_in_middle(df, **how)
    return out, [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.rebuild(F.col("output"), F.col("form")).alias("restored")).collect()]


def test_middles_of_awkward_texts(spark):
    df, rows = awkward(spark)
    rows = rows + [(1000 + i, f"\x1f\x1e1{'é🎈<' * (i % 7)}\x1e\x1e<P <S M>"[: i % 19]) for i in range(300)]
    df = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], WIDE)
    out, got = cut(df)
    assert sorted(got, key=repr) == sorted(((k, *middle(k, t), t or "") for k, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert out.columns == ["doc_id", "text", "row", "class", "member", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert cut(df.where(F.lit(False)))[1] == []


@pytest.mark.parametrize("unit", [fim.WORDS, fim.LINES])
def test_other_units_are_cut_between_units(spark, unit):
    df = spark.createDataFrame([(i, "One two\n\n three \x1ffour\x1e five\nsix") for i in range(60)], "doc_id long, text string")
    out, got = cut(df, unit=unit, seed=3, plain_percent=0, spm_percent=50)
    assert all(r[6] == "One two\n\n three \x1ffour\x1e five\nsix" and r[2] != "plain" for r in got)
    ends = {r[3] for r in got} | {r[3] + r[4] for r in got}
    assert len({r[1] for r in got}) == 1 and 2 < len(ends) <= got[0][1] + 1 and ends <= {i for i in range(40)}


def test_nothing_is_shuffled_and_no_python_runs(spark):
    plan = queries.op11_fill_in_middle(spark, SF)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
