"""Near titles, connected groups and fuzzy terms against plain loops."""

import random

from pyspark.sql import functions as F

from ledgerspark.operators import near_text


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    shorter = min(len(a), len(b))
    return bool(shorter) and (a.startswith(b) or b.startswith(a) or edits(a, b) / shorter < 0.2)


def greedy(rows):
    clusters, out = {}, []
    for key, n, title in sorted(rows, key=lambda r: r[1]):
        mine = clusters.setdefault(key, [])
        hit = next((c for c in mine if alike((title or "").lower(), c["name"].lower())), None)
        if hit is None:
            mine.append(hit := {"name": title or ""})
        elif len(title) > len(hit["name"]):
            hit["name"] = title
        out.append((n, hit))
    return [(n, c["name"]) for n, c in out]


def mutated(rng, text):
    for _ in range(rng.randrange(4)):
        at, how = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:at] + ("" if how == 0 else rng.choice("abcxyz ")) + text[at + (how != 1) :]
    return text


def rows_of(seed):
    """Chains of edits, prefixes, other case, order that matters, empty and null titles, a hot key."""
    rng = random.Random(seed)
    bases = ["advanced radar system", "mk4a", "tactical missile programme of the second kind", "x", "radio", "Ünïted nätions programme"]
    out, made = [], list(bases)
    for n in range(260):
        base = rng.choice(made)
        title = base[: rng.randrange(1, len(base) + 1)] if rng.random() < 0.15 else mutated(rng, base)
        title = title.upper() if rng.random() < 0.1 else title
        if title:
            made.append(title)
        out.append((rng.choice(["p", "p", "p", "q", None]), n, rng.choice([title] * 30 + ["", None])))
    return out


def test_titles_join_clusters_as_one_by_one(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        df = spark.createDataFrame([(*r, "clash") for r in rows], "pe string, n int, title string, part string").drop("part").repartition(3)
        out = near_text.same_titles(df, ["pe"], "title", ["n"])
        assert out.columns == ["pe", "n", "title", "cluster"]
        got, want = sorted((r["n"], r["cluster"]) for r in out.collect()), sorted(greedy(rows))
        assert got == want
        assert len({c for _, c in want}) < 200


def test_all_near_titles_meet_and_few_others(spark):
    rows = [(i, t) for i, t in enumerate(sorted({t.lower() for _, _, t in rows_of(3) if t}))]
    df = spark.createDataFrame(rows, "node long, title string")
    got = {(r["a"], r["b"]) for r in near_text.alike_titles(df, [], "title", "node").collect()}
    assert got == {(i, j) for i, a in rows for j, b in rows if i != j and alike(a, b)}


def test_parts_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(300, 400), (400, 350), (500, 501), (501, 502), (502, 500)]
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "a long, b long")
    got = {r["node"]: r["part"] for r in near_text.connected(both).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 350: 300, 400: 300, 500: 500, 501: 500, 502: 500}
    assert near_text.connected(both.where(F.lit(False))).count() == 0


def test_fuzzy_terms_are_all_within_budget(spark):
    rng = random.Random(5)
    words = ["radar", "missile", "tactical", "programme", "ant", "ab", "abcd", "Ünïted"]
    terms = sorted({mutated(rng, rng.choice(words)) for _ in range(900)} | {"ab", "abc", ""})
    out = near_text.fuzzy_terms(spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string"), spark.createDataFrame([(w,) for w in words], "word string"))
    got = {tuple(r) for r in out.select("word", "term", "edits").collect()}
    budget = lambda w: 1 if len(w) <= 4 else 2 if len(w) <= 8 else 3
    assert got == {(w, t, edits(w, t)) for w in words for t in terms if min(len(w), len(t)) >= 3 and edits(w, t) <= budget(w)}
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
