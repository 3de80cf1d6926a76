"""Operators on small rows: nulls, ties, and what a table scan would not show."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import expressions as X
from ledgerspark.functions import text as T
from ledgerspark.operators import aggregates, filters, quality_checks, relations, search
from ledgerspark.queries import QUERIES
from ledgerspark.sources.files import read_staged, write_staged
from ledgerspark.streaming.incremental import changed_files, ingest_new_files


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_fiscal_year(spark):
    df = spark.createDataFrame([("FY 2026",), ("FY2026",), ("2026",), ("FY26",), ("details",), ("3026",), (None,)], "c string")
    assert values(df, X.fiscal_year(F.col("c"))) == ["2026"] * 4 + [None] * 3


def test_amounts(spark):
    df = spark.createDataFrame([("$1,234.5",), ("-",), ("TBD",), (None,)], "c string")
    assert values(df, X.lenient_amount(F.col("c"))) == [1234.5, 0.0, 0.0, 0.0]
    assert values(df, X.amount_token(F.col("c"))) == [1234.5, None, None, None]


def test_change_percent(spark):
    df = spark.createDataFrame([(110.0, 100.0), (5.0, 0.0), (None, 4.0), (-50.0, -100.0)], "a double, b double")
    assert values(df, X.change_percent(F.col("a"), F.col("b"))) == [10.0, None, None, 50.0]


def test_pe_numbers_keep_order_once(spark):
    df = spark.createDataFrame([("see 0602120A, 0601102F and 0602120A",)], "c string")
    assert values(df, X.pe_numbers(F.col("c"))) == [["0602120A", "0601102F"]]


def test_empty_ids_keep_nothing(spark):
    df = spark.createDataFrame([(1, "2026", 1.0)], "order_key long, fiscal_year string, amount double")
    assert filters.where_lines(df, fiscal_year=[]).count() == 1
    assert filters.where_lines(df, ids=[]).count() == 0
    with pytest.raises(ValueError):
        filters.where_lines(df, colour=["red"])


def test_matching_either_and_fill(spark):
    left = spark.createDataFrame([("A",), ("Army",), ("X",)], "k string")
    right = spark.createDataFrame([("A", "Army")], "code string, name string")
    assert sorted(values(relations.matching_either(left, right, "k", "code", "name"), "k")) == ["A", "Army"]
    rows = spark.createDataFrame([("t", "p"), ("t", None), ("u", "p"), ("u", "q"), ("u", None)], "t string, pe string")
    assert sorted(map(tuple, relations.fill_from_unambiguous(rows, ["t"], "pe").select("t", "pe").collect()), key=repr) == [("t", "p"), ("t", "p"), ("u", "p"), ("u", "q"), ("u", None)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, source_file string")
    new = spark.createDataFrame([(2, "c")], "k int, source_file string")
    assert sorted(relations.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_missing_years(spark):
    df = spark.createDataFrame([("a", "2025"), ("a", "2026"), ("b", "2026")], "org string, fiscal_year string")
    assert quality_checks.missing_years(df, "org").collect() == [("b", "2025")]


def test_bm25_prefers_short_texts(spark):
    df = spark.createDataFrame([(1, "radar"), (2, "radar and more words than that"), (3, None), (4, "none here"), (5, "nor here")], "id int, t string")
    got = [r["id"] for r in search.bm25(df, "id", "t", ["Radar"]).orderBy("score").collect()]
    assert got == [1, 2]


def test_staged_columns_merge(spark, tmp_path):
    write_staged(spark.createDataFrame([("2025", 1.0)], "fiscal_year string, fy2025 double"), f"{tmp_path}/t")
    spark.createDataFrame([(2.0,)], "fy2026 double").write.parquet(f"{tmp_path}/t/fiscal_year=2026")
    out = read_staged(spark, f"{tmp_path}/t")
    assert sorted(out.columns) == ["fiscal_year", "fy2025", "fy2026"] and out.count() == 2


def test_ingestion_runs_twice_without_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest_new_files(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_changed_files(spark):
    have = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size int, mtime int")
    found = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], "path string, size int, mtime int")
    assert sorted(values(changed_files(have, found), "path")) == ["b", "c"]


def test_normalized_names_and_codes(spark):

    rows = [("AF", "Air Force", "Air Force"), ("usn", "usn", "Navy"), ("DSS", "DSS", "DCSA"), ("Unknown Org", "Unknown Org", "Unknown Org"), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "c string")
    assert [tuple(r) for r in df.select("c", T.organization(F.col("c")), T.organization_loose(F.col("c"))).collect()] == rows
    titles = {
        "RDT&E, Army": ("RDTE", "RDT&E, Army"),
        "2035 Aircraft Procurement, Army": ("2035", "Aircraft Procurement, Army"),
        "Shipbuilding & Conversion": ("SCN", "Shipbuilding & Conversion"),
        "Odd title": (None, "Odd title"),
        " ": None,
    }
    got = spark.createDataFrame([(t,) for t in titles], "c string").select("c", T.appropriation(F.col("c")).alias("a")).collect()
    assert {r["c"]: tuple(r["a"]) if r["a"] else None for r in got} == titles


def test_project_titles(spark):

    titles = {
        "1662: F/A-18 Improvement 4,439.845 101.694 -": ("1662", "F/A-18 Improvement"),
        "E1662 F/A-18 Improvements": ("1662", "F/A-18 Improvements"),
        "Total PE": None,
        "D549 2.75 Inch Anti-Air TD": ("D549", "2.75 Inch Anti-Air TD"),
        "No code (GDI)": (None, "No code"),
    }
    got = spark.createDataFrame([(t,) for t in titles], "c string").select("c", T.project_title(F.col("c")).alias("t")).collect()
    assert {r["c"]: tuple(r["t"]) if r["t"] else None for r in got} == titles
    codes = spark.createDataFrame([("J0951",), ("0004C",), ("MED-01",), ("S0004",), ("AB1",)], "c string")
    assert values(codes.select(T.project_code(F.col("c")).alias("p")), "p") == ["951", "4", "MED01", "4", "AB1"]


def test_fuzzy_and_whole_word_matches(spark):

    df = spark.createDataFrame([("hypersonic glide",), ("hypersonik glide",), ("nothing",)], "c string")
    assert values(df.select(T.fuzzy_match(F.col("c"), "Hypersonic").alias("m")), "m") == ["exact", "fuzzy", None]
    words = spark.createDataFrame([("a machine",), ("at Mach 5",)], "c string").select(T.keywords_in([F.col("c")], ["mach"]).alias("w"))
    assert [r["w"] for r in words.collect()] == [[], ["mach"]]


def test_same_titles_joins_in_order(spark):
    from ledgerspark.operators.near_text import same_titles

    rows = [("p", 1, "Advanced Radar"), ("p", 2, "Advanced Radar System"), ("p", 3, "Advanced Rador Systen"), ("p", 4, "Mk4A"), ("p", 5, "Other thing")]
    out = same_titles(spark.createDataFrame(rows, "pe string, n int, title string"), ["pe"], "title", ["n"]).orderBy("n")
    assert values(out, "cluster") == ["Advanced Radar System"] * 3 + ["Mk4A", "Other thing"]


def test_keyword_sets_are_checked():
    from ledgerspark.operators.explorer import validated

    assert validated(["a b", " A B ", "cc"]) == ["a b", "cc"]
    for bad in ([], ["x"], ["semi;colon"], ["w"] * 3):
        with pytest.raises(ValueError):
            validated(bad)


def test_exports(spark, tmp_path):
    from ledgerspark.sources import files

    df = spark.createDataFrame([(2, 'say "x"', None), (1, "a,b", 3.0)], "k int, t string, v double")
    out = files.exported(df, ["t", "k", "none"], "k", False, limit=5)
    assert out.columns == ["t", "k"]
    files.write_csv(out, f"{tmp_path}/csv", ["source: test"])
    files.write_json_lines(df, f"{tmp_path}/json", {"rows": "2"})
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/csv").collect()]
    assert lines == ["# source: test", "t,k", '"a,b",1', '"say ""x""",2']
    assert spark.read.text(f"{tmp_path}/json").first()["value"] == '{"_metadata": {"rows": "2"}}'
    checks = spark.createDataFrame([("a", "warning", 2, True), ("b", "error", 0, False)], "name string, severity string, n long, failed boolean")
    assert files.report_text(checks).splitlines()[0] == "FAIL warning a: 2"
    assert "| k | int |" in files.dictionary_text({"t": df})


def test_select_files(spark, tmp_path):
    from ledgerspark.sources.files import select_files

    for name in ("p1.xlsx", "p1_display.xlsx", "r1a.xlsx", "r2_display.xlsx"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(p.rsplit("/", 1)[1] for p in values(select_files(spark, str(tmp_path)), "path")) == ["p1.xlsx", "r2_display.xlsx"]


def test_fact_rows_do_not_depend_on_the_columns(spark, tmp_path):
    """A line without its part, and one without its order, stay in every query."""
    from ledgerspark.plans.facts import COLUMNS, facts

    sf = "/root/testdata/sf0.001"
    for name in ("orders", "customer", "nation", "region", "part", "lineitem"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "lineitem":
            n = df.count()
            df = df.unionByName(df.limit(1).withColumn("l_partkey", F.lit(-5).cast(df.schema["l_partkey"].dataType))).unionByName(df.limit(1).withColumn("l_orderkey", F.lit(-6).cast(df.schema["l_orderkey"].dataType)))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for columns in (None, ["amount"], ["organization_name"], ["account", "office"], COLUMNS):
        assert facts(spark, str(tmp_path), columns).count() == n + 2


def test_sketches_of_parts_are_near_the_whole(spark):
    from ledgerspark.operators import sketches

    df = spark.range(100_000).select((F.col("id") % 9).alias("part"), (F.col("id") * 13 % 20_011).alias("v"), F.col("id").cast("double").alias("a"))
    kept = sketches.sketched(df, ["part"], ["v"], ["a"])
    one = sketches.distinct_counts(kept, [], ["v"]).first()
    assert one["n_rows"] == 100_000 and abs(one["v"] - 20_011) < 0.05 * 20_011
    q = sketches.quantiles(kept, [], "a", [0.1, 0.5, 0.99]).first()
    assert all(abs(q[f"q{int(100 * x)}"] / 100_000 - x) < 0.03 for x in (0.1, 0.5, 0.99))
    with_null = sketches.sketched(df.where("part = 1").withColumn("v", F.lit(None).cast("long")), ["part"], ["v"], ["a"])
    assert sketches.distinct_counts(with_null, ["part"], ["v"]).first()["v"] == 0


def plain_projects(pages):
    """Pages (key, page, text) one after the other: the first text of each number of a key."""
    import re

    out = {}
    for key in {k for k, _, _ in pages}:
        runs, last = [], None
        for _, page, text in sorted(p for p in pages if p[0] == key and p[2] is not None):
            for part in re.split("(?=Exhibit R-2A)", text):
                if not part:
                    continue
                found = re.search(r"Project \(Number/Name\)\s*([A-Z0-9]{2,8})\s*/\s*([^\n]+)", part)
                number = found and found[1]
                if part.startswith("Exhibit R-2A") and not (last is not None and number and number == last[0]):
                    runs.append((number, page, []))
                if part.startswith("Exhibit R-2A"):
                    last = (number,)
                if runs:
                    runs[-1][2].append(part.strip(" \n"))
        for number, page, parts in runs:
            if number and (key, number) not in out:
                out[key, number] = (page, len(parts), "\n\n".join(parts))
    return out


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_projects_over_pages_and_blocks(spark, block):
    import random

    from ledgerspark.operators.enrichment import project_texts

    rng, pages = random.Random(block), []
    for key in ("a", "b", None):
        for page in range(40):
            text = "".join(rng.choice(["tail ", "\n", f"Exhibit R-2A\nProject (Number/Name)\nP{rng.randrange(3)}0 / Name\nx ", "Exhibit R-2A none "]) for _ in range(rng.randrange(4)))
            pages.append((key, page, rng.choice([text, text, None])))
    out = project_texts(spark.createDataFrame(pages, "pe string, page long, text string").repartition(3), ["pe"], "page", "text", block).collect()
    assert {(r["pe"], r["number"]): (r["first_page"], r["n_parts"], r["text"]) for r in out} == plain_projects([p for p in pages if p[2]])


def test_each_title_and_keyword_has_its_code(spark):
    """Every fixed rule decides some title: none is hidden by an earlier one."""
    from ledgerspark.functions import fixed_values as V

    titles = {t: code for code, ts in V.TITLE_CODES.items() for t in ts}
    words = {f"Zz {w} zz": code for w, code in V.KEYWORD_CODES}
    df = spark.createDataFrame([(t,) for t in [*titles, *words]], "title string")
    got = {r["title"]: r["code"] for r in df.select("title", T.appropriation(F.col("title"))["code"].alias("code")).collect()}
    assert got == titles | words
    assert all(not any(a in b for a, _ in V.KEYWORD_CODES[:i]) or dict(V.KEYWORD_CODES)[b] == next(c for a, c in V.KEYWORD_CODES if a in b) for i, (b, _) in enumerate(V.KEYWORD_CODES))
    assert {r["o"] for r in spark.createDataFrame([(a,) for a in V.AGENCIES], "o string").select(T.organization(F.col("o")).alias("o")).collect()} <= {*V.AGENCIES, *V.RENAMED.values()}


def test_titles_of_table_rows(spark):
    rows = {
        "1662: F/A-18 Improvement 4,439.845 101.694 -": ("1662", "F/A-18 Improvement"), "E1662 F/A-18 Improvements": ("1662", "F/A-18 Improvements"), "D549 2.75 Inch Anti-Air TD": ("D549", "2.75 Inch Anti-Air TD"),
        "Total PE": None, "Total PE Cost 12.345 *": None, "": None, "   ": None, "R-1 SHOPPING LIST": None, "** ": None, "0004: Title (MIP)": ("0004", "Title"), "MED-01: x": (None, "MED-01: x"),
        "DD4.: Spaced   title ** 1.00": ("DD4", "Spaced   title"), "ABCD12 too many letters": (None, "ABCD12 too many letters"), "1234567 too many digits": (None, "1234567 too many digits"), "(GDI)": (None, "(GDI)"), "12.345": (None, "12.345"), "Plain title*": (None, "Plain title"), "12:": (None, "12:"),
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = {r["t"]: tuple(r["p"]) if r["p"] else None for r in df.select("t", T.project_title(F.col("t")).alias("p")).collect()}
    assert got == rows
    codes = {"E1662": "1662", "j0951": "951", "S0004": "4", "0004C": "4", "000": "000", "E000": "000", "MED-01": "MED01", "DX7": "DX7", "X12": "X12", "": None, None: None}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r["c"]: r["p"] for r in df.select("c", T.project_code(F.col("c")).alias("p")).collect()} == codes


def test_project_numbers_of_any_length(spark):
    from ledgerspark.operators.enrichment import project_texts, projects

    texts = spark.createDataFrame([(1, 1, "x\nProject AB1000000: ring\nProject ABCDEFGH12345 / bolt"), (2, 1, "Exhibit R-2A\nProject: AB1000000 / ring\nbody")], "pe int, page int, text string")
    assert sorted(projects(texts, "pe", "text").where("pe = 1").collect()) == [(1, "AB1000000", "ring", 1), (1, "ABCDEFGH12345", "bolt", 2)]
    assert [r["number"] for r in project_texts(texts.where("pe = 2"), ["pe"], "page", "text").collect()] == ["AB1000000"]


def test_first_page_of_names_that_differ_by_case(spark):
    from ledgerspark.queries import QUERIES

    urls = ["http://a.example.org/x/n.html", "http://b.example.org/x/N.HTML", "http://c.example.net/x/n.html"]
    rows = [(1 + 4 * i, url, "") for i, url in enumerate(urls)] + [(20, "http://a.example.org/x/m", "")]
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/case"
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    out = QUERIES["sc17_first_source_wins"](spark, folder)
    assert sorted(map(tuple, out.select("name", "page_id").collect())) == [("m", 20), ("n.html", 1)]


def test_sizes_and_shares_without_thousands_signs(spark):
    df = spark.createDataFrame([(999,), (1000,), (1023,), (1024,), (1023 * 1024,), (None,)], "n long")
    assert values(df, T.bytes_text(F.col("n"))) == ["999.0 B", "1000.0 B", "1023.0 B", "1.0 KB", "1023.0 KB", None]
    assert values(df.where("n = 1000"), T.percent_text(F.col("n") / 10)) == ["10000.0%"]


def test_same_searches_meet_the_lines_once(spark, monkeypatch):
    from ledgerspark.operators import searches as Z
    from ledgerspark.queries import QUERIES

    typed = spark.createDataFrame([(3, 'org:asia ring fy:2000 fy:1999'), (2, 'FY:1999 Ring service:"Asia" year:2000'), (1, "ring org:asia"), (4, None), (5, "")], "id int, typed string")
    assert sorted(map(tuple, Z.search_classes(typed, "id", "typed").collect())) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 4)]
    plain, met = Z.matching_lines, []
    monkeypatch.setattr(Z, "matching_lines", lambda searches, *more: (met.append(searches), plain(searches, *more))[1])
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/supplier.parquet").count()
    assert QUERIES["fi11_saved_searches"](spark, folder).count() > 0
    assert met[0].count() == n - 3 * (n // 5 - 1)  # three of five kinds are the same for all suppliers


def test_words_of_pages_are_never_broadcast(spark):
    from ledgerspark.operators.enrichment import mined_programs

    rows = [(1, "P-5 Brand#7 L2 PE 0000001A"), (2, "P-5 Brand#7 L3, Brand#8 L2 PE 0000001A 0000002B"), (3, "Brand#7 L2"), (4, None)]
    pages = spark.createDataFrame(rows, "k long, text string")
    items = spark.createDataFrame([("Brand#7", "L2", "Brand#7:L2"), ("Brand#7", "L3", "Brand#7:L3"), ("Brand#9", "L2", "Brand#9:L2"), ("Brand#8", "", "Brand#8:")], "account string, line_item string, bli_key string")
    out = mined_programs(pages, "k", "text", items)
    assert sorted(map(tuple, out.collect())) == [("Brand#7:L2", "0000001A", 0.9), ("Brand#7:L2", "0000002B", 0.6), ("Brand#7:L3", "0000001A", 0.6), ("Brand#7:L3", "0000002B", 0.6)]
    joins = [line for line in mined_programs(pages, "k", "text", items.repartition(3))._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 2 and all("LeftSemi" in j for j in joins)


def test_steps_of_a_parse_occur_once(spark):
    """Catalyst shares nothing inside lambdas, so a step that is written out twice is worked out twice."""
    from ledgerspark.operators.explorer import checked_keywords, cost_table, mined
    from ledgerspark.operators.headers import field_of, mapped_columns

    df = spark.createDataFrame([("x", ["a"])], "t string, w array<string>")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    costs, rows = plan(df.select(F.explode(cost_table(F.col("t"))))), plan(mined(df, "t", ["ring"]))
    assert costs.count("COST ") == 1 and costs.count("R-1 Line") == 1 and rows.count("COST ") == 1 and rows.count("[A-Z]{2,6}") == 1
    assert plan(df.select(checked_keywords(F.col("w")).alias("c")).select("c.words", "c.problem", F.size("c.words"))).count("trim(") == 1
    sheets = df.select("t", F.array("t").alias("h"), F.lit("r1").alias("e"), F.lit("2026").alias("y"))
    assert plan(df.select(field_of(F.col("t"), F.lit("r1"), F.lit("2026")).alias("f"))).count("fy\\s*") == 1
    assert plan(mapped_columns(sheets, ["t"], "h", "e", "y")).count("fy\\s*") == 1


def test_many_pages_to_a_file(spark, tmp_path):
    from ledgerspark.sources.files import read_pages, write_pages

    rows = [(f"conv_{i // 10}/page_{i % 10}.txt", f"{i}\n\x1e" if i % 2 else "") for i in range(200)] + [("conv_0/page_0.txt", "twice")]
    write_pages(spark.createDataFrame(rows, "file string, text string").repartition(3), f"{tmp_path}/pages")
    assert sorted(map(tuple, read_pages(spark, f"{tmp_path}/pages").collect())) == sorted(rows)
    assert len(list((tmp_path / "pages").rglob("part-*"))) <= 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_subtotals_of_lines_dealt_before_they_are_grouped(spark):
    lines = spark.createDataFrame(
        [("1000000A", 10000001, "p1", "1.10"), ("1000000A", 10000002, "p1", "2.20"), ("1000000A", 10000001, "p1", None), ("1000000A", 10000002, "r1", "4.00"), ("0000003A", 3, "p1", None), (None, None, "r2", "5.00")],
        "pe_number string, part_key long, exhibit_type string, s string",
    ).withColumn("amount", F.col("s").cast("decimal(18,2)"))
    titles = spark.createDataFrame([(10000001, "ring"), (10000002, "gear")], "part_key long, line_item_title string")
    dealt = relations.dealt(lines, "pe_number").join(titles, "part_key", "left")
    rows = {(r[0], r[1], r[2], r[5]): (r[3], r[4]) for r in aggregates.with_subtotals(dealt).collect()}
    assert rows == {
        ("1000000A", None, None, 1): (7.3, 4), ("0000003A", None, None, 1): (None, 1), (None, None, None, 1): (5.0, 1), ("1000000A", "ring", "p1", 0): (1.1, 2),
        ("1000000A", "gear", "p1", 0): (2.2, 1), ("1000000A", "gear", "r1", 0): (4.0, 1), ("0000003A", None, "p1", 0): (None, 1), (None, None, "r2", 0): (5.0, 1),
    }
    plan = plan_of(QUERIES["ag18_subtotals"](spark, "/root/testdata/sf0.001"))  # the top comes first
    assert plan.rindex("HashAggregate") < plan.index("Expand") < plan.index("Join") < plan.index("REBALANCE_PARTITIONS_BY_COL")


def test_latest_lines_picked_before_they_are_described(spark, tmp_path):
    import datetime

    import duckdb

    from ledgerspark.queries import ORACLES

    day = lambda y: datetime.datetime(y, 5, 1)
    lines = [(1, 1, 1, day(1999)), (2, 1, 1, day(2000)), (3, 1, 1, day(2000)), (1, 2, 2, day(1999)), (2, 3, 2, day(1998)), (3, 4, 9, day(1998)), (9, 5, 1, day(1998)), (1, 6, 1, None), (3, None, 3, day(2001))]
    lines += [(3, 10000001, 10, day(2001)), (3, 10000002, 2, day(2001)), (None, 10000003, 1, day(2001)), (3, 10000003, 1, day(2000))]  # one program by its first seven digits
    lines = [(o, p, n, 1.0, 1.0, "N", "O", d) for o, p, n, d in lines]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(1, 1), (2, 2), (3, 3)], "o_orderkey long, o_custkey long"),
        "customer": ([(1, 0, "A"), (2, 0, "B"), (3, 0, None)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(k, f"name {k}", "brand", "type") for k in (1, 2, 3, 5, 6, 10000001, 10000002, 10000003)], "p_partkey long, p_name string, p_brand string, p_type string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "documents": ([(2, "said", "s"), (2, None, "s"), (6, None, "s"), (77, "", "s")], "doc_id long, text string, source string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    out = QUERIES["en02_fallback_narratives"](spark, str(tmp_path))
    rows = sorted(map(tuple, out.select("pe_number", "text").collect()))
    assert rows == sorted(con.execute(f"SELECT pe_number, text FROM ({ORACLES['en02_fallback_narratives']})").fetchall())
    assert dict(rows)["0000001A"] == "name 1 — type — B" and dict(rows)["0000004A"] is None
    plan = plan_of(out)
    assert plan.index("Join") < plan.index("Window") < plan.index("REBALANCE_PARTITIONS_BY_COL") and "text" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert plan.count("struct<doc_id:bigint") == 1  # documents are read once


def test_fallback_keeps_narratives(spark):
    from ledgerspark.operators.enrichment import with_fallback

    known = spark.createDataFrame([("A", "one"), ("A", "two")], "pe_number string, text string")
    lines = spark.createDataFrame([("A", "2000", 1, "1", "t", "b", "c"), ("B", "1999", 1, "1", "old", "b", "c"), ("B", "2000", 2, "2", "late", None, "c"), ("B", "2000", 2, "10", "new", None, "c")], "pe_number string, fiscal_year string, order_key long, line_item string, line_item_title string, budget_activity_title string, appropriation_code string")
    assert sorted(map(tuple, with_fallback(known, lines, "pe_number").collect())) == [("A", "one"), ("A", "two"), ("B", "new — c")]
