"""Fill-in-the-middle transformation by escaped marker injection, with DataFrame functions only.

A delimiter is made free by escaping it; regexp_replace then appends it after every unit of the text
(a code point, a word with the space behind it, a line: any pattern). Counting delimiters counts the
units, and substring_index cuts out the units between two ranks. The parts lose their delimiters, are
unescaped and put together in the order of their form. Nothing is shuffled.

Cut places and form of a document come from a hash of the seed and its id alone, so a run on other
machines or partitions gives the same rows.

Defined results: a null text is an empty one; an empty text, or one that holds a sentinel, stays
plain; a null id is hashed as no digits; repeated rows give repeated results; text of any length is
cut whole; an empty table gives no rows; input columns of the results' names are replaced, all others
are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter, and the character that escapes it and itself; each escape is two characters.
DELIMITER, ESCAPE = "\x1f", "\x1e"
ESCAPED_ESCAPE, ESCAPED_DELIMITER = ESCAPE + "0", ESCAPE + "1"
CODE_POINTS, WORDS, LINES = "[^\x1e]", "[^\\s\x1e]+\\s*|\\s+", "[^\n\x1e]*\n|[^\n\x1e]+"
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def found_in(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(DELIMITER), F.lit(ESCAPED_DELIMITER))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPED_DELIMITER), F.lit(DELIMITER)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def mark_units(text: Column, unit: str = CODE_POINTS) -> Column:
    """The escaped text with a delimiter behind each unit; an escaped character is a unit of its own.

    unit: a pattern that between its matches leaves nothing out but ESCAPE.
    """
    return F.regexp_replace(escape(text), f"(?:{unit})|{ESCAPE}.", "$0" + DELIMITER)


def unit_count(marked: Column) -> Column:
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def plain_part(marked: Column) -> Column:
    return unescape(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def draws(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a seed and an id."""
    hex_digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hex_digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: Sentinels = Sentinels(), unit: str = CODE_POINTS) -> DataFrame:
    """All columns of docs and: n units, form (plain, psm, spm), prefix_chars and middle_chars in
    code points (null if plain), output."""
    names = [c for c in docs.columns if c.lower() not in RESULTS]
    h1, h2, h3, h4 = draws(seed, docs[id_column])
    delimiter, text, form = F.lit(DELIMITER), F.col("text"), F.col("form")
    base = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.coalesce(docs[text_column], F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), (h3 % 100 >= 100 - plain_percent).alias("left"), (h4 % 100 < spm_percent).alias("turned"))
    marked = base.select("*", mark_units(text, unit).alias("marked")).select("*", unit_count(F.col("marked")).alias("n"))
    ranked = marked.withColumns({"a": (F.col("h1") % (F.col("n") + 1)).cast("int"), "b": (F.col("h2") % (F.col("n") + 1)).cast("int")})
    ranked = ranked.withColumn("form", F.when((text == "") | sentinels.found_in(text) | F.col("left"), "plain").when(F.col("turned"), "spm").otherwise("psm"))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    first = lambda x, k: F.call_function("substring_index", x, F.lit(DELIMITER), k)
    cut = ranked.withColumns({
        "prefix": plain_part(first(F.col("marked"), lo)),
        "middle": plain_part(first(first(F.col("marked"), hi), lo - hi)),
        "suffix": plain_part(first(F.col("marked"), hi - F.col("n").cast("int") - 1)),
    })
    p, s, m = (F.lit(x) for x in (sentinels.prefix, sentinels.suffix, sentinels.middle))
    output = F.when(form == "plain", text).when(form == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    lengths = [F.when(form != "plain", F.length(c)).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return cut.select(*[F.col("row")[c].alias(c) for c in names], "n", "form", *lengths, output.alias("output"))


def rebuild(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The exact text from output and form: a text that is cut holds no sentinel, so each stands once."""
    one, other = (F.when(form == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((sentinels.prefix, sentinels.suffix), (sentinels.suffix, sentinels.prefix)))
    before = lambda x, mark: F.call_function("substring_index", x, mark, F.lit(1))
    behind = lambda x, mark: F.call_function("substring_index", x, mark, F.lit(-1))
    middle, head = behind(output, F.lit(sentinels.middle)), before(behind(output, one), F.lit(sentinels.middle))
    left, right = before(head, other), behind(head, other)
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


#: The same rows by DuckDB, which cuts by substring.
ORACLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), ranked AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, substring(t, 1, least(a, b)) AS p, substring(t, least(a, b) + 1, abs(a - b)) AS m, substring(t, greatest(a, b) + 1) AS s FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
