"""Fill-in-the-middle texts by escaped markers (operator 11), all in DataFrame functions.

A text is escaped so that it no longer holds the delimiter, the delimiter is appended after
every unit, and then ranked parts are what lies before or after the k-th delimiter. `~` and `|`
become `~0` and `~1`, so an escaped character is one unit of two characters, and no part is
cut inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import read_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
DELIMITER = "|"
#: one unit of an escaped text; a tail without a unit (blank space after the last word) belongs to the suffix
UNITS = {"code point": r"(?s)~[01]|[^~]", "word": r"\s*\S+", "line": r"[^\n]*\n|[^\n]+"}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit(DELIMITER), F.lit("~1"))


def unescape(part: Column) -> Column:
    """The text behind a part: without delimiters, then without escapes."""
    return F.replace(F.replace(F.replace(part, F.lit(DELIMITER), F.lit("")), F.lit("~1"), F.lit(DELIMITER)), F.lit("~0"), F.lit("~"))


def mark(text: Column, unit: str = "code point") -> Column:
    """The escaped text with the delimiter after every unit."""
    return F.regexp_replace(escape(text), F.lit(UNITS[unit]), F.lit("$0" + DELIMITER))


def count_marks(marked: Column) -> Column:
    return F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers under 2**32 from sha256 of `seed:doc_id`; a null doc_id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, unit: str = "code point") -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), n_prefix, n_middle (units; null if plain), prefix, middle, suffix and output.

    Both cuts are drawn evenly from 0..n by a hash of seed and doc_id, so a document is cut the
    same way wherever it lies. Texts that hold one of the three markers stay plain, empty ones
    too. A null text is an empty one; a null doc_id draws as an empty id; repeated rows are cut
    alike; an empty table gives no rows. Columns beside doc_id and text are not carried on.
    There is no shuffle; a task holds a text of any length a few times over (twice as long
    with its marks), which a string's 2 GB bound.
    """
    whole = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", whole.alias("text"), mark(whole, unit).alias("_marked"))
    counted = marked.withColumn("n", count_marks(F.col("_marked")).cast("long")).withColumns({f"_h{k}": h for k, h in enumerate(draws(F.col("doc_id"), seed), 1)})
    held = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | held | (F.col("_h3") % 100 >= 100 - plain_percent)
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("_h1", "_h2")]
    placed = counted.select(
        "doc_id", "text", "n", "_marked",
        F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        F.least(*cuts).cast("int").alias("_a"), F.greatest(*cuts).cast("int").alias("_b"),
    )
    cut = F.col("form") != "plain"
    # the first b units, then of these the last b - a; substring_index counts delimiters from the left or, below 0, from the right
    headed = placed.withColumn("_head", F.when(cut, F.expr(f"substring_index(_marked, '{DELIMITER}', _b)")))
    parts = headed.select(
        "doc_id", "text", "n", "form",
        F.when(cut, F.col("_a").cast("long")).alias("n_prefix"), F.when(cut, (F.col("_b") - F.col("_a")).cast("long")).alias("n_middle"),
        F.when(cut, unescape(F.expr(f"substring_index(_marked, '{DELIMITER}', _a)"))).alias("prefix"),
        F.when(cut, unescape(F.expr(f"substring_index(_head, '{DELIMITER}', _a - _b)"))).alias("middle"),
        F.when(cut, unescape(F.expr(f"substring_index(_marked, '{DELIMITER}', cast(_b - n - 1 as int))"))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return parts.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: each marker stands there once, as texts that hold one are plain."""

    def after(m: str, s: Column) -> Column:
        return F.substring_index(s, m, -1)

    def before(m: str, s: Column) -> Column:
        return F.substring_index(s, m, 1)

    middle = after(MIDDLE, output)
    psm = F.concat(before(SUFFIX, after(PREFIX, output)), middle, before(MIDDLE, after(SUFFIX, output)))
    spm = F.concat(before(MIDDLE, after(PREFIX, output)), middle, before(PREFIX, after(SUFFIX, output)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut by code points, with digests of the output and of the text that it gives back."""
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("n_prefix").alias("prefix_chars"), F.col("n_middle").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s, length(coalesce(text, '')) AS n FROM documents),
numbers AS (
  SELECT *, CAST('0x' || s[1:8] AS UBIGINT)::BIGINT AS h1, CAST('0x' || s[9:16] AS UBIGINT)::BIGINT AS h2,
         CAST('0x' || s[17:24] AS UBIGINT)::BIGINT AS h3, CAST('0x' || s[25:32] AS UBIGINT)::BIGINT AS h4 FROM drawn),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS x FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m WHEN 'spm' THEN '<S>' || x || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
