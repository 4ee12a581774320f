"""Quality rules: a table of thresholds compiled into one projection.

Every figure comes from built-in functions in one scan: no user function, no
shuffle.  ``RULES`` holds the thresholds; ``verdict`` turns the table into one
boolean column.

Repeated words are found by sorting the hashes of a text's three-word windows
(n log n, also for very long texts): windows equal to a neighbour in that order
are repeated, and the words that they cover are counted once each.

Defined results: a null text has no words and fails the base rule like an empty
one; null doc_ids and repeated rows are judged each; other columns are ignored
(clashing names too, as figures are made under names of their own); an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: Frequent function words of the languages kept.
STOP_WORDS = {
    "en": "the of and to a in is that for it on was as with be by this are from or at an have not",
    "fr": "de la le et les des en un du une que est pour au dans qui sur pas par avec ne se ce il",
    "de": "der die und in den von zu das mit sich des auf für ist nicht im dem ein als eine auch es an",
    "es": "de la que el en y los se del un por las con no una su para al lo es como más o le",
}


@dataclass(frozen=True)
class Rule:
    """A figure of the text must lie between ``low`` and ``high``, both included."""

    name: str
    figure: str
    low: float | None = None
    high: float | None = None


#: The thresholds.  Figures are SQL over the columns that ``figures`` makes.
RULES = (
    Rule("length: characters in a word", "word_chars / n_words", 2.0, 12.0),
    Rule("symbols: to words", "n_symbols / n_words", None, 0.1),
    Rule("stop words: share of words", "n_stop_words / n_words", 0.03, None),
    Rule("lines: share equal to an earlier line", "n_dup_lines / n_lines", None, 0.5),
)


def stop_words() -> list[str]:
    """The words in lower case and with a capital first letter, each once."""
    words = {w for line in STOP_WORDS.values() for w in line.split()}
    return sorted(words | {w.capitalize() for w in words})


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it in a loop."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = 3) -> Column:
    """How many words lie in an n-word window that occurs twice or more in ``words``."""
    def covered(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.slice(w, 1, F.size(w) - (n - 1))).otherwise(F.slice(w, 1, 0))
        windows = F.transform(starts, lambda x, i: F.struct(F.xxhash64(x, *(F.get(w, i + j) for j in range(1, n))).alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            found = F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]))
            places = F.sort_array(F.transform(found, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("last"))
            step = lambda a, x: F.struct((a["n"] + F.least(F.lit(n), x - a["last"])).alias("n"), x.alias("last"))
            return F.aggregate(places, zero, step, lambda a: a["n"])

        return _let(F.sort_array(windows), twice)

    return _let(words, covered)


def _measured(rows: DataFrame, *kept: str) -> DataFrame:
    """``rows`` (the kept columns and ``text``) with the figures in place of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_PATTERN))
    rows = rows.select(*kept, text.alias("text"))
    rows = rows.select(*kept, "text", F.array_remove(F.split("text", SPACE_PATTERN), "").alias("words"), lines.alias("lines"))
    return rows.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop_words()))).cast("long").alias("n_stop_words"),
    )


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of each text."""
    return _measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def verdict(rules=RULES) -> Column:
    """All rules at once; a text without words or lines passes none that divides by them."""
    found = F.lit(True)
    for rule in rules:
        figure = F.expr(rule.figure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"))
        for bound, holds in ((rule.low, lambda b, f: f >= b), (rule.high, lambda b, f: f <= b)):
            if bound is not None:
                found = found & holds(F.lit(bound), figure)
    return F.coalesce(found, F.lit(False))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """The figures with base_failed and kept."""
    return figures(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    # the row travels beside its figures, so that no join is needed
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return _measured(docs.select(row.alias("row"), "text"), "row").where(~base_failed() & verdict(rules)).select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _in_sql(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), p AS (
  SELECT row, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), t AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n FROM p
), r AS (
  SELECT row, count(DISTINCT place) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM t WHERE n > 1) GROUP BY row
), f AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(words, lambda x: x IN ({_in_sql(stop_words())}))) AS n_stop_words
  FROM w LEFT JOIN r USING (row)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE
            word_chars::DOUBLE / n_words BETWEEN 2.0 AND 12.0 AND n_symbols::DOUBLE / n_words <= 0.1
            AND n_stop_words::DOUBLE / n_words >= 0.03 AND n_dup_lines::DOUBLE / n_lines <= 0.5 END AS kept
FROM b
"""
