"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "der die und in den von zu das sich mit des auf für nicht im ist dem ein eine als "
    "de la le et les des en un du une que pour est dans qui au par sur pas avec "
    "de la que el en y los las se del un por con no su una es para al lo"
).split()
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: name, measure, least and greatest value that pass (None: no bound); a null measure passes. Repeated lines fail a text
#: from the share on that the base rule sets for repeated words: more than half.
RULES = (
    ("words", "n_words", 50, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("mean_word_length", "mean_word_length", 2.0, 12.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_ratio", 0.01, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
)
#: Rules whose failure is also reported as base_failed.
BASE = ("words", "repeated_words")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines of each row."""
    text = F.coalesce("text", F.lit(""))
    line_has_word = lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0
    split = docs.select(
        "doc_id",
        words(text).alias("w"),
        F.filter(F.split(text, "\n", -1), line_has_word).alias("lines"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    grams = split.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        # the windows of three words as (hash, place), equal ones side by side
        F.sort_array(
            F.transform(
                F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
                lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")),
            )
        ).alias("g"),
    )
    again = grams.withColumn(
        "g",
        F.filter("g", lambda x, i: F.coalesce(x["h"] == F.get("g", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("g", i + 1)["h"], F.lit(False))),
    )
    return again.withColumn(
        "n_repeat_words",
        F.size(F.array_distinct(F.flatten(F.transform("g", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long"),
    ).drop("g")


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b))


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of docs with its measures, base_failed, kept and failed_rules.

    Null and blank texts have no words and fail the rule on words; ratios over nothing are null and pass. Rows
    repeat as they come; an empty table gives an empty result; other columns are ignored. Windows of three words
    are compared by a 64-bit hash inside their text.
    """
    m = measures(docs).withColumns(
        {
            "repeat_ratio": _ratio("n_repeat_words", "n_words"),
            "mean_word_length": _ratio("word_chars", "n_words"),
            "symbol_ratio": _ratio("n_symbols", "n_words"),
            "stop_ratio": _ratio("n_stop_words", "n_words"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        }
    )
    fails = {}
    for name, measure, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(measure) < least)
        if most is not None:
            bad = bad | (F.col(measure) > most)
        fails[name] = F.coalesce(bad, F.lit(False))
    base = F.lit(False)
    for name in BASE:
        base = base | fails.get(name, F.lit(False))
    names = F.array(*[F.when(bad, F.lit(name)) for name, bad in fails.items()])
    out = m.withColumns({"base_failed": base, "failed_rules": F.array_compact(names)})
    return out.withColumn("kept", F.size("failed_rules") == 0)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), s AS (
  SELECT doc_id, r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d
), e AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s
), g AS (
  SELECT r, i, x AS a, lead(x, 1) OVER v AS b, lead(x, 2) OVER v AS c FROM e WINDOW v AS (PARTITION BY r ORDER BY i)
), n AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL
), p AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM n, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS n_stop, len(lines) AS n_lines
  FROM s LEFT JOIN p USING (r)
), f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2,
         n_words > 0 AND (word_chars * 1.0 / n_words < 2 OR word_chars * 1.0 / n_words > 12) AS f3,
         n_words > 0 AND n_symbols::DOUBLE / n_words > 0.1 AS f4,
         n_words > 0 AND n_stop::DOUBLE / n_words < 0.01 AS f5,
         n_lines > 0 AND n_dup_lines::DOUBLE / n_lines > 0.5 AS f6
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept,
       concat_ws(',', CASE WHEN f1 THEN 'words' END, CASE WHEN f2 THEN 'repeated_words' END, CASE WHEN f3 THEN 'mean_word_length' END,
                 CASE WHEN f4 THEN 'symbols' END, CASE WHEN f5 THEN 'stop_words' END, CASE WHEN f6 THEN 'repeated_lines' END) AS failed_rules
FROM f"""
}
QUERIES = {"op1_quality_rules": op1_quality_rules}
