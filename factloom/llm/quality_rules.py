"""Quality rules: a threshold table compiled into Spark projections; no user functions.

Edge cases: a null text counts as empty (no words, so ``base_failed``). Repeated rows are judged each for itself.
Columns of the input other than the id and the text are dropped unless they are named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import table

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]+"
WINDOW = 8

# Common function words of the four languages.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "with", "for", "on", "this", "are", "was", "it", "as",
    "der", "die", "das", "und", "in", "zu", "den", "ist", "ein", "eine", "von", "mit", "nicht", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "en", "du", "que", "pour", "est", "dans",
    "el", "los", "las", "y", "del", "por", "con", "no", "para", "es", "se", "su", "al", "lo",
)


class Rule(NamedTuple):
    """A document fails when ``metric`` is below ``low`` or above ``high``; null bounds don't apply."""

    name: str
    metric: str
    low: float | None
    high: float | None


RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbol_to_word", "n_symbols / n_words", None, 0.4),
    Rule("symbol_share", "n_symbols / n_chars", None, 0.2),
    Rule("stop_word_share", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_line_share", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("upper_share", "n_upper / greatest(word_chars, 1)", None, 0.5),
)


def _metrics(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    length_without = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    out = docs.select(*keep, t.alias("_t"))
    out = out.select("*", F.length("_t").cast("long").alias("n_chars"), F.regexp_extract_all("_t", F.lit(WORD), 0).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    out = out.select(
        *keep, "n_chars", "_w",
        F.size("_w").cast("long").alias("n_words"),
        length_without(SPACE).cast("long").alias("word_chars"),
        (F.col("n_chars") - length_without(SYMBOL)).alias("n_symbols"),
        (F.col("n_chars") - length_without(r"\p{Lu}+")).alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )
    hashed = F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))) ELSE array() END")
    out = out.withColumn("_h", hashed).drop("_w")
    return out.withColumn("n_repeat_words", F.when(F.size("_h") == F.size(F.array_distinct("_h")), F.lit(0).cast("long")).otherwise(_covered())).drop("_h")


def _covered() -> Column:
    """Words under windows whose hash comes twice: equal hashes stand together when sorted; the starts found cover 8 words each, or as far as the next start."""
    return F.expr(f"""
        aggregate(
          array_sort(transform(
            filter(
              zip_with(
                zip_with(array_sort(transform(_h, (h, i) -> struct(h, i))), concat(array(cast(null as struct<h:bigint,i:int>)), slice(array_sort(transform(_h, (h, i) -> struct(h, i))), 1, size(_h) - 1)), (x, p) -> struct(x AS x, x.h <=> p.h AS same)),
                concat(slice(array_sort(transform(_h, (h, i) -> struct(h, i))), 2, size(_h) - 1), array(cast(null as struct<h:bigint,i:int>))), (s, n) -> struct(s.x.i AS i, s.same OR s.x.h <=> n.h AS hit)),
              e -> e.hit),
            e -> e.i)),
          struct(cast(0 AS bigint) AS n, cast(-{WINDOW} AS int) AS last),
          (a, i) -> struct(a.n + least({WINDOW}, i - a.last) AS n, i AS last),
          a -> a.n)""")


def _measure(metric: str) -> Column:
    """A rule's metric, null where it divides by zero; with spark.sql.ansi.enabled, Spark's default, a text without words would end the job."""
    return F.expr(re.sub(r"/\s*(\w*\([^()]*\)|[\w.]+)", r"/ nullif(\1, 0)", f"({metric})"))


def rate(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", keep: Sequence[str] = ("doc_id",), min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Each row with its metrics, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    The base rule asks for ``min_words`` words and at most ``max_repeat_percent`` percent of them under repeated
    8-word windows. The rule table is compiled into one projection over the metrics.
    """
    m = _metrics(docs, text, keep)
    failed = []
    for r in rules:
        x, bad = _measure(r.metric), F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low)
        if r.high is not None:
            bad = bad | (x > r.high)
        failed.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    m = m.select("*", base.alias("base_failed"), F.array_compact(F.array(*failed) if failed else F.array().cast("array<string>")).alias("failed_rules"))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    verdicts = []
    for r in RULES:
        x = r.metric.replace("/", "/ 1.0 /")
        verdicts += [f"coalesce({x} < {r.low}, false)"] * (r.low is not None) + [f"coalesce({x} > {r.high}, false)"] * (r.high is not None)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    win AS (SELECT k, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
    dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT k, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW}))) AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM dup) GROUP BY k),
    m AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '{SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (k)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT ({" OR ".join(verdicts)}) AS kept FROM b"""
