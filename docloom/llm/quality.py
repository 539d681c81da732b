"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Defined results for odd input: a null or empty text has no words, so every count is 0 and the base
rule rejects it; repeated rows and equal ``doc_id`` values are judged row by row; an empty table gives
an empty result; other columns, whatever their names, are carried along by `quality_filter` and
ignored by `quality_metrics`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import settled

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans des du est et la le les par pas pour que qui sur un une "
    "como con de del el en es las los más no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low <= metric <= high`` (a bound of None is open)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. The metrics are the names that `metric_columns` defines.
RULES = (
    Rule("n_words", low=20),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.10),
    Rule("stop_word_ratio", low=0.03),
    Rule("dup_line_ratio", high=0.50),
    Rule("repeat_word_ratio", high=0.30),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def metric_columns() -> dict[str, Column]:
    """The ratios that rules may name, over the counts of `quality_metrics`."""
    return {
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_word_ratio": _ratio("n_stop_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": _ratio("n_repeat_words", "n_words"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression for the whole table; an empty table keeps everything."""
    metrics, kept = metric_columns(), F.lit(True)
    for r in rules:
        x = metrics.get(r.metric, F.col(r.metric))
        if r.low is not None:
            kept = kept & (x >= F.lit(r.low))
        if r.high is not None:
            kept = kept & (x <= F.lit(r.high))
    return kept


def _measured(rows: DataFrame) -> DataFrame:
    """Counts for ``rows(row struct, text string)``; the stages are projections only, no shuffle.

    A stage's arrays are read more than once by the next, so that Spark computes them once per row.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    words = rows.select(
        "row",
        t.alias("text"),
        F.array_remove(F.split(t, SPACES), "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    words = words.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    n = F.size("words")
    counted = words.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), n - WINDOW),
                lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]),
            ),
        ).alias("windows"),
    )
    keep = ["row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    ordered = counted.select(
        *keep,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    repeated = ordered.select(
        *keep,
        F.sort_array(
            F.array_compact(
                F.transform(
                    "s",
                    lambda x, k: F.when(
                        (x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"]), x["i"]
                    ),
                )
            )
        ).alias("p"),
    )
    # Each repeated window covers the words up to the next repeated window, 8 at most.
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get("p", k + 1) - x), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return settled(repeated.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")))


def _judged(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return _measured(rows).select(
        "*", failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept")
    )


def quality_metrics(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, the counts, ``base_failed`` and ``kept``."""
    rows = docs.select(F.struct("doc_id").alias("row"), F.col("text"))
    return _judged(rows, rules).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that every rule accepts, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return _judged(rows, rules).filter("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_metrics(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_STOP_SQL = ", ".join("'" + w + "'" for w in STOP_WORDS)

#: Ends of the CTE chain: `judged` holds the documents with their counts and verdicts.
QUALITY_CTES = rf"""
qd AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {{docs}}),
qw AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
              list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM qd),
qi AS (SELECT r, unnest(range(1, len(words) - 6)) AS i,
              unnest(list_transform(range(1, len(words) - 6), lambda j: md5(array_to_string(words[j:j+7], ' ')))) AS h
       FROM qw WHERE len(words) >= 8),
qh AS (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM qi),
qp AS (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8) AS gap FROM qh WHERE c >= 2),
qr AS (SELECT r, sum(least(8, gap)) AS n FROM qp GROUP BY r),
qc AS (SELECT qw.r, doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
              len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
              (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
              len(list_filter(words, lambda w: w IN ({_STOP_SQL})))::BIGINT AS n_stop,
              coalesce(qr.n, 0)::BIGINT AS n_repeat_words FROM qw LEFT JOIN qr ON qw.r = qr.r),
qb AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM qc),
judged AS (SELECT *, NOT base_failed AND n_words >= 20 AND word_chars / n_words BETWEEN 2.0 AND 14.0
              AND n_symbols / n_words <= 0.10 AND n_stop / n_words >= 0.03
              AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.50) AND n_repeat_words / n_words <= 0.30 AS kept FROM qb)
"""

SQL = (
    "WITH "
    + QUALITY_CTES.format(docs="documents")
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
)
