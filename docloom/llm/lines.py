"""Line dedup by overlapping windows of three lines.

Lines are the pieces between line feeds without white space at their ends; blank ones are skipped. The
hashes of three consecutive lines make a window. Of a window found more than once in the whole table, the
first occurrence by (doc_id, text hash, place) stays and every later one is removed: the positions that
removed windows cover are merged, and the other lines, blank ones too, are joined again as they were.

Counting windows is an aggregate with partial sums, so a window that a third of the documents have
reaches its task as one row a partition; the join that finds later occurrences has one row per
repeated window on its other side, and adaptive execution splits its large partitions.

Defined results for odd input: a null text counts as empty and stays null; a text of fewer than three lines
that are not blank has no window and stays; rows with equal doc_id and text are one document, with equal
results; a null doc_id comes first; an empty table gives an empty result; other columns are carried in a
struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import marked, settled, written

WINDOW = 3
_BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_windows(docs: DataFrame) -> DataFrame:
    """One row per window: a, b (128 bits of hash), doc_id, version (hash of the text), at (its lines' numbers)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), _lines(F.col("text")).alias("lines"))
    named = rows.select(
        "doc_id",
        "version",
        F.filter(
            F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(_BLANKS)).alias("x"))),
            lambda l: l["x"] != "",
        ).alias("lines"),
    )
    n = F.size("lines")
    windows = named.filter(n >= WINDOW).select(
        "doc_id",
        "version",
        F.explode(
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda k: F.slice("lines", k, WINDOW))
        ).alias("w"),
    )
    texts = F.transform("w", lambda l: l["x"])
    return windows.select(
        F.xxhash64(F.lit(1), texts).alias("a"),
        F.xxhash64(F.lit(2), texts).alias("b"),
        "doc_id",
        "version",
        F.transform("w", lambda l: l["i"]).alias("at"),
    )


def removed_lines(docs: DataFrame) -> DataFrame:
    """One row per document that loses lines: doc_id, version, gone (sorted distinct line numbers)."""
    windows = line_windows(docs)
    place = F.struct("doc_id", "version", "at")
    repeated = (
        windows.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .filter("n > 1")
        .select("a", "b", "first")
    )
    # Written, so that both sides of the join are plain exchanges: only then are large partitions of the windows split.
    later = windows.join(written(repeated), ["a", "b"]).filter(place > F.col("first"))
    return (
        later.select("doc_id", "version", F.explode("at").alias("i"))
        .groupBy("doc_id", "version")
        .agg(F.sort_array(F.collect_set("i")).alias("gone"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with its text left, and the numbers of lines, removed lines, spans."""
    gone = written(
        removed_lines(docs).select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"), "gone")
    )
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"))
    # Only documents that may lose lines are shuffled.
    rows = marked(rows, F.xxhash64("id", "version"), gone, F.xxhash64("gone_id", "gone_version"))
    joined = rows.filter("maybe").join(
        gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left"
    ).select("row", "gone")
    joined = joined.union(rows.filter("NOT maybe").select("row", F.lit(None).cast(gone.schema["gone"].dataType)))
    split = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), _lines(F.col("row.text"))).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return split.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text).alias("text"),
        F.size(F.coalesce("lines", _lines(F.col("row.text")))).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("gone")), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(
            F.size(F.filter(F.transform("gone", lambda x, k: x - F.coalesce(F.get("gone", k - 1), F.lit(-2))), lambda g: g > 1)),
            F.lit(0),
        ).cast("long").alias("n_spans"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts left; a document that loses all its words goes."""
    left = settled(dedup_lines(docs)).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(
        *[
            F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )


def op3_rows(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, n_spans, text."""
    return dedup_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_spans", "text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM d),
s AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM l),
w AS (SELECT doc_id, i, lead(i) OVER o AS j, lead(i, 2) OVER o AS k, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z
      FROM s WHERE x <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY md5(x || chr(10) || y || chr(10) || z) ORDER BY doc_id, i) AS nth FROM w WHERE k IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([i, j, k]) AS i FROM r WHERE nth > 1),
p AS (SELECT doc_id, i, CASE WHEN i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -2) > 1 THEN 1 ELSE 0 END AS begins FROM g),
c AS (SELECT doc_id, count(*) AS n, sum(begins) AS spans FROM p GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i
      WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans,
       CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(t.text, '') END AS text
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
