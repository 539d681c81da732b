"""URL filters by a sort-merge range join, with DataFrame functions only.

A rule (host, path) fits its host and all its subdomains where the url's path starts with its own.
With the host's labels reversed, ``host + path`` is a key, and a rule is the interval of the keys that it
starts. A url has one key for each suffix of its host, as many as the longest rule host has labels, so
that the rules that fit it are those whose intervals hold one of its keys. Prefix intervals are nested
or apart: along the sorted bounds of the intervals a stack of open rules grows and shrinks, and each
bound is given the rule on top. A sorted sweep over bounds and keys hands each key the top of the
stack at the last bound before it, which is the longest rule for that key; the longest over a url's
keys wins (by characters of host and path, then of host, then the rule's own text).

Every task of the sweep takes one salted share of the urls with all the bounds, so a host that a third
of the urls have is spread over all tasks. Bounds are two rows a rule.

Defined results for odd input: a null url, or one without ``://``, has an empty host and path and no
rule; repeated rows give as many rows; equal page_id values with other urls are judged apart; rows
without a rule get the default verdict; of equal rules that differ in action, block wins; an empty
table gives an empty result, an empty rule list the default verdict; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT_VERDICT = "allow"
#: Urls in a share of the sweep, and the least number of shares; each also gets all the bounds.
SHARE_ROWS, LEAST_SHARES = 1_000_000, 64


def host_column(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_column(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    """Reversed labels, then the path, as bytes: they order as the sweep needs, whatever the characters."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), path).cast("binary")


def rule_bounds(rules: DataFrame) -> DataFrame:
    """``rules(action, host, path)`` as bounds (key, top): top is the rule that holds from key on, or null.

    The stack after a bound is the set of rules whose interval is open there; as intervals are nested,
    its top is the open rule that began last.
    """
    one = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    named = one.select(
        _key(F.col("host"), F.col("path")).alias("low"),
        F.struct(
            F.length(F.concat("host", "path")).alias("chars"),
            F.length("host").alias("host_chars"),
            F.concat("host", "path").alias("rule"),
            F.col("action"),
        ).alias("r"),
    )
    named = named.withColumn("high", F.concat("low", F.lit(b"\xff")))
    points = named.select(F.col("low").alias("key")).union(named.select("high")).distinct()
    # A rule holds at a point if its key starts the point: look it up by each prefix of the point.
    inside = points.select("key", F.explode(F.sequence(F.lit(0), F.length("key"))).alias("n")).select(
        "key", F.col("n"), F.expr("substring(key, 1, n)").alias("low")
    )
    held = inside.join(named, "low").filter(F.col("key") < F.col("high"))
    tops = held.groupBy("key").agg(F.max_by("r", "n").alias("top"))
    return points.join(tops, "key", "left").select("key", "top")


def url_verdicts(
    pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, shares: int | None = None
) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict. Without ``shares``, their number grows with the pages."""
    shares = shares or max(LEAST_SHARES, -(-pages.count() // SHARE_ROWS))
    bounds = rule_bounds(rules)
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    parts = pages.select("page_id", "url", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    # Repeated rows travel as one, with their number.
    parts = parts.groupBy("page_id", "url", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    labels = F.split("host", r"\.")
    keyed = (
        parts.withColumn("labels", labels)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("labels")))))
        .withColumn("suffix", F.array_join(F.slice("labels", F.size("labels") - F.col("k") + 1, F.col("k")), "."))
    )
    facts = F.struct("page_id", "url", "host", "path", "copies")
    keys = keyed.select(
        _key(F.col("suffix"), F.col("path")).alias("key"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(shares)).cast("int").alias("share"),
        F.lit(1).alias("kind"),
        facts.alias("page"),
    )
    null_page = F.lit(None).cast(keys.schema["page"].dataType)
    marks = bounds.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
        F.lit(0).alias("kind"),
        null_page.alias("page"),
        F.struct("top").alias("mark"),
    )
    null_mark = F.lit(None).cast(marks.schema["mark"].dataType)
    sweep = Window.partitionBy("share").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        keys.withColumn("mark", null_mark)
        .unionByName(marks)
        .withColumn("on_top", F.last("mark", ignorenulls=True).over(sweep))
        .filter(F.col("kind") == 1)
    )
    best = swept.groupBy("page").agg(F.max("on_top.top").alias("best"))
    each = best.select("page", "best", F.explode(F.array_repeat(F.lit(0), F.col("page.copies").cast("int"))))
    named = F.col("page.host") != ""
    return each.select(
        F.col("page.page_id").alias("page_id"),
        F.col("page.url").alias("url"),
        F.col("page.host").alias("host"),
        F.col("page.path").alias("path"),
        F.when(named, F.col("best.rule")).alias("rule"),
        F.coalesce(F.when(named, F.col("best.action")), F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as a table (action, host, path)."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("action", "host", "path")])
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("action", "host", "path"), r, strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


_RULES_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)

SQL = rf"""
WITH rules(action, host, path) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (
  SELECT p.r, max_by(r.host || r.path, len(r.host || r.path)) AS rule, max_by(r.action, len(r.host || r.path)) AS action
  FROM parts p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
  WHERE p.host <> '' GROUP BY p.r)
SELECT page_id, host, path, rule, coalesce(action, '{DEFAULT_VERDICT}') AS verdict FROM parts LEFT JOIN fits ON parts.r = fits.r
"""
