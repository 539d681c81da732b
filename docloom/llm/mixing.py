"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words; a document is expected ``target / source size`` times in the mix on average.
The whole part of that is certain: so many copies of each of its documents. What is left of the target
is drawn without replacement and with unequal chances: a document's inclusion probability falls with its length, by half
for each TIER_BITS bits of it, so that a few long documents do not make up the draw. The probabilities of a source are scaled
so that the expected words are those left; a tier that would come above 1 has one more certain copy of each document.
Documents are ranked by the odds of a uniform random number divided by their inclusion odds, and taken in that
order up to the sample's fixed size, here in words: a document is in if the middle of its words lies before the
size. The random number is a hash of doc_id and text, so reruns agree.

No window spans a source's documents. Words are summed by source and slice of the rank, running
sums over the slices find the slice in which the sample ends, and only documents of that slice are ranked.

Defined results for odd input: a null or empty text has size 0; a null source is a source of its own,
after all others; rows of one source with equal doc_id and equal text are drawn as one; an empty table
gives an empty result; `mixed` carries all other columns in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.shared import dropped, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 20
#: Inclusion probabilities halve with every so many bits of a document's size.
TIER_BITS = 4
#: Documents a slice on average, and the bounds of the number of slices.
SLICE_ROWS, MIN_SLICES, MAX_SLICES = 1000, 64, 1 << 20
#: A table with a row a source is broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000


def size_column(text: Column) -> Column:
    """Words of the whole text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def uniform_column(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on doc_id, text and seed only."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def tier_column(size: Column) -> Column:
    return F.floor((F.length(F.bin(size)) - 1) / TIER_BITS).cast("int")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` with ``weight`` and ``target``; one row a source.

    Resharing the excess by weight until no source is above its limit ends where each target is the
    lesser of the limit and ``level * weight``. By limit per weight, sources fill up one after another;
    the level is what is left, per weight left, at the first source that does not.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(MOST_COPIES))
    named = sizes.withColumn("weight", weight).withColumn("limit", limit)
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    rest = by_limit.rowsBetween(0, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) * F.lit(SHARE)
    named = named.withColumn(
        "level",
        (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    full = F.col("limit") / F.col("weight") <= F.col("level")
    level = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy())
    return named.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("limit"), level * F.col("weight")), F.col("limit")).alias("target"),
    )


def inclusion(tiers: DataFrame, planned: DataFrame) -> DataFrame:
    """For ``tiers(source, tier, words)`` and a source's ``need``: chances, a map from tier to probability, one row a source.

    Probabilities are ``level / 2**tier``, or 1 where that is above. By tier, as these fill up first, the level is what is
    left of the need, per weighted word left, at the first tier that does not fill up.
    """
    weight = F.pow(F.lit(2.0), -F.col("tier"))
    rows = by_source(tiers.withColumn("weight", weight), planned.select("source", "need"))
    order = Window.partitionBy("source").orderBy("tier")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("need") - F.coalesce(F.sum(F.col("words").cast("double")).over(before), F.lit(0.0))
    rows = rows.withColumn("level", F.try_divide(left, F.sum(F.col("words") * F.col("weight")).over(rest)))
    full = F.col("weight") * F.col("level") >= 1
    level = F.max(F.when(~full, F.struct(-F.col("tier"), "level"))).over(Window.partitionBy("source"))["level"]
    chance = F.when(level.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), level * F.col("weight"))))
    return rows.withColumn("chance", chance).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("tier", "chance"))).alias("chances"))


def rank_column() -> Column:
    """Odds of u over the inclusion odds: 0 for what is certain, null for what is impossible or has no words."""
    chance = F.col("chances")[tier_column(F.col("size"))]
    ratio = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    return F.when((F.col("size") > 0) & (chance >= 1), F.lit(0.0)).when((F.col("size") > 0) & (chance > 0), ratio)


def sample_cuts(sized: DataFrame) -> DataFrame:
    """Where each source's sample ends, for ``sized(doc_id, source, size, u)``; one row a source.

    Columns: source, source_size, target, copies (certain ones), chances (by tier), slices, edge (the slice in which
    the sample ends), last (rank of the last document of that slice that is in; null if none is).
    """
    tiers = written(
        sized.groupBy("source", tier_column(F.col("size")).alias("tier")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    )
    n = tiers.agg(F.sum("rows")).first()[0] or 0
    slices = 1 << max(0, (max(MIN_SLICES, min(MAX_SLICES, n // SLICE_ROWS)) - 1).bit_length())
    targets = source_targets(tiers.groupBy("source").agg(F.sum("words").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = written(
        targets.select("source", "source_size", "target", F.floor(ratio).cast("long").alias("copies"))
        .withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    )
    needs = planned
    planned = written(by_source(needs, inclusion(tiers, needs), "left").withColumn("slices", F.lit(slices)))
    ranked = by_source(sized, planned.select("source", "chances", "need", "slices")).withColumn("x", rank_column())
    ranked = ranked.filter("x IS NOT NULL").withColumn("slice", slice_column())
    summed = ranked.groupBy("source", "slice", "need").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = summed.withColumn("end", F.sum("words").over(running)).withColumn("begin", F.col("end") - F.col("words"))
    edges = written(
        ends.filter((F.col("begin") <= F.col("need")) & (F.col("need") < F.col("end")))
        .select("source", F.col("slice").alias("edge"), "begin")
    )
    at_edge = (
        by_source(ranked, edges)
        .filter(F.col("slice") == F.col("edge"))
        .groupBy("source", F.struct("x", "u").alias("rank"), "begin", "need")
        .agg(F.sum("size").alias("size"))
    )
    in_order = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        at_edge.withColumn("middle", F.col("begin") + F.sum("size").over(in_order) - F.col("size") / 2)
        .filter(F.col("middle") < F.col("need"))
        .groupBy("source")
        .agg(F.max("rank").alias("last"))
    )
    # Where the need is all words, no slice is the edge and all are in.
    cuts = by_source(by_source(planned, edges.select("source", "edge"), "left"), last, "left")
    cuts = written(cuts.withColumn("edge", F.coalesce("edge", F.lit(slices + 1))).drop("need"))
    dropped(tiers, needs, planned, edges)
    return cuts


def slice_column() -> Column:
    return F.floor(F.col("x") / (1 + F.col("x")) * F.col("slices")).cast("int")


def by_source(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null; the table with a row a source is broadcast only if it is small."""
    right = per_source.withColumnRenamed("source", "_of")
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def taken_column() -> Column:
    """Words that the mix takes of a row with size, u, x and its source's cut."""
    share, rank = slice_column(), F.struct("x", "u")
    extra = F.coalesce((share < F.col("edge")) | ((share == F.col("edge")) & (rank <= F.col("last"))), F.lit(False))
    return ((F.col("copies") + extra.cast("long")) * F.col("size")).alias("taken")


def sized_documents(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        size_column(F.col("text")).alias("size"),
        uniform_column(F.col("doc_id"), F.col("text")).alias("u"),
        *more,
    )


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = written(sized_documents(docs))
    rows = by_source(sized, sample_cuts(sized)).withColumn("x", rank_column())
    return rows.select("doc_id", "size", "source_size", "target", taken_column())


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: every document of which words are taken, with its columns, size, source_size, target, taken."""
    sized = written(sized_documents(docs))
    cuts = sample_cuts(sized)
    dropped(sized)
    rows = by_source(sized_documents(docs, F.struct("*").alias("row")), cuts).withColumn("x", rank_column())
    fields = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    return (
        rows.withColumn("taken_words", taken_column())
        .filter((F.col("taken_words") > 0) | (F.col("size") == 0))
        .select(*fields, "size", "source_size", "target", F.col("taken_words").alias("taken"))
    )


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5)
           / {float(1 << 48)} AS u FROM documents),
z AS (SELECT *, (len(bin(size)) - 1) // {TIER_BITS} AS tier FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(f"{float(x)}" for x in WEIGHTS)}][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT]::DOUBLE AS weight,
             source_size * {float(MOST_COPIES)}::DOUBLE AS lim FROM s),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * {SHARE}::DOUBLE
             - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(lim, max(CASE WHEN lim / weight > level THEN level END) OVER () * weight), lim) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
n AS (SELECT *, target - copies * source_size AS need FROM p),
b AS (SELECT source, tier, pow(2.0::DOUBLE, -tier) AS weight, sum(size)::DOUBLE AS words FROM z GROUP BY source, tier),
v AS (SELECT b.*, (need - coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum(words * weight) OVER (PARTITION BY b.source ORDER BY tier ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
      FROM b JOIN n ON b.source IS NOT DISTINCT FROM n.source),
k AS (SELECT *, arg_min(level, tier) FILTER (WHERE NOT weight * level >= 1) OVER (PARTITION BY source) AS held FROM v),
c AS (SELECT source, tier, CASE WHEN held IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, held * weight)) END AS chance FROM k),
x AS (SELECT z.*, CASE WHEN size = 0 OR chance = 0 THEN NULL WHEN chance >= 1 THEN 0.0 ELSE (u / (1 - u)) / (chance / (1 - chance)) END AS x
      FROM z JOIN c ON z.source IS NOT DISTINCT FROM c.source AND z.tier = c.tier),
g AS (SELECT source, x, u, sum(size) AS size FROM x WHERE x IS NOT NULL GROUP BY source, x, u),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY x, u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 AS middle FROM g)
SELECT x.doc_id, x.size, source_size, target, (copies + CASE WHEN middle < need THEN 1 ELSE 0 END) * x.size AS taken
FROM x JOIN n ON x.source IS NOT DISTINCT FROM n.source LEFT JOIN o ON x.source IS NOT DISTINCT FROM o.source AND x.x = o.x AND x.u = o.u
"""
