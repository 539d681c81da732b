"""Document fingerprints (I-Match), with DataFrame functions only.

Terms whose inverse document frequency lies within a band are the lexicon: neither words of many documents nor words of next to
none. A text keeps its distinct terms that are in it, sorted, and its fingerprint is hashes of what it keeps within several
randomised subsets of the lexicon. One subset is the whole of it, whose hash tells equal sets. The others come in LISTS lists of
subsets with half, a quarter, an eighth ... of the terms each, drawn by the term's SHA-256, so that for a text of any length there
are subsets of which it has about one term: a text that keeps T terms is told by those whose share is 2 / T or less.
Two fingerprints are alike by the share of equal hashes among the subsets of which either text has a term (only those
that are small enough for both); that estimates how much of their terms they share, and is 1 for equal sets.

The lexicon is broadcast while it is small: terms in one of 2^MOST_BITS documents or more are at most
2^MOST_BITS times the mean number of distinct words. Beyond BROADCAST_TERMS the same join is left to Spark.

Neighbours. The next document in order of doc_id is found without a sort of all rows in one task: quantiles of doc_id (and of a hash of
the text, where one doc_id has many rows) cut the rows into ranges, each row is placed by binary search, and a range is one group
of a window. The first row of each range is also sent to the range before, as a neighbour only.

Defined results for odd input: a null text is empty; a null doc_id comes first; rows of one doc_id come in order of a hash of their
texts, then of the text; rows that are equal in both are one document, of which each gets the same result; a text without a term
of the lexicon is told by itself alone (likeness 1 or 0); a single document is its own neighbour; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.shared import written

SPACES = r"[\x20\x09-\x0D]+"
#: The band: terms in at most one of 2^LEAST_BITS documents and at least one of 2^MOST_BITS.
LEAST_BITS, MOST_BITS = 3, 12
#: Lists of randomised subsets; each takes four hex digits of a term's digest, whose leading zero bits are the subset it is in.
LISTS, TOP = 16, 15
BROADCAST_TERMS = 1_000_000
#: Documents in a range, and the most ranges.
RANGE_ROWS, MOST_RANGES = 64, 1 << 16
_LEAST_LONG = -(1 << 63)


def words(text: Column) -> Column:
    """Distinct words."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != ""))


def lexicon(docs: DataFrame, least_bits: int = LEAST_BITS, most_bits: int = MOST_BITS) -> DataFrame:
    """(term, levels): the terms of the band; four bits of levels for each list tell the subset."""
    n = docs.count()
    counts = docs.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("df") * (1 << least_bits) <= n) & (F.col("df") * (1 << most_bits) >= n))
    named = band.select("term", F.sha2(F.col("term").cast("binary"), 256).alias("digest"))
    level = lambda j: 16 - F.length(F.bin(F.conv(F.substring("digest", 4 * j + 1, 4), 16, 10).cast("long")))
    levels = F.lit(0).cast("long")
    for j in range(LISTS):
        levels = levels.bitwiseOR(F.shiftleft(level(j).cast("long"), 4 * j))
    return named.select("term", levels.alias("levels"))


def fingerprint(kept: Column, otherwise: Column) -> Column:
    """``whole/first/hashes`` of an array of (term, levels) in order of the term; a text that keeps none is told by ``otherwise``.

    whole is a hash of all terms, first the first subset of each list that is told; hashes have ten characters for each subset
    that has a term: two digits each for list and subset, and a hash.
    """
    size = F.size(kept)
    whole = F.when(size > 0, F.md5(F.array_join(F.transform(kept, lambda t: t["term"]), " "))).otherwise(otherwise)
    first = F.when(size > 1, F.least(F.floor(F.log2(size + F.lit(0.5))) - 1, F.lit(TOP))).otherwise(F.lit(0)).cast("int")
    level = lambda t, j: F.shiftrightunsigned(t["levels"], 4 * j).bitwiseAND(F.lit(15)).cast("int")

    def of_list(x: Column, j: int) -> Column:
        own = F.filter(x["kept"], lambda t: level(t, j) >= x["first"])
        return F.transform(own, lambda t: F.struct((level(t, j) + 100 * j).alias("p"), t["term"].alias("t")))

    def hashes(x: Column) -> Column:
        return F.array_join(F.transform(F.array(*[of_list(x, j) for j in range(LISTS)]), lambda ts: F.array_join(_subset_hashes(ts), "")), "")

    told = F.transform(F.array(F.struct(kept.alias("kept"), first.alias("first"))), hashes)[0]
    return F.concat_ws("/", whole, first, told)


def _subset_hashes(terms: Column) -> Column:
    """Number and hash of each subset of (p, t), those of one list, in order."""
    of = lambda p: F.transform(F.filter(terms, lambda x: x["p"] == p), lambda x: x["t"])
    return F.transform(
        F.array_sort(F.array_distinct(F.transform(terms, lambda x: x["p"]))),
        lambda p: F.concat(F.lpad(p.cast("string"), 4, "0"), F.substring(F.md5(F.array_join(of(p), " ")), 1, 6)),
    )


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1."""
    part = lambda f, i: F.get(F.split(f, "/"), i)
    first = F.greatest(part(a, 1).cast("int"), part(b, 1).cast("int"))
    hashes = lambda f: F.filter(F.regexp_extract_all(part(f, 2), F.lit("(.{10})"), 1), lambda h: F.substring(h, 3, 2).cast("int") >= first)
    place = lambda hs: F.transform(hs, lambda h: F.substring(h, 1, 4))
    share = lambda x: F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(place(x["a"]), place(x["b"])))
    both = F.array(F.struct(hashes(a).alias("a"), hashes(b).alias("b")))
    # Through a lambda's variable, so that the arrays are made once.
    some = F.transform(both, lambda x: F.when(F.size(x["a"]) + F.size(x["b"]) > 0, share(x)).otherwise(F.lit(0.0)))[0]
    return F.when(part(a, 0) == part(b, 0), F.lit(1.0)).otherwise(some)


def _nth_key(keys: list[tuple], n: Column) -> Column:
    """The n-th of sorted keys (doc_id, h), which are constants of the plan."""
    d, h = (F.split(F.lit(",".join("" if k[i] is None else str(k[i]) for k in keys)), ",").try_cast("array<long>") for i in (0, 1))
    return F.struct(F.get(d, n).alias("doc_id"), F.get(h, n).alias("h"))


def _searched(keys: list[tuple], key: Column) -> Column:
    """The place of the last of the sorted keys that is not above ``key``, from 0; -1 if all are above. By bisection."""

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        above = _nth_key(keys, middle) > key
        narrower = F.struct(F.when(above, s["lo"]).otherwise(middle + 1).alias("lo"), F.when(above, middle).otherwise(s["hi"]).alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).otherwise(narrower)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(keys)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(keys).bit_length())), start, halved, lambda s: s["lo"] - 1)


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (zone, ghost, doc_id, h, text, copies), partitioned by zone; zones are ranges that follow each other.

    Each distinct row is there once, with its number, and the first one of a zone once more, as a ghost in the zone before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    ids = rows.select("doc_id", "h")
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    cuts = ids.select(F.percentile_approx(F.coalesce("doc_id", F.lit(_LEAST_LONG)), shares, max(10_000, 4 * ranges)).alias("c")).first()["c"]
    # A doc_id that is several cuts has so many ranges' rows, which the hash divides.
    wanted = [(d, _LEAST_LONG + (i << 64) // k) for d, k in sorted(Counter(cuts or []).items()) for i in range(k)]
    # The bounds that count are the first rows that are there.
    coarse = _searched(wanted, F.struct(F.coalesce("doc_id", F.lit(_LEAST_LONG)).alias("doc_id"), "h")) if wanted else F.lit(-1)
    firsts = ids.select(coarse.alias("z"), F.struct("doc_id", "h").alias("key")).groupBy("z").agg(F.min("key").alias("key")).orderBy("z").collect()
    bounds = [(r.key.doc_id, r.key.h) for r in firsts] or [(None, 0)]
    # Rows that are there more often than a range has rows are counted where they lie. There are fewer of them than ranges.
    often = ids.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > max(RANGE_ROWS, n // ranges)).select("doc_id", "h").collect()
    single = rows.withColumn("copies", F.lit(1).cast("long"))
    if often:
        frequent = F.broadcast(docs.sparkSession.createDataFrame(often, "d long, g long"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
        counted = rows.join(frequent, same, "left_semi").groupBy("doc_id", "h", "text").agg(F.count(F.lit(1)).alias("copies"))
        single = single.join(frequent, same, "left_anti").unionByName(counted)
    zone = F.greatest(_searched(bounds, F.struct("doc_id", "h")), F.lit(0))
    placed = single.withColumn("zone", zone)
    own = F.struct(F.col("zone").alias("zone"), F.lit(0).alias("ghost"))
    before = F.struct(F.pmod(F.col("zone") - 1, F.lit(len(bounds))).alias("zone"), F.lit(1).alias("ghost"))
    is_first = _nth_key(bounds, F.col("zone")) == F.struct("doc_id", "h")
    sent = placed.select("doc_id", "h", "text", "copies", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    dealt = sent.select("to.zone", "to.ghost", "doc_id", "h", "text", "copies").repartition("zone")
    return dealt.groupBy("zone", "ghost", "doc_id", "h", "text").agg(F.sum("copies").alias("copies"))


def fingerprints(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """For each document of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, the fingerprints of its text and its edited
    text, and the likeness of its fingerprint to that and to the next document's.

    The edited text is the text with its last half replaced by the beginning of the next document's. ``terms`` is the lexicon, by
    default that of ``docs``.
    """
    docs = docs.select("doc_id", "text")
    table = written(lexicon(docs) if terms is None else terms)
    known = F.broadcast(table) if table.count() <= BROADCAST_TERMS else table
    order = Window.partitionBy("zone").orderBy("ghost", "doc_id", "h", "text")
    rows = in_ranges(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("zone", "ghost", "doc_id", "copies", "text", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("after"))
    rows = rows.withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.when(F.col("ghost") == 0, F.concat(F.expr("substring(text, 1, n_chars - n_chars div 2)"), F.expr("substring(after, 1, int(n_chars div 2))")))
    rows = rows.withColumn("edited", edited)
    facts = F.struct("ghost", "doc_id", "copies", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    each = rows.select("zone", "row", facts.alias("facts"), F.inline(texts)).filter("t IS NOT NULL")
    each = each.select("zone", "row", "which", F.struct("facts", F.md5(F.col("t").cast("binary")).alias("itself")).alias("about"), words(F.col("t")).alias("w"))
    single = each.select("zone", "row", "which", "about", F.posexplode_outer("w").alias("at", "term"))
    single = single.select("zone", "row", "which", "term", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("about")).alias("about"))
    found = single.join(known, "term", "left").groupBy("zone", "row", "which").agg(
        F.first("about", ignorenulls=True).alias("about"),
        F.array_sort(F.collect_list(F.when(F.col("levels").isNotNull(), F.struct("term", "levels")))).alias("kept"),
    )
    made = found.select("zone", "row", "which", "about.facts", fingerprint(F.col("kept"), F.col("about.itself")).alias("f"))
    pairs = made.groupBy("zone", "row").agg(
        F.first("facts").alias("facts"), F.max(F.when(F.col("which") == 0, F.col("f"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("f"))).alias("edited_fingerprint"),
    )
    beside = pairs.withColumn("after", F.lead("fingerprint").over(Window.partitionBy("zone").orderBy("row")))
    out = beside.filter("facts.ghost = 0").select(
        "facts.doc_id", "facts.n_chars", "facts.edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after")).alias("near_next"), F.col("facts.copies").alias("copies"),
    )
    return out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("_", "copies")


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    level = lambda j: f"16 - len(bin(('0x' || substr(sha256(term), {4 * j + 1}, 4))::BIGINT))"
    levels = "[" + ", ".join(level(j) for j in range(LISTS)) + "]"
    hashes = lambda f, first: f"list_filter(regexp_extract_all(split_part({f}, '/', 3), '.{{10}}'), lambda h: substr(h, 3, 2)::INT >= {first})"

    def like(a: str, b: str) -> str:
        first = f"greatest(split_part({a}, '/', 2)::INT, split_part({b}, '/', 2)::INT)"
        x, y = hashes(a, first), hashes(b, first)
        places = f"len(list_distinct(list_transform({x} || {y}, lambda h: substr(h, 1, 4))))"
        return f"CASE WHEN split_part({a}, '/', 1) = split_part({b}, '/', 1) THEN 1.0 ELSE coalesce(len(list_intersect({x}, {y}))::DOUBLE / nullif({places}, 0), 0) END::DOUBLE"

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM d),
e AS (SELECT doc_id, text, substr(text, 1, (len(text) - len(text) // 2)::BIGINT) || substr(after, 1, (len(text) // 2)::BIGINT) AS edited FROM n),
w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[ 	-
]+')) AS term FROM d),
lexicon AS MATERIALIZED (SELECT term, {levels} AS levels FROM (SELECT term, count(*) AS df FROM w WHERE term <> '' GROUP BY term)
  WHERE df * {1 << LEAST_BITS} <= (SELECT count(*) FROM d) AND df * {1 << MOST_BITS} >= (SELECT count(*) FROM d)),
t AS (SELECT doc_id, 0 AS which, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
k AS MATERIALIZED (SELECT DISTINCT doc_id, which, term, levels FROM (SELECT doc_id, which, unnest(string_split_regex(t, '[ 	-
]+')) AS term FROM t) JOIN lexicon USING (term)),
s AS (SELECT doc_id, which, md5(string_agg(term, ' ' ORDER BY term)) AS whole,
        CASE WHEN count(*) > 1 THEN least(floor(log2(count(*) + 0.5)) - 1, {TOP}) ELSE 0 END::INT AS first FROM k GROUP BY ALL),
p AS (SELECT doc_id, which, list AS j, levels[list + 1] AS level, md5(string_agg(term, ' ' ORDER BY term)) AS h
  FROM k JOIN s USING (doc_id, which), (SELECT unnest(range({LISTS})) AS list) WHERE levels[list + 1] >= first GROUP BY ALL),
f AS (SELECT doc_id, which, string_agg(lpad((100 * j + level)::VARCHAR, 4, '0') || substr(h, 1, 6), '' ORDER BY j, level) AS hashes FROM p GROUP BY ALL),
g AS MATERIALIZED (SELECT t.doc_id, t.which, coalesce(whole, md5(t)) || '/' || coalesce(first, 0) || '/' || coalesce(hashes, '') AS f
  FROM t LEFT JOIN s ON s.doc_id = t.doc_id AND s.which = t.which LEFT JOIN f ON f.doc_id = t.doc_id AND f.which = t.which),
x AS (SELECT a.doc_id, a.f AS fingerprint, b.f AS edited_fingerprint, coalesce(lead(a.f) OVER (ORDER BY a.doc_id), first_value(a.f) OVER (ORDER BY a.doc_id)) AS after
  FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.which = 0 AND b.which = 1)
SELECT x.doc_id, len(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, fingerprint, edited_fingerprint,
  {like("fingerprint", "edited_fingerprint")} AS near_edited, {like("fingerprint", "after")} AS near_next FROM x JOIN e USING (doc_id)
"""


SQL = _sql()
