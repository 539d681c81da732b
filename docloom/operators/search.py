"""Batches of similarity and keyword searches over a chunk table.

Chunks are never multiplied with queries in a table, and queries never pass the driver: tiles of queries meet shares of the chunks,
see `tiles`, and each share keeps its best k for each query.

Defined results for odd input: chunks without a vector, or with one of another size, are skipped; ties go by
(sourceFile, chunk_index); an empty query has no hits; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import trimmed
from docloom.operators.postings import Index, chunk_texts, word_matches, word_scorer, words_of
from docloom.operators.tiles import best_by_tiles, count_scorer, dot_scorer
from docloom.sources.scratch import stored

CANDIDATES, MIN_SCORE, PER_SOURCE, MAX_LIMIT, DEFAULT_LIMIT = 50, 0.05, 2, 50, 10


def normalize_queries(queries: DataFrame) -> DataFrame:
    """``queries(query_id, query, version, limit, tokens_budget)`` in canonical form; empty ones go."""
    q = trimmed(F.coalesce(F.col("query"), F.lit("")))
    limit = F.col("limit").cast("double")
    fine = limit.isNotNull() & ~F.isnan(limit) & (limit > 0) & (limit < float("inf"))
    budget = F.col("tokens_budget").cast("double")
    return queries.select(
        "query_id",
        q.alias("query"),
        F.when(F.col("version").isin("v5", "v6", "both", "all"), F.col("version")).otherwise("all").alias("version"),
        F.when(fine, F.least(F.floor(limit), F.lit(MAX_LIMIT))).otherwise(F.lit(DEFAULT_LIMIT)).cast("int").alias("limit"),
        F.when(budget > 0, F.floor(budget)).otherwise(F.lit(0)).cast("long").alias("tokens_budget"),
    ).filter("query != ''")


def filter_by_version(query_version: Column, chunk_version: Column) -> Column:
    return query_version.isin("all", "both") | (chunk_version == query_version) | (chunk_version == "both")


def dot_similarity(a: Column, b: Column) -> Column:
    """Dot product in double; 0 if the sizes differ."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(product, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.col("sourceFile"), F.col("chunk_index")]


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES, min_score: float = MIN_SCORE) -> DataFrame:
    """Best k chunks for each of ``queries(query_id, version, embedding)``, with score and rank."""
    asked = queries.filter(F.size("embedding") > 0).select("query_id", "version", F.col("embedding").cast("array<double>").alias("asked"))
    rows = chunks.filter(F.size("embedding") > 0).select("sourceFile", "chunk_index", "version", F.col("embedding").alias("told"))
    return _ranked(best_by_tiles(asked, rows, dot_scorer, k, min_score), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*rank_order())
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def normalize_scores(hits: DataFrame) -> DataFrame:
    """Scores over the query's best, to six digits; as they are if the best is not above 0."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("top", top).withColumn(
        "score", F.when(F.col("top") > 0, F.floor(F.col("score") / F.col("top") * 1e6 + 0.5) / 1e6).otherwise(F.col("score"))
    ).drop("top")


def cap_per_source(hits: DataFrame, n: int = PER_SOURCE) -> DataFrame:
    w = Window.partitionBy("query_id", "sourceFile").orderBy("rank")
    return hits.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).drop("nth")


def token_budget(hits: DataFrame, strict: bool = False) -> DataFrame:
    """In rank order, hits while the tokens before them are below ``tokens_budget`` (0: no budget).

    The last one may overshoot unless ``strict``, which counts the hit itself.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if strict else -1)
    used = F.coalesce(F.sum("tokens").over(frame), F.lit(0))
    fits = used <= F.col("tokens_budget") if strict else used < F.col("tokens_budget")
    return hits.withColumn("fits", (F.col("tokens_budget") <= 0) | fits).filter("fits").drop("fits")


def limit_and_project(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first ``limit`` hits of each query, joined with what the chunks say."""
    w = Window.partitionBy("query_id").orderBy("rank")
    few = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("limit"))
    empty = F.array().cast("array<string>")
    payload = chunks.select(
        "sourceFile", "chunk_index", "id", "heading", "breadcrumb", F.col("content"),
        F.coalesce("category", F.lit("uncategorized")).alias("category"),
        F.coalesce("subHeadings", empty).alias("covers"), F.coalesce("tags", empty).alias("tags"),
    )
    return few.join(payload, ["sourceFile", "chunk_index"])


def pipeline(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked hits with normalised scores, cap, budget and limit; payload not yet joined."""
    told = queries.select("query_id", "limit", "tokens_budget")
    sizes = chunks.select("sourceFile", "chunk_index", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    capped = cap_per_source(normalize_scores(hits))
    kept = token_budget(capped.join(sizes, ["sourceFile", "chunk_index"]).join(told, "query_id"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("limit"))


def search(queries: DataFrame, chunks: DataFrame, embed) -> DataFrame:
    """Results for raw queries; ``embed`` maps a text column to a vector column. ``chunks`` is read three times: pass a stored table."""
    q = normalize_queries(queries)
    hits = vector_topk(q.withColumn("embedding", embed(F.col("query"))), chunks)
    return limit_and_project(pipeline(hits, q, chunks), chunks)


def search_response(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One JSON a query: query, version, results in rank order, totalTokens, count."""
    hit = F.struct("rank", "id", "heading", "breadcrumb", "category", "tokens", "score", "covers", "tags", "content", "sourceFile")
    made = results.groupBy("query_id").agg(
        F.sort_array(F.collect_list(hit)).alias("results"), F.sum("tokens").alias("totalTokens"), F.count(F.lit(1)).alias("count")
    )
    rows = queries.select("query_id", "query", "version").join(made, "query_id", "left")
    body = F.struct(
        "query", "version", F.coalesce("results", F.array()).alias("results"),
        F.coalesce("totalTokens", F.lit(0)).alias("totalTokens"), F.coalesce("count", F.lit(0)).alias("count"),
    )
    return rows.select("query_id", F.to_json(body).alias("response"))


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_LIMIT, index: Index | None = None) -> DataFrame:
    """Chunks by the number of a query's words (repeated ones count) that occur in heading and text, as parts of words, too.

    Texts meet the queries in tiles: they travel once for each tile of queries, and nothing is stored. With ``index``, the `piece_index` of
    the chunks, texts are read only where a word's rarest piece is, however many queries ask for it: for many searches, or rare words.
    """
    asked = queries.select("query_id", F.coalesce("version", F.lit("all")).alias("version"), words_of(F.col("query")).alias("asked")).filter(F.size("asked") > 0)
    if index is None:
        return _ranked(best_by_tiles(asked, chunk_texts(chunks).withColumnRenamed("text", "told"), word_scorer, k, 1.0), k)
    asked = stored(asked.withColumn("_query", F.monotonically_increasing_id()))
    words = asked.select("_query", F.explode("asked").alias("word"))
    terms = stored(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    wanted = words.join(terms, "word").groupBy("_query").agg(F.collect_list("term").alias("asked"))
    rows = word_matches(index, terms).drop("n")
    sent = asked.drop("asked").join(wanted, "_query").select("query_id", "version", "asked")
    return _ranked(best_by_tiles(sent, rows, count_scorer, k, 1.0), k)
