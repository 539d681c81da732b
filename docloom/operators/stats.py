"""Statistics and audits over chunk tables. Aggregates combine before they shuffle; distinct tags have their own branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ordered import in_order, numbered


def kb_versions(version: Column) -> Column:
    """The tables a chunk belongs to: v5 and v6 for both."""
    return F.when(version == "both", F.array(F.lit("v5"), F.lit("v6"))).otherwise(F.array(version))


def by_kb(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("kb_version", F.explode(kb_versions(F.col("version"))))


def version_stats(chunks: DataFrame) -> DataFrame:
    """For each table: files, chunks, withCode, categories (sorted), tags (number of distinct ones)."""
    rows = by_kb(chunks.select("version", "sourceFile", "hasCode", "category", "tags"))
    main = rows.groupBy("kb_version").agg(
        F.countDistinct("sourceFile").alias("files"), F.count(F.lit(1)).alias("chunks"), F.count_if("hasCode").alias("withCode"),
        F.sort_array(F.collect_set("category")).alias("categories"),
    )
    # Not F.explode: the filter on empty arrays that Spark adds to it would compute the tags once more below.
    exploded = rows.select("kb_version", F.explode_outer("tags").alias("tag")).distinct()
    tags = exploded.groupBy("kb_version").agg(F.count("tag").alias("n"))
    return main.join(tags, "kb_version", "left").select(
        "kb_version", "files", "chunks", "withCode", "categories", F.coalesce("n", F.lit(0)).alias("tags")
    )


def file_summary(chunks: DataFrame) -> DataFrame:
    """For each file: chunks, tokens of the first, numbers of distinct categories, tags and sub-headings. One pass."""
    kinds = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    return chunks.groupBy("sourceFile").agg(
        F.count(F.lit(1)).alias("chunks"), F.min_by("tokens", "chunk_index").alias("first_tokens"),
        F.size(F.collect_set("category")).cast("long").alias("categories"), kinds("tags").alias("tags"),
        kinds("subHeadings").alias("subheadings"),
    )


def _category() -> Column:
    return F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized"))


def category_index(chunks: DataFrame) -> DataFrame:
    """For each category, the number of chunks and files; null and empty are uncategorized."""
    return chunks.groupBy(_category().alias("category")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("sourceFile").alias("files"))


def category_ids(chunks: DataFrame, size: int = 10_000) -> DataFrame:
    """(category, piece, ids): all ids of each category in order, in pieces of ``size``, however many a category has."""
    named = chunks.select(_category().alias("category"), F.coalesce("id", F.lit("")).alias("id"), "sourceFile", "chunk_index")
    ordered = numbered(in_order(named, "category", "id", "sourceFile", "chunk_index"))
    first = ordered.groupBy("category").agg(F.min("number").alias("first"))
    placed = ordered.join(first, "category").withColumn("piece", F.floor((F.col("number") - F.col("first")) / size))
    return placed.groupBy("category", "piece").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def id_cardinality(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def embedding_dim_audit(chunks: DataFrame) -> DataFrame:
    """Numbers of vectors by size, empty ones left out."""
    return chunks.select(F.size("embedding").alias("dim")).filter("dim > 0").groupBy("dim").agg(F.count(F.lit(1)).alias("n"))


def file_version_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("sourceFile").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("version") == v).alias(v) for v in ("v5", "v6", "both")]
    )
