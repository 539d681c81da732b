"""Upserts, deletes and synchronisation of chunk tables. Only keys of the change are compared with the table.

Defined results for odd input: null paths match nothing; repeated rows of a change act once; an empty change leaves the
table as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.stats import by_kb


def changed_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The markdown files that are in a list of paths."""
    listed = paths.filter(F.col("path").endswith(".md")).select("path")
    return files.join(listed, "path", "left_semi")


def detect_changes(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """(path, change) by digests of the content: added, changed or deleted."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    a = prev.filter(F.col("path").endswith(".md")).select("path", digest.alias("was"))
    b = curr.filter(F.col("path").endswith(".md")).select("path", digest.alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change IS NOT NULL")


def replace_by_source(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without the chunks of files that are in ``new``, and ``new``; unversioned files are skipped."""
    fresh = new.filter(F.col("version").isin("v5", "v6"))
    keys = fresh.select("sourceFile").distinct()
    return old.join(keys, "sourceFile", "left_anti").select(old.columns).unionByName(fresh.select(old.columns))


def merge_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each version: chunks removed, added, and in the table after the merge."""
    fresh = new.filter(F.col("version").isin("v5", "v6"))
    keys = fresh.select("sourceFile").distinct()
    gone = old.join(keys, "sourceFile", "left_semi").select("version", F.lit(1).alias("removed"), F.lit(0).alias("added"), F.lit(0).alias("kept"))
    here = old.join(keys, "sourceFile", "left_anti").select("version", F.lit(0), F.lit(0), F.lit(1))
    come = fresh.select("version", F.lit(0), F.lit(1), F.lit(0))
    tagged = gone.union(come).union(here)
    return tagged.groupBy("version").agg(
        F.sum("removed").alias("removed"), F.sum("added").alias("added"), F.sum(F.col("kept") + F.col("added")).alias("total")
    )


def remove_by_source(chunks: DataFrame, removals: DataFrame) -> DataFrame:
    """The table by version (kb_version) without the files named for it in ``removals(sourceFile, kb_version)``."""
    return by_kb(chunks).join(removals.select("sourceFile", "kb_version"), ["sourceFile", "kb_version"], "left_anti")


def removal_counts(chunks: DataFrame, removals: DataFrame) -> DataFrame:
    """Chunks that each removal takes away; 0 means that nothing is written."""
    n = by_kb(chunks).groupBy("sourceFile", "kb_version").agg(F.count(F.lit(1)).alias("n"))
    asked = removals.select("sourceFile", "kb_version").distinct()
    return asked.join(n, ["sourceFile", "kb_version"], "left").select("sourceFile", "kb_version", F.coalesce("n", F.lit(0)).alias("removed"))


def sync_plan(state: DataFrame, remote: DataFrame, now: Column, ttl_hours: float | None = 24) -> DataFrame:
    """What to do for each kb of ``remote``: refresh, touch or nothing (fresh), and the hours that are left."""
    ttl = ttl_hours if ttl_hours and ttl_hours > 0 else 24
    told = remote.select("kb", F.coalesce("lastIncrementalUpdate", "generated", F.lit("")).alias("remote_version"))
    rows = told.join(state.select("kb", "last_synced", F.col("remote_version").alias("local_version")), "kb", "left")
    age = (F.unix_micros(now) - F.unix_micros("last_synced")) / 3.6e9
    stale = F.col("age_hours").isNull() | (F.col("age_hours") > ttl)
    return rows.withColumn("age_hours", age).select(
        "kb", "remote_version",
        F.when(~stale, "fresh").when(F.col("local_version") == F.col("remote_version"), "touch").otherwise("refresh").alias("action"),
        F.when(stale, F.lit(0)).otherwise(F.ceil(F.lit(float(ttl)) - F.col("age_hours"))).cast("long").alias("hours_left"),
    )
