"""A chunk table in buckets of source files, of which a merge rewrites those that it touches.

``data/bucket=b/generation=g`` holds what bucket b was from merge g on. A merge overwrites only partitions of its own generation, so it
can run again after a failure, and then adds the numbered folder ``pointers/n=g``, which names the generation of every bucket and the
last batch of every stream that has been merged. Readers take the highest number, so they see all of a merge or nothing.
For one writer at a time. The generations of the merge before stay for those who still read them; older ones are deleted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.operators.maintenance import replace_by_source
from docloom.sources.scratch import removed, stored

BUCKETS = 64
_POINTER = "generations array<long>, done map<string, long>"


def _state(spark: SparkSession, target: str, back: int = 0) -> Row | None:
    """The newest pointer, or one of those before it: n, generations (-1: an empty bucket), done."""
    try:
        pointers = spark.read.schema(_POINTER + ", n long").json(f"{target}/pointers")
        return next(iter(pointers.orderBy(F.desc("n")).limit(back + 1).collect()[back:]), None)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _rows(spark: SparkSession, target: str, state: Row | None, buckets: list[int] | None = None) -> DataFrame | None:
    """All rows, or those of some buckets; None where there are none."""
    wanted = [(b, g) for b, g in enumerate(state.generations if state else []) if g >= 0 and (buckets is None or b in buckets)]
    paths = [f"{target}/data/bucket={b}/generation={g}" for b, g in wanted]
    return spark.read.option("basePath", f"{target}/data").parquet(*paths).drop("generation") if paths else None


def read_buckets(spark: SparkSession, target: str) -> DataFrame:
    found = _rows(spark, target, _state(spark, target))
    if found is None:
        raise ValueError(f"{target} has no rows yet")
    return found.drop("bucket")


def merge_into_buckets(fresh: DataFrame, target: str, stream: str, batch_id: int, buckets: int = BUCKETS) -> list[int]:
    """Replaces the files of ``fresh`` by its chunks; returns the buckets that were rewritten. A batch that was merged before changes nothing."""
    spark, state = fresh.sparkSession, _state(fresh.sparkSession, target)
    if state and (state.done or {}).get(stream, -1) >= batch_id:
        return []
    count = len(state.generations) if state else buckets
    fresh = stored(fresh.withColumn("bucket", F.pmod(F.xxhash64("sourceFile"), F.lit(count)).cast("int")))
    touched = sorted(r[0] for r in fresh.filter(F.col("version").isin("v5", "v6")).select("bucket").distinct().collect())
    n = state.n + 1 if state else 0
    generations = list(state.generations) if state else [-1] * count
    if touched:
        old = _rows(spark, target, state, touched)
        merged = replace_by_source(fresh.limit(0) if old is None else old.select(fresh.columns), fresh)
        rows = merged.withColumn("generation", F.lit(n)).repartition("bucket", F.pmod(F.xxhash64("sourceFile", F.lit(1)), F.lit(8)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(f"{target}/data")
        generations = [n if b in touched else g for b, g in enumerate(generations)]
    done = {**(state.done or {}), stream: batch_id} if state else {stream: batch_id}
    spark.createDataFrame([(generations, done)], _POINTER).coalesce(1).write.mode("overwrite").json(f"{target}/pointers/n={n}")
    removed(fresh)
    _retire(spark, target, state)
    return touched


def _retire(spark: SparkSession, target: str, before: Row | None) -> None:
    """Deletes what only merges before ``before``, the pointer that has just been followed by another, name."""
    older = _state(spark, target, 2) if before else None
    if older is None:
        return
    gone = [f"{target}/data/bucket={b}/generation={g}" for b, g in enumerate(older.generations) if g >= 0 and before.generations[b] != g]
    for folder in [*gone, f"{target}/pointers/n={older.n}"]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
