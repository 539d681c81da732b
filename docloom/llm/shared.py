"""Tables written between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and all runs in one process, as in tests, one of our own."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/docloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter that `marked` broadcasts: 4 MB in rows of 64, however many keys there are.
FILTER_BITS = 1 << 25


def marked(rows: DataFrame, key: Column, keys: DataFrame, of: Column) -> DataFrame:
    """``rows`` with a column ``maybe``: false where the hash ``key`` is none of the hashes ``of`` of ``keys``.

    A Bloom filter with one hash: rows that are surely without a partner need no shuffle. With more keys than bits it
    says less, and the join that follows does the rest.
    """
    slot = lambda h: F.pmod(h, F.lit(FILTER_BITS))
    bits = (
        keys.select(slot(of).alias("slot"))
        .groupBy(F.floor(F.col("slot") / 64).alias("filter_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("filter_bits"))
    )
    placed = rows.withColumn("filter_slot", slot(key)).withColumn("filter_word", F.floor(F.col("filter_slot") / 64))
    joined = placed.join(F.broadcast(bits), "filter_word", "left")
    hit = F.expr("coalesce(getbit(filter_bits, cast(filter_slot % 64 AS int)), 0) = 1")
    return joined.withColumn("maybe", hit).drop("filter_slot", "filter_word", "filter_bits")


def settled(df: DataFrame) -> DataFrame:
    """``df``, with its columns computed before any later filter looks at them.

    Spark moves a filter below projections by putting their expressions into it. A lambda that reads an array
    column would then compute the array anew for each element. A row number that is only known at
    run time, and that a filter reads, keeps later filters above.
    """
    number = "_settled_row"
    return df.withColumn(number, F.monotonically_increasing_id()).filter(F.col(number) >= 0).drop(number)
