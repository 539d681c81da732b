"""Tables that a job writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in one process, as in tests."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(table: DataFrame) -> DataFrame:
    """The table as written, for those who read it several times. Its lineage ends there."""
    folder = new_folder(table.sparkSession, "table")
    table.write.parquet(folder)
    out = table.sparkSession.read.schema(table.schema).parquet(folder)
    out.folder = folder
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
