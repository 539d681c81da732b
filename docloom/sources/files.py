"""Readers of markdown trees and chunk files, and writers of tables, stats, outcomes and snapshots."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.rules import SKIP_DIRS
from docloom.operators.stats import by_kb
from docloom.sources.tree import list_files, with_texts

CHUNK_SCHEMA = (
    "id string, content string, rawContent string, breadcrumb string, version string, sourceFile string, heading string, "
    "subHeadings array<string>, hasCode boolean, codeLanguages array<string>, tokens int, category string, tags array<string>, "
    "embedding array<float>, chunk_index int"
)


def _exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that Spark reads from, whichever it is."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def read_markdown_corpus(spark: SparkSession, roots: list[str], skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """(path, text) of all .md files below the roots that exist, but for hidden and skipped directories.

    File names may begin with _ or a dot. A path is its root as it was given, then what is below.
    """
    return with_texts(list_files(spark, roots, skip, ".md"))


def _chunk_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, value, entries): the files below a root as texts, and how many entries a file has if it is an array."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string, value string, entries int")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), "value", F.json_array_length("value").alias("entries"))


def read_chunks(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """The chunks of all files below a root that are JSON arrays.

    Entries that are no objects or have no id are left out; a field of another type than it should have is null.
    """
    rows = _chunk_texts(spark, root, pattern).filter("entries IS NOT NULL")
    each = rows.select(F.explode(F.from_json("value", "array<string>")).alias("entry")).filter(F.col("entry").startswith("{"))
    return each.select(F.from_json("entry", CHUNK_SCHEMA).alias("c")).select("c.*").filter("id IS NOT NULL")


def unread_chunk_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, reason): the files below a root that `read_chunks` leaves out: broken, or no array."""
    other = F.json_object_keys("value").isNotNull() | F.try_parse_json("value").isNotNull()
    return _chunk_texts(spark, root, pattern).filter("entries IS NULL").select("path", F.when(other, "no array").otherwise("no JSON").alias("reason"))


def read_chunk_file(spark: SparkSession, root: str, category: str, file: str) -> DataFrame:
    """One file; a missing one is empty, and one that is not JSON raises."""
    path = f"{root.rstrip('/')}/{category}/{file}"
    if not _exists(spark, path):
        return spark.createDataFrame([], CHUNK_SCHEMA)
    return spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, out: str, files_per_version: int = 8, form: str = "parquet") -> None:
    """A directory a version, a chunk of both in v5 and v6. Few versions are spread over several files by a salt."""
    rows = by_kb(chunks)
    salt = F.pmod(F.xxhash64("sourceFile"), F.lit(files_per_version))
    rows.repartition("kb_version", salt).write.mode("overwrite").partitionBy("kb_version").format(form).save(out)


def write_kb_metadata(stats: DataFrame, out: str, last_changed: list[str] | None = None) -> None:
    """Statistics, a row a version, with the time; after an incremental run also what changed."""
    rows = stats.withColumn("generated", F.current_timestamp())
    if last_changed is not None:
        rows = rows.withColumn("lastIncrementalUpdate", F.current_timestamp()).withColumn(
            "lastChangedFiles", F.array(*[F.lit(x) for x in last_changed]).cast("array<string>")
        )
    rows.coalesce(1).write.mode("overwrite").json(out)


def write_outcomes(outcomes: DataFrame, out: str, batch_id: int | None = None) -> None:
    """Staged payloads of judged requests, by operation and status; with a batch's id in a folder of its own, which it overwrites."""
    payload = F.struct(*[F.col(c) for c in outcomes.columns if c not in ("op", "status")])
    rows = outcomes.select("op", "status", F.current_timestamp().alias("timestamp"), payload.alias("request"))
    folder, mode = (out, "append") if batch_id is None else (f"{out}/batch={batch_id}", "overwrite")
    rows.write.mode(mode).partitionBy("op", "status").json(folder)


def _pointers(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("n long, name string").json(f"{target}/pointers")


def swap_snapshot(table: DataFrame, target: str) -> str:
    """Writes a new snapshot below ``target`` and then points to it, for one writer at a time.

    Pointers are numbered rows that are only added, and the highest counts, so a reader finds the old snapshot or the new
    one and never neither. The snapshot before the new one stays for those who still read it; older ones are deleted.
    """
    spark, name = table.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    table.write.parquet(f"{target}/{name}")
    known = _pointers(spark, target).orderBy(F.desc("n")).limit(3).collect() if _exists(spark, f"{target}/pointers") else []
    spark.createDataFrame([(known[0]["n"] + 1 if known else 0, name)], "n long, name string").coalesce(1).write.mode("append").json(f"{target}/pointers")
    for old in known[1:]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{old['name']}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return name


def read_snapshot(spark: SparkSession, target: str) -> DataFrame:
    name = _pointers(spark, target).orderBy(F.desc("n")).first()["name"]
    return spark.read.parquet(f"{target}/{name}")
