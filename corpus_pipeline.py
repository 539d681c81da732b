"""Training-data pipeline: rules, line dedup, near duplicates, decontamination, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import contamination, jaccard, lines, mixing
from docloom.llm import quality as rules
from docloom.llm.contamination import decontaminated
from docloom.llm.jaccard import one_of_each
from docloom.llm.lines import without_repeated_lines
from docloom.llm.mixing import mixed
from docloom.llm.quality import quality_filter
from docloom.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are in an earlier window; one that loses all its words goes."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words taken of each."""
    return mixed(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", mix),
]

def _on(stage: str, sql: str) -> str:
    """An operator's SQL as a subquery that reads what a stage has kept as its documents."""
    return f"(WITH documents AS (SELECT * FROM {stage}) SELECT * FROM ({sql.strip()}))"


#: The operators' SQL, each on what the stage before it keeps; doc_id is unique in `documents`.
ORACLE_SQL = f"""
WITH s0 AS (SELECT * FROM documents),
s1 AS MATERIALIZED (SELECT s0.* FROM s0 JOIN {_on("s0", rules.SQL)} q ON q.doc_id = s0.doc_id WHERE q.kept),
s2 AS MATERIALIZED (SELECT s1.* REPLACE (q.text AS text, len(q.text)::BIGINT AS n_chars) FROM s1 JOIN {_on("s1", lines.SQL)} q ON q.doc_id = s1.doc_id
  WHERE q.n_removed = 0 OR regexp_matches(q.text, '[^\\x20\\x09-\\x0D]')),
s3 AS MATERIALIZED (SELECT s2.* FROM s2 JOIN {_on("s2", jaccard.SQL)} q ON q.doc_id = s2.doc_id WHERE q.class_id = s2.doc_id),
s4 AS MATERIALIZED (SELECT * FROM s3 WHERE doc_id NOT IN (SELECT doc_id FROM {_on("s3", contamination.SQL)} q))
SELECT s4.*, q.size, q.source_size, q.target, q.taken FROM s4 JOIN {_on("s4", mixing.SQL)} q ON q.doc_id = s4.doc_id WHERE q.taken > 0 OR q.size = 0
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
