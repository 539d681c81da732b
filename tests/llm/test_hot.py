"""What grows with one hot group: splits of its join, and time for long texts."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from docloom.llm import contamination, jaccard, lines, lm, substrings


def test_a_common_window_is_split(spark):
    """The join on a window that most documents have is split by adaptive execution."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    docs = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("one\ntwo\nthree\n"), F.col("id")).alias("text"))
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        gone = lines.removed_lines(docs)
        assert len(gone.collect()) == 19_999
        assert "skew=true" in gone._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in low:
            spark.conf.unset(k)


def test_short_items_in_a_long_text(spark):
    """An item of two words is found in a text of 40,000, in well under the time that a look at each place by itself takes."""
    words = " ".join(f"w{i % 5000}" for i in range(40_000))
    docs = spark.createDataFrame([(1, words + " tiny item"), (2, words)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "tiny item"), (8, "not there"), (9, "item")], "item_id long, text string")
    contamination.decontaminated(docs, items).count()
    began = time.time()
    assert [r.doc_id for r in contamination.decontaminated(docs, items).select("doc_id").collect()] == [2]
    assert time.time() - began < 6


def doubling_words() -> tuple[str, str]:
    """Two words of 1024 letters, in the pattern that doubles itself, whose sums of powers of one base are equal modulo 2**64."""
    x, y = "ab", "ba"
    for _ in range(9):
        x, y = x + y, y + x
    return x, y


def test_words_in_a_doubling_pattern_are_apart(spark):
    """They are no near copies, no benchmark items and no tokens of each other, nor parts of repeated passages."""
    x, y = doubling_words()
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{y} {y}"), (5, x)], "doc_id long, text string")
    links = {r.doc_id: (r["class"].id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert links[1][0] == links[5][0] and len({links[k][0] for k in (1, 2, 3)}) == 3
    items = spark.createDataFrame([(7, x)], "item_id long, text string")
    assert {r.doc_id for r in contamination.decontaminated(docs, items).select("doc_id").collect()} == {2, 3}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    train = docs.filter(~held)
    assert train.count() == 4 and lm.learned(train).kinds == 3  # two words and the end
    passages = spark.createDataFrame([(1, f"{x} " * 60), (2, f"{y} " * 60)], "doc_id long, text string")
    assert {r.doc_id: r.passage_words for r in substrings.dedup_substrings(passages).collect()} == {1: 60, 2: 60}
    mixed = spark.createDataFrame([(k, " ".join(f"u{k}{i}" for i in range(50)) + f" {w}") for k, w in ((1, x), (2, y))], "doc_id long, text string")
    assert {r.passage_words for r in substrings.dedup_substrings(mixed).collect()} == {0}
