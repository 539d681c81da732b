from __future__ import annotations

import datetime as dt
import json

import pytest
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.operators.chunks import build_chunks
from docloom.operators.rates import rate_limit
from docloom.operators.validation import check_existence, stage_errors
from docloom.sources import files
from docloom.sources.buckets import merge_into_buckets, read_buckets
from docloom.streaming import jobs
from tests.test_operators import GOOD, SCHEMA


def test_corpus_and_tables(spark, tmp_path):
    (tmp_path / "docs" / "v6_docs" / "empty").mkdir(parents=True)
    names = ["v5_docs/a.md", "v5_docs/.vitepress/b.md", "v5_docs/assets/c.md", "v5_docs/d/.git/y.md", "v6_docs/d/e.md", "v6_docs/d/x.txt", "other/f.md"]
    for name in [*names, "v5_docs/d/_discord.md", "v6_docs/_sidebar/g.md", "other/.h.md", "_top.md", ".hidden/i.md", "assets/j.md", "other/assets.md"]:
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text(f"# T\n\n## {name}\ntext\n")
    read = files.read_markdown_corpus(spark, [str(tmp_path / "docs"), str(tmp_path / "missing")])
    assert sorted(r.path.split("docs/", 1)[1] for r in read.collect()) == [
        "_top.md", "other/.h.md", "other/assets.md", "other/f.md", "v5_docs/a.md", "v5_docs/d/_discord.md", "v6_docs/_sidebar/g.md", "v6_docs/d/e.md",
    ]
    uri = files.read_markdown_corpus(spark, [f"file://{tmp_path}/docs/"]).filter("path LIKE '%/_discord.md'").first()
    assert uri.path == f"file://{tmp_path}/docs/v5_docs/d/_discord.md" and uri.text == "# T\n\n## v5_docs/d/_discord.md\ntext\n"
    assert files.read_markdown_corpus(spark, [str(tmp_path / "missing")]).count() == files.read_markdown_corpus(spark, []).count() == 0
    (tmp_path / "docs" / "other" / "bytes.md").write_bytes(b"caf\xe9 \xc3\xa9")
    assert files.read_markdown_corpus(spark, [str(tmp_path / "docs/other")]).filter("path LIKE '%bytes.md'").first().text == "caf\ufffd é"
    chunks = build_chunks(read.filter("path RLIKE '/(a|e|f)[.]md$'"))
    files.write_chunks(chunks, str(tmp_path / "out"))
    table = spark.read.parquet(str(tmp_path / "out"))
    assert {r.kb_version: r["count"] for r in table.groupBy("kb_version").count().collect()} == {"v5": 2, "v6": 2}
    files.write_kb_metadata(chunks.groupBy("version").count(), str(tmp_path / "meta"), ["a.md"])
    assert spark.read.json(str(tmp_path / "meta")).first().lastChangedFiles == ["a.md"]
    files.write_outcomes(spark.createDataFrame([(1, "submit", "accepted")], "id long, op string, status string"), str(tmp_path / "staged"))
    assert spark.read.json(str(tmp_path / "staged")).first().request.id == 1


def test_chunk_files(spark, tmp_path):
    root = tmp_path / "chunks"
    (root / "core").mkdir(parents=True)
    (root / "core" / "a.json").write_text(json.dumps([{"id": "1", "tokens": 3}, {"id": "2"}]))
    (root / "meta.json").write_text(json.dumps({"generated": "now"}))
    (root / "bad.json").write_text("{ not json")
    (root / "half.json").write_text('[{"id": "3"}, {"id"')
    (root / "object.json").write_text(json.dumps({"id": "4", "content": "no array"}))
    (root / "deep.json").write_text(json.dumps([{"id": "5", "tokens": "many", "tags": ["a"], "embedding": [1, 2.5], "more": 1}, {"content": "no id"}, 7, [{"id": "6"}]]))
    (root / "empty.json").write_text("")
    read = files.read_chunks(spark, str(root))
    assert sorted(r.id for r in read.collect()) == ["1", "2", "5"]
    assert [(r.tokens, r.tags, r.embedding) for r in read.filter("id = '5'").collect()] == [(None, ["a"], [1.0, 2.5])]
    left = {r.path.rsplit("/", 1)[1]: r.reason for r in files.unread_chunk_files(spark, str(root)).collect()}
    assert {k: v for k, v in left.items() if k != "empty.json"} == {"meta.json": "no array", "object.json": "no array", "bad.json": "no JSON", "half.json": "no JSON"}
    assert files.read_chunk_file(spark, str(root), "core", "a.json").count() == 2
    assert files.read_chunk_file(spark, str(root), "core", "missing.json").count() == 0
    assert files.read_chunks(spark, str(root / "none")).count() == 0
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_chunk_file(spark, str(root), ".", "bad.json").collect()


def test_ingest(spark, tmp_path):
    schema = "path string, text string, ts timestamp"
    source, target = str(tmp_path / "in"), str(tmp_path / "kb")
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    first = [("docs/v5_docs/a.md", "# A\n## x\n1", at(1)), ("docs/v5_docs/a.md", "# A\n## x\n2", at(2)), ("docs/v6_docs/b.md", "# B\n## x\n1", at(1))]
    second = [("docs/v5_docs/a.md", "# A\n## x\n3", at(3))]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_ingest(stream, target, str(tmp_path / "ck")).awaitTermination()
    got = {r.sourceFile: r.rawContent for r in read_buckets(spark, target).collect()}
    assert got == {"docs/v5_docs/a.md": "## x\n\n3", "docs/v6_docs/b.md": "## x\n\n1"}


def test_stream_validate_is_the_batch(spark, tmp_path):
    rows = [tuple((GOOD | {"request_id": i, "title": t}).values()) for i, t in enumerate(("A good title here", "short"))]
    batch = spark.createDataFrame(rows, SCHEMA)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    paths = spark.createDataFrame([("docs/v6_docs/known.md",)], "path string")
    stream = jobs.stream_validate(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), paths)
    query = stream.select("request_id", "failed_stage").writeStream.format("memory").queryName("judged").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    want = stage_errors(check_existence(batch, paths)).select("request_id", "failed_stage")
    assert sorted(map(tuple, spark.table("judged").collect())) == sorted(map(tuple, want.collect()))


def test_stream_rate_limit_is_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    events.orderBy("us").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_rate_limit(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 6 * 3600)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    want = rate_limit(events.withColumn("ts", F.timestamp_micros("us")), "key", "ts", "event_id", 6 * 3600)
    cols = ["event_id", "allowed", "wait_seconds"]
    assert sorted(map(tuple, spark.table("limited").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_stream_rate_limit_in_order_of_time(spark, tmp_path):
    """Batches out of order, ties and repeated rows get the batch's verdicts once the watermark has passed them; clocks go."""
    schema, second = "key long, event_id long, us long", 1_000_000
    times = [(k, i, (1000 + i * 37 % 101 * 7) * second) for k in (1, 2) for i in range(101)]
    times += [(1, 500, 1070 * second), (1, 500, 1070 * second), (None, 7, 1005 * second), (None, 8, 1004 * second)]
    end = (9, 999, 100_000 * second)
    for rows in (times[1::2], times[0::2], [end], [(9, 1000, 200_000 * second)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_rate_limit(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60, "1 hour")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    events = spark.createDataFrame([*times, end], schema)
    want = rate_limit(events.withColumn("ts", F.timestamp_micros("us")), "key", "ts", "event_id", 60).drop("ts")
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = lambda d: sorted(map(str, d.select("key", "event_id", "us", "allowed", "wait_seconds").collect()))
    assert rows(got) == rows(want)
    assert got.filter("key = 1 AND us = 1070000000").count() == 3


class _Timers:
    def __init__(self, now: int) -> None:
        self.now = now

    def getCurrentWatermarkInMs(self) -> int:  # noqa: N802
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


class _State(dict):
    """The state of one key, in memory; counts what is asked of it."""

    calls = 0

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = lambda self, *_: _State()  # noqa: E731, N815

    def get(self):
        self.calls += 1
        return self.getValue(())

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return dict.get(self, key)

    def update(self, value) -> None:
        self.updateValue((), value)

    def updateValue(self, key, value) -> None:  # noqa: N802
        self.calls += 1
        self[key] = value

    containsKey, removeKey = dict.__contains__, dict.pop  # noqa: N815

    def registerTimer(self, at: int) -> None:  # noqa: N802
        self.calls += 1


def test_a_key_costs_little_state_and_a_busy_one_lies_in_slots():
    """Verdicts are those of one run in order, with and without slots; calls to the state do not grow with the events."""
    r = np.random.default_rng(5)
    us, ids = r.integers(0, 10**10, 3000), np.arange(3000)
    want, _ = jobs._judge((1,), us, ids, None, 60_000_000)
    for few in (5000, 64):
        limiter, state = jobs.OrderedRateLimiter(60, 1000, few), _State()
        limiter.init(state)
        got = []
        for at in range(0, 3000, 500):
            list(limiter.handleInputRows((1,), iter([pd.DataFrame({"us": us[at : at + 500], "event_id": ids[at : at + 500]})]), None))
        assert len(limiter.slots) == 0 if few == 5000 else 30 < len(limiter.slots) < 600
        for now in (3_000_000, 3_000_500, 7_777_000, 10**8):
            got += list(limiter.handleExpiredTimer((1,), _Timers(now), _Timers(now)))
            due = (us // 10**6 + 1) * 1000 <= now
            assert sum(map(len, got)) == due.sum()
        assert pd.concat(got).reset_index(drop=True).equals(want)
        assert not state and not limiter.slots
        if few == 5000:
            assert state.calls < 50


def test_snapshots_are_swapped_and_retired(spark, tmp_path):
    """Readers find the newest of all snapshots, and the one before stays readable."""
    target, names = str(tmp_path / "kb"), []
    for i in range(4):
        names.append(files.swap_snapshot(spark.range(i, i + 2), target))
        assert sorted(r.id for r in files.read_snapshot(spark, target).collect()) == [i, i + 1]
    left = {p.name for p in (tmp_path / "kb").iterdir() if p.name.startswith("snapshot-")}
    assert left == set(names[2:]) and spark.read.parquet(f"{target}/{names[2]}").count() == 2


def _folders(root) -> dict[str, float]:
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in sorted(root.rglob("*.parquet"))}


def test_a_merge_rewrites_only_its_buckets(spark, tmp_path):
    """Files of other buckets stay as they are, a batch that runs again changes nothing, and a failed one runs anew."""
    schema = "sourceFile string, version string, chunk_index int, heading string"
    chunks = lambda names, h: spark.createDataFrame([(f"docs/v5_docs/{n}.md", "v5", 0, h) for n in names], schema)
    target, root = str(tmp_path / "kb"), tmp_path / "kb" / "data"
    every = merge_into_buckets(chunks("abcdefgh", "one"), target, "s", 0, 8)
    assert len(every) > 2
    first = _folders(root)
    [bucket] = merge_into_buckets(chunks("a", "two"), target, "s", 1)
    second = _folders(root)
    assert {k: v for k, v in second.items() if k in first} == first
    assert {k.split("/")[0] for k in second if k not in first} == {f"bucket={bucket}"}
    for again in (0, 1):
        assert merge_into_buckets(chunks("abc", "never"), target, "s", again) == []
    assert _folders(root) == second
    got = {r.sourceFile[-4]: r.heading for r in read_buckets(spark, target).collect()}
    assert got == {n: "two" if n == "a" else "one" for n in "abcdefgh"}
    # What a failed merge has left in its generation is overwritten when it runs again.
    chunks("z", "left by a failure").selectExpr("*", f"{bucket} AS bucket", "2 AS generation").write.mode("append").partitionBy("bucket", "generation").parquet(str(root))
    assert {r.heading for r in read_buckets(spark, target).collect()} == {"one", "two"}
    merge_into_buckets(chunks("a", "three"), target, "s", 2)
    merge_into_buckets(chunks("a", "four"), target, "other", 0)
    merge_into_buckets(spark.createDataFrame([("x", "both", 0, "skipped")], schema), target, "s", 3)
    assert sorted(r.heading for r in read_buckets(spark, target).collect()) == ["four"] + ["one"] * 7
    assert {k.split("/")[1] for k in _folders(root) if k.startswith(f"bucket={bucket}/")} == {"generation=3"}
    assert {p.name for p in (tmp_path / "kb" / "pointers").iterdir()} == {"n=3", "n=4"}


def test_outcomes_of_a_batch_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "submit", "accepted"), (2, "remove", "rejected")], "id long, op string, status string")
    for batch in (0, 1, 1):
        files.write_outcomes(rows, str(tmp_path / "out"), batch)
    assert spark.read.json(str(tmp_path / "out")).groupBy("batch").count().filter("count = 2").count() == 2
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.stream_outcomes(stream, str(tmp_path / "streamed"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "streamed")).count() == 2


def _parse(text: str) -> list[dict]:
    if "broken" in text:
        raise KeyError(text)
    return [{"level": 1, "heading": "T", "body": ""}, {"level": 2, "heading": "x", "body": text}]


def test_a_failing_file_leaves_a_row(spark):
    texts = [(f"docs/v5_docs/{i}.md", "broken" if i == 3 else f"text {i}") for i in range(8)]
    table = spark.createDataFrame(texts, "path string, text string").coalesce(1)
    told = build_chunks(table, parse=_parse, errors=True)
    bad = told.filter("error IS NOT NULL").collect()
    assert [(r.sourceFile, r.error, r.id, r.chunk_index, r.tokens) for r in bad] == [("docs/v5_docs/3.md", "KeyError: 'broken'", None, None, None)]
    fine = build_chunks(table, parse=_parse)
    assert sorted(r.rawContent for r in fine.collect()) == sorted(f"## x\n\n{t}" for _, t in texts if t != "broken")
    assert sorted(map(str, told.filter("error IS NULL").drop("error").collect())) == sorted(map(str, fine.collect()))
