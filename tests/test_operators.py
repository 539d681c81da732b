from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import embedding, text
from docloom.operators import maintenance, rates, search, stats, validation

GOOD = {
    "request_id": 1, "op": "submit", "ts": dt.datetime(2024, 1, 1), "title": "A good title here",
    "filePath": "docs/v6_docs/guides/new.md", "content": "# Title\n\n" + "plain prose that goes on. " * 6, "version": "v6",
    "category": "guides", "description": None, "contributorName": None, "reason": "no longer needed at all",
}
SCHEMA = (
    "request_id long, op string, ts timestamp, title string, filePath string, content string, version string, "
    "category string, description string, contributorName string, reason string"
)
CASES = [
    ({}, None),
    ({"title": None}, "fields"), ({"title": "short"}, "fields"), ({"title": "x" * 121}, "fields"), ({"title": "x" * 120}, None),
    ({"content": None}, "fields"), ({"content": "# T\n" + "x" * 95}, "fields"), ({"content": "# T\n" + "x" * 96}, None),
    ({"content": "# T\n" + "x" * 50_000}, "fields"), ({"version": "v7"}, "fields"), ({"category": "other"}, "fields"), ({"category": ""}, None),
    ({"filePath": "src/x.md"}, "path"), ({"filePath": "docs/v6_docs/../x.md"}, "path"), ({"filePath": "docs/v6_docs/a//b.md"}, "path"),
    ({"filePath": "docs/v6_docs/a.txt"}, "path"), ({"filePath": "docs/v5_docs/a.md"}, "path"), ({"filePath": "/docs/v6_docs/a.md"}, "path"),
    ({"filePath": "docs/v6_docs/a\\b.md"}, "path"), ({"filePath": "docs/v6_docs/a.md\n"}, "path"), ({"filePath": "docs/v6_docs/a/b/c.md"}, None),
    ({"content": GOOD["content"] + "<script>"}, "sanitize"), ({"content": GOOD["content"] + "```\n</SCRIPT>\n```"}, "sanitize"),
    ({"content": GOOD["content"] + "<iframe src>"}, "sanitize"), ({"content": GOOD["content"] + "javascript :x"}, "sanitize"),
    ({"content": GOOD["content"] + "data:image/png;base64," + "A" * 2000}, "sanitize"), ({"content": GOOD["content"] + "onclick='x'"}, None),
    ({"content": "no heading. " * 20}, "lint"), ({"content": "# T\n```\n" + "code " * 40 + "\n```"}, "lint"),
    ({"op": "update"}, "existence"), ({"op": "update", "filePath": "docs/v6_docs/known.md"}, None),
    ({"op": "remove"}, "existence"), ({"op": "remove", "filePath": "docs/v6_docs/known.md", "title": None, "content": None}, None),
    ({"op": "remove", "reason": "short"}, "fields"), ({"op": "remove", "reason": None}, "fields"), ({"op": "remove", "reason": "x" * 501}, "fields"),
]


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame([("docs/v6_docs/known.md",)], "path string")


def test_stages(spark, paths):
    rows = [tuple((GOOD | change | {"request_id": i}).values()) for i, (change, _) in enumerate(CASES)]
    judged = validation.stage_errors(validation.check_existence(spark.createDataFrame(rows, SCHEMA), paths))
    got = {r.request_id: r.failed_stage for r in judged.collect()}
    assert [(CASES[i][0], got[i]) for i in got] == [(c, want) for i, (c, want) in sorted(enumerate(CASES), key=lambda x: list(got).index(x[0]))]


def test_rate_limit_is_not_a_lag(spark):
    times = [0, 30, 59.999, 60, 119, 125]
    base = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(i, "k", base + dt.timedelta(seconds=s)) for i, s in enumerate(times)] + [(9, "other", base)]
    events = spark.createDataFrame(rows, "id long, key string, ts timestamp")
    got = {r.id: (r.allowed, r.wait_seconds) for r in rates.rate_limit(events, "key", "ts", "id").collect()}
    assert [got[i][0] for i in range(6)] == [True, False, False, True, False, True]
    assert (got[1][1], got[2][1], got[4][1], got[9]) == (30, 1, 1, (True, 0))


def test_validate_and_manifest(spark, paths):
    rows = [tuple((GOOD | {"request_id": i, "ts": GOOD["ts"] + dt.timedelta(seconds=s)}).values()) for i, s in enumerate((0, 10, 70))]
    out = validation.validate_requests(spark.createDataFrame(rows, SCHEMA), paths)
    got = {r.request_id: (r.status, r.failed_stage, r.errors) for r in out.collect()}
    assert got[0][0] == got[2][0] == "accepted"
    assert got[1] == ("rejected", "rate", ["Rate limited. Please try again in 50 seconds."])
    manifest = validation.contribution_manifest(out.filter("request_id = 0"), F.col("ts")).first()
    assert manifest.branch == "docs/contrib/20240101T000000Z-a-good-title-here"
    assert "**Contributor:** Anonymous" in manifest.pr_body and "New documentation" in manifest.pr_body


def test_validate_repeated_and_null_ids(spark, paths):
    """One row out for each row in, whatever the ids."""
    same = [tuple(GOOD.values())] * 3
    odd = [tuple((GOOD | {"request_id": None, "contributorName": "other", "title": f"Another title {i}"}).values()) for i in range(2)]
    bad = [tuple((GOOD | {"title": "x"}).values()), tuple((GOOD | {"ts": None, "contributorName": "third"}).values())]
    out = validation.validate_requests(spark.createDataFrame(same + odd + bad, SCHEMA), paths).collect()
    assert len(out) == 7
    of = lambda f: sorted(r.status for r in out if f(r))
    assert of(lambda r: r.request_id is not None and r.title == GOOD["title"] and r.ts is not None) == ["accepted", "rejected", "rejected"]
    assert of(lambda r: r.request_id is None) == ["accepted", "rejected"]
    assert of(lambda r: r.title == "x") == ["rejected"] and of(lambda r: r.ts is None) == ["accepted"]


def test_tokens_count_utf16(spark):
    assert [r[0] for r in spark.createDataFrame([("\U0001f600" * 4,), ("abcde",), ("",), (None,)], "s string").select(text.estimate_tokens(F.col("s"))).collect()] == [2, 2, 0, None]


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    long = F.lit("x" * 100 + " needle " + "y" * 400)
    assert get(text.snippet(long, F.lit("zzz needle"))) == "…" + ("x" * 59 + " needle " + "y" * 400)[:300].strip()
    assert get(text.snippet(F.lit(" short "), F.lit("none"))) == "short"
    assert get(text.slugify(F.lit("  Hello, World! " + "a" * 60))) == ("hello-world-" + "a" * 60)[:40]
    assert get(text.redact_tokens(F.lit("a Token abc.def b"))) == "a token [REDACTED] b"
    assert get(text.extract_category(F.lit("docs/v6/x/a.md"), F.lit("some Hook context"))) == "hooks"
    assert get(text.extract_category(F.lit("a/apiKey.md"), F.lit(""))) == "cookbook-authentication"
    assert get(text.extract_code_languages(F.lit("```ts{1,2}\n```\n```\n```"))) == ["ts", "text"]
    assert get(text.extract_tags(F.lit("Socket.io and JWT"))) == ["jwt", "socket.io"]
    assert [get(text.human_age(F.lit(ms))) for ms in (5_000, 65_000, 7_200_000, 172_800_000)] == ["5s ago", "1m ago", "2h ago", "2d ago"]


def test_search_rules(spark):
    rows = [
        ("a.md", 0, "v5", 45, [1.0, 0.0]), ("a.md", 1, "v5", 42, [0.9, 0.1]), ("a.md", 2, "v5", 1, [0.8, 0.1]),
        ("b.md", 0, "both", 35, [0.7, 0.0]), ("c.md", 0, "v6", 48, [0.6, 0.0]), ("d.md", 0, "v6", 44, None), ("e.md", 0, "v6", 1, [0.0, 1.0]),
        ("f.md", 0, "v6", 1, [1.0, 0.0, 0.0]),
    ]
    chunks = spark.createDataFrame(rows, "sourceFile string, chunk_index int, version string, tokens int, embedding array<float>")
    queries = spark.createDataFrame(
        [(1, "all", 10, 0, [1.0, 0.0]), (2, "v6", 10, 0, [1.0, 0.0]), (3, "all", 1, 0, [1.0, 0.0]), (4, "all", 10, 46, [1.0, 0.0]), (5, "all", 10, 45, [1.0, 0.0])],
        "query_id long, version string, limit int, tokens_budget long, embedding array<float>",
    )
    hits = search.pipeline(search.vector_topk(queries, chunks), queries, chunks)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.sourceFile, r.chunk_index))
    assert got[1] == [("a.md", 0), ("a.md", 1), ("b.md", 0), ("c.md", 0)]
    assert got[2] == [("b.md", 0), ("c.md", 0)]
    assert got[3] == [("a.md", 0)]
    assert got[4] == [("a.md", 0), ("a.md", 1)] and got[5] == [("a.md", 0)]
    assert hits.filter("query_id = 2 AND rank = 1").first().score == 1.0
    assert search.vector_topk(queries, chunks.limit(0)).count() == 0 and search.vector_topk(queries.limit(0), chunks).count() == 0


def test_topk_does_not_depend_on_partitions(spark, sf_dir):
    from docloom.plans import tables as t

    q, c = t.vector_queries(spark, sf_dir), t.vector_chunks(spark, sf_dir)
    a, b = (sorted(map(tuple, search.vector_topk(q, c.repartition(n)).collect())) for n in (1, 8))
    assert [x[:3] + x[4:] for x in a] == [x[:3] + x[4:] for x in b]


def test_normalize_queries(spark):
    rows = [(1, "", "v5", 1.0, 0.0), (2, "  services  ", "invalid", -5.0, 0.5), (3, "x", "v6", 100.0, 7.9), (4, None, "v5", None, None), (5, "y", None, 0.5, None)]
    out = search.normalize_queries(spark.createDataFrame(rows, "query_id long, query string, version string, limit double, tokens_budget double"))
    got = {r.query_id: (r.query, r.version, r.limit, r.tokens_budget) for r in out.collect()}
    assert got == {2: ("services", "all", 10, 0), 3: ("x", "v6", 50, 7), 5: ("y", "all", 0, 0)}


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "Service methods create"), (2, ""), (3, None), (4, "service SERVICE")], "id long, t string")
    got = {r.id: (r.a, r.b) for r in rows.select("id", embedding.embed(F.col("t"), embedding.hash_model()).alias("a"), embedding.hash_embed(F.col("t")).alias("b")).collect()}
    assert got[1][0] == pytest.approx(got[1][1]) and sum(x * x for x in got[1][0]) == pytest.approx(1)
    assert got[2] == got[3] == (None, None) and max(got[4][0]) == 1.0
    bad = spark.createDataFrame([([1.0, 2.0],), ([1.0, None],), ([1.0, float("nan")],), ([float("inf"), 1.0],), ([1.0],), (None,)], "e array<float>")
    assert [r[0] for r in bad.select(embedding.has_valid_embedding(F.col("e"), 2)).collect()] == [True, False, False, False, False, False]
    assert [r[0] for r in bad.select(embedding.needs_reembedding(F.col("e"), 2)).collect()] == [False, False, False, False, True, True]


def _picky_model():
    def encode(texts):
        if any("bad" in t for t in texts):
            raise KeyError("bad")
        out = np.ones((len(texts), 2))
        out[[t == "infinite" for t in texts]] = np.inf
        return out

    return encode


def test_one_bad_text_spoils_no_other(spark):
    """Whatever the model raises, exactly the texts that fail alone have no vector, and the attempts are told."""
    texts = [None, "", "infinite"] + [f"t{i}" for i in range(13)] + ["bad"] + [f"u{i}" for i in range(16)] + ["bad, too"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    out = {r.id: r.e for r in rows.select("id", embedding.embed_attempts(F.col("t"), _picky_model).alias("e")).collect()}
    assert {texts[i] for i, e in out.items() if e.vector is None} == {None, "", "infinite", "bad", "bad, too"}
    assert [out[i].attempts for i in (0, 1)] == [0, 0] and out[16].error == "KeyError: 'bad'" and out[2].error == "no finite vector"
    assert 1 < max(e.attempts for e in out.values()) <= 7
    assert [r.e for r in rows.filter("id > 16 AND id < 20").select(embedding.embed(F.col("t"), _picky_model).alias("e")).collect()] == [pytest.approx([0.5**0.5] * 2)] * 3


def test_ids_of_a_category_in_pieces(spark):
    rows = [("c" if i % 10 else None, f"id{i * 7919 % 1000:04d}", "f", i) for i in range(1000)] + [("", None, "g", 0)]
    table = spark.createDataFrame(rows, "category string, id string, sourceFile string, chunk_index int").repartition(5)
    pieces = {(r.category, r.piece): r.ids for r in stats.category_ids(table, 64).collect()}
    assert all(len(ids) == 64 or (c, n + 1) not in pieces for (c, n), ids in pieces.items())
    for c, own in (("c", [r for r in rows if r[0] == "c"]), ("uncategorized", [r for r in rows if not r[0]])):
        assert sum((pieces[k] for k in sorted(pieces) if k[0] == c), []) == sorted(r[1] or "" for r in own)
    assert stats.category_ids(table.limit(0)).count() == 0


def test_merge_is_idempotent(spark):
    schema = "sourceFile string, version string, heading string"
    old = spark.createDataFrame([("a", "v5", "A"), ("b", "v5", "B"), ("a6", "v6", "A6")], schema)
    new = spark.createDataFrame([("a", "v5", "A2"), ("c", "v5", "C"), ("x", "both", "no")], schema)
    once = maintenance.replace_by_source(old, new)
    want = [("a", "v5", "A2"), ("a6", "v6", "A6"), ("b", "v5", "B"), ("c", "v5", "C")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, maintenance.replace_by_source(once, new).collect())) == want
    assert sorted(map(tuple, maintenance.merge_stats(old, new).collect())) == [("v5", 1, 2, 3), ("v6", 0, 0, 1)]


def test_sync_plan(spark):
    now = dt.datetime(2024, 1, 3)
    state = spark.createDataFrame([("fresh", now - dt.timedelta(hours=1), "1"), ("old", now - dt.timedelta(hours=25), "1"), ("same", now - dt.timedelta(hours=25), "2")], "kb string, last_synced timestamp, remote_version string")
    remote = spark.createDataFrame([(k, None, "2") for k in ("fresh", "old", "same", "new")], "kb string, lastIncrementalUpdate string, generated string")
    got = {r.kb: (r.action, r.hours_left) for r in maintenance.sync_plan(state, remote, F.lit(now), -1).collect()}
    assert got == {"fresh": ("fresh", 23), "old": ("refresh", 0), "same": ("touch", 0), "new": ("refresh", 0)}


def test_stats_on_nothing(spark):
    rows = spark.createDataFrame([], "sourceFile string, chunk_index int, version string, hasCode boolean, category string, tags array<string>, subHeadings array<string>, tokens int, id string, embedding array<float>")
    for f in (stats.version_stats, stats.file_summary, stats.category_index, stats.duplicate_ids, stats.embedding_dim_audit, stats.file_version_counts):
        assert f(rows).count() == 0
