"""Tiled searches against plain loops: many queries, ties, versions, odd vectors and words."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import postings, search, tiles

CHUNKS = "sourceFile string, chunk_index int, version string, embedding array<float>"
QUERIES = "query_id long, version string, embedding array<double>"


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_many_queries_in_tiles(spark, tmp_path, monkeypatch):
    """100,000 queries: none of them passes the driver, the chunks are scanned once, and each has its best chunks."""
    monkeypatch.setattr(tiles, "QUERY_TILE", 30_000)
    r = np.random.default_rng(1)
    chunks = r.integers(-3, 4, (120, 3)).astype(np.float32)
    path = str(tmp_path / "chunks")
    spark.createDataFrame([(f"f{i % 7}", i, ("v5", "v6", "both")[i % 3], v.tolist()) for i, v in enumerate(chunks)], CHUNKS).write.parquet(path)
    vectors = [F.pmod(F.xxhash64(F.lit(j), "id"), F.lit(9)).cast("double") - 4 for j in range(3)]
    queries = spark.range(100_000).select(F.col("id").alias("query_id"), F.element_at(F.array(F.lit("all"), F.lit("v5"), F.lit("both")), (F.col("id") % 3 + 1).cast("int")).alias("version"), F.array(*vectors).alias("embedding"))
    out = search.vector_topk(queries, spark.read.parquet(path), 3, 0.5)
    assert plan(out).count("FileScan parquet") == 1 and "Broadcast" not in plan(out) and "CartesianProduct" not in plan(out)
    got = out.toPandas().sort_values(["query_id", "rank"])
    asked = np.array([x.embedding for x in queries.orderBy("query_id").collect()])
    order = sorted(range(120), key=lambda i: (f"f{i % 7}", i))
    scores = asked @ chunks[order].T.astype(np.float64)
    fits = np.array([i % 3 != 1 for i in order])
    scores[1::3] = np.where(fits, scores[1::3], -np.inf)
    scores[scores < 0.5] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    q, rank = np.nonzero(np.take_along_axis(scores, best, 1) > -np.inf)
    assert got["query_id"].tolist() == q.tolist() and got["rank"].tolist() == (rank + 1).tolist()
    assert got["chunk_index"].tolist() == np.array(order)[best[q, rank]].tolist()


def test_vectors_of_all_kinds(spark):
    """Null, empty, short and broken vectors, null versions and files, ties and repeated rows, by a loop."""
    r = random.Random(4)
    vector = lambda: r.choice([None, [], [1.0, 2.0], [1.0, None], [float("nan"), 1.0], [r.randint(-2, 2) * 1.0, r.randint(-2, 2) * 1.0], [1.0, 0.0, 2.0]])
    rows = [(r.choice(["a", "b", None]), r.randrange(40), r.choice(["v5", "v6", "both", "v7", None]), vector()) for _ in range(300)]
    queries = [(i, r.choice(["v5", "v6", "both", "all", "v7"]), r.choice([None, [], [1.0, 1.0], [0.5, -1.0], [1.0, 1.0, 1.0]])) for i in range(25)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    out = search.vector_topk(spark.createDataFrame(queries, QUERIES), chunks, 4, 0.1)
    fits = spark.createDataFrame([(v, w) for v in ("v5", "v6", "both", "all", "v7") for w in ("v5", "v6", "both", "v7", None)], "q string, c string")
    allowed = {(x.q, x.c) for x in fits.filter(search.filter_by_version(F.col("q"), F.col("c"))).collect()}
    want = []
    for i, version, q in queries:
        hits = []
        for f, n, v, e in rows:
            if q and e and len(q) == len(e) and all(x is not None and x == x for x in e) and (version, v) in allowed:
                s = sum(a * b for a, b in zip(q, e, strict=True))
                hits += [(-s, f is not None, f or "", n)] if s >= 0.1 else []
        want += [(i, f if some else None, n, -s, rank + 1) for rank, (s, some, f, n) in enumerate(sorted(hits)[:4])]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_keywords_by_postings(spark):
    """The rows of a look at every text: words of one to many characters, of any alphabet, parts of words, repeated and missing words."""
    r = random.Random(9)
    vocabulary = ["a", "é", "ab", "abc", "Straße", "x\0y", "wavelet", "let", "日本語", "語", "😀", "zz-top", "__init__", "%d"]
    text = lambda n: r.choice([" ", "\n", ""]).join(r.choice(vocabulary) for _ in range(r.randrange(n)))
    rows = [(f"f{i % 9}", i, r.choice(["v5", "v6", "both", None]), r.choice(["H", "Avelet", None]), r.choice([text(12), text(3), None]), text(5)) for i in range(150)]
    queries = [(i, r.choice(["v5", "all", None, "both"]), r.choice([None, "", " \t", text(6), " ".join(r.choices([*vocabulary, "none", "avel", "本"], k=5))])) for i in range(100)]
    chunks = spark.createDataFrame(rows, "sourceFile string, chunk_index int, version string, heading string, rawContent string, content string")
    asked = spark.createDataFrame(queries, "query_id long, version string, query string")
    index = postings.piece_index(chunks, 16)
    out = search.keyword_search(asked, chunks, 5, index)
    want = []
    for i, version, q in queries:
        hits = []
        for f, n, v, h, raw, content in rows:
            body = " ".join(x for x in (h, raw if raw is not None else content) if x is not None).lower()
            s = sum(w in body for w in (q or "").lower().split())
            if s and (version in (None, "all", "both") or v in (version, "both")):
                hits.append((-s, f, n))
        want += [(i, f, n, float(-s), rank + 1) for rank, (s, f, n) in enumerate(sorted(hits)[:5])]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want)) and len(want) > 100
    assert search.keyword_search(asked, chunks.limit(0)).count() == 0 and search.keyword_search(asked.limit(0), chunks).count() == 0
    assert index.lists.agg(F.max("size")).first()[0] <= 16


def test_keywords_read_postings_and_few_texts(spark):
    """Lists are read by bucket, and the texts that are read are those of the words' rarest pieces."""
    chunks = spark.range(400).select(F.format_string("f%d", "id").alias("sourceFile"), F.lit(0).alias("chunk_index"), F.lit("v5").alias("version"), F.lit("h").alias("heading"), F.when(F.col("id") % 100 == 7, "common words and a quixotic one").otherwise("common words").alias("rawContent"), F.lit("").alias("content"))
    index = postings.piece_index(chunks)
    queries = spark.createDataFrame([(1, "all", "quixotic"), (2, "all", "QUIX words")], "query_id long, version string, query string")
    out = search.keyword_search(queries, chunks, 10, index)
    assert out.count() == 14 and out.filter("query_id = 2 AND score = 2").count() == 4
    terms = spark.createDataFrame([(0, "quixotic")], "term long, word string")
    assert [r.told for r in postings.word_matches(index, terms).collect()] == [[0]] * 4
    assert "PartitionFilters: [isnotnull(bucket" in plan(out)


def test_keywords_without_an_index_store_nothing(spark, monkeypatch):
    """The same rows as by postings, in tiles of few queries and slices of few texts, and no table is written for them."""
    r = random.Random(3)
    letters = ["a", "b", "é", "語", "x\0", "😀"]
    word = lambda: "".join(r.choices(letters, k=r.randrange(1, 7)))
    rows = [(f"f{i % 7}", i, r.choice(["v5", "v6", "both"]), word(), " ".join(word() for _ in range(r.randrange(12))), "") for i in range(120)]
    chunks = spark.createDataFrame(rows, "sourceFile string, chunk_index int, version string, heading string, rawContent string, content string")
    asked = spark.createDataFrame([(i, r.choice(["v5", "all", None]), " ".join(word()[:4] for _ in range(r.randrange(6)))) for i in range(80)], "query_id long, version string, query string")
    want = sorted(map(str, search.keyword_search(asked, chunks, 4, postings.piece_index(chunks)).collect()))
    monkeypatch.setattr(tiles, "QUERY_TILE", 30)
    monkeypatch.setattr(tiles, "TILE_BYTES", 8 * 6 * 30)
    monkeypatch.setattr(postings, "new_folder", lambda *_: pytest.fail("a table is written"))
    monkeypatch.setattr(search, "stored", lambda *_: pytest.fail("a table is written"))
    assert sorted(map(str, search.keyword_search(asked, chunks, 4).collect())) == want and len(want) > 100
