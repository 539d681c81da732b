"""Whitening, document fingerprints and periodic runs."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import fingerprints, periods, substrings, textkernel, whitening
from tests.compare import duck, rows
from tests.llm import brute


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


# Whitening


def plain_whitening(vectors: dict[int, list[float]]) -> tuple[dict, np.ndarray, np.ndarray]:
    """Deviations by whole numbers, and eigenvalues and whitened rows by numpy."""
    x = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, v in vectors.items()}
    n, sums = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    deviations = {k: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in x.items()}
    centred = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in x.values()]) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return deviations, values, centred @ axes / np.sqrt(values)


def test_whitening_of_given_vectors(spark, sf_dir):
    found = whitening.op11_embedding_whitening(spark, sf_dir).collect()
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    deviations, values, want = plain_whitening({r.vec_id: r.embedding for r in given})
    assert len(found) == 32 * len(given)
    place = {k: i for i, k in enumerate(deviations)}
    out = np.zeros((len(given), 32))
    for r in found:
        out[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviations[r.vec_id] and r.n == len(given)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert np.abs(np.abs(out) - np.abs(want[:, :32])).max() < 1e-9
    assert np.abs(np.cov(out.T, bias=True) - np.eye(32)).max() < 1e-9
    assert 0 <= found[0].identity_error < 1e-9 and len({r.identity_error for r in found}) == 1


def test_whitening_odd_rows(spark):
    fine = {1: [1.0, 2.0], 6: [3.0, -5.0], 8: [0.5, 0.25], 10: [-7.0, 100.0]}
    odd = [(2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (7, [1.0, 2.0, 3.0]), (9, [1.0, float("inf")])]
    schema = "vec_id long, embedding array<float>, n string, deviation string, a int"
    table = spark.createDataFrame([(k, v, "x", "y", 1) for k, v in [*fine.items(), *odd]], schema).repartition(3)
    model = whitening.fit_whitening(table)
    deviations, values, want = plain_whitening(fine)
    out = {r.vec_id: r for r in whitening.whitened(table, model).collect()}
    assert {k: r.deviation for k, r in out.items()} == deviations and model.n == 4
    assert np.allclose(np.abs([out[k].whitened for k in fine]), np.abs(want))
    assert whitening.fit_whitening(table.limit(0)) is None
    alike = spark.createDataFrame([(None, [1.0, 1.0])] * 3, "vec_id long, embedding array<float>")
    flat = whitening.fit_whitening(alike)
    assert (flat.n, len(flat.eigenvalues)) == (3, 0)
    assert [tuple(r) for r in whitening.whitened(alike, flat).collect()] == [(None, 0, [])] * 3
    # Entries far apart: sums stay exact, and what a long cannot hold is null.
    big = {1: [2.0**40, 0.0], 2: [-(2.0**40), 1.0], 3: [5.0, 2.0]}
    table = spark.createDataFrame(list(big.items()), "vec_id long, embedding array<float>")
    model = whitening.fit_whitening(table)
    assert model.sums == [64 * 5 + 3_000_000, 64 * 3 + 3_000_000]
    exact, _, _ = plain_whitening(big)
    assert {r.vec_id: r.deviation for r in whitening.whitened(table, model).collect()} == {k: v if v < 2**63 else None for k, v in exact.items()}


def test_whitening_does_not_depend_on_partitions(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one, many = (whitening.fit_whitening(table.repartition(k)) for k in (1, 7))
    assert one.sums == many.sums and np.array_equal(one.eigenvalues, many.eigenvalues) and np.array_equal(one.axes, many.axes)


# Fingerprints


def messy_sql(rows_of, sql: str) -> list:
    c = duck("/nonexistent")
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows_of)
    r = c.execute(sql)
    return rows([d[0] for d in r.description], r.fetchall())


def test_fingerprints_odd_rows(spark, messy, messy_rows, nothing):
    """Texts of every kind against the SQL, by ids of their own; null ids, ties and repeated rows by their rule."""
    first = {}
    for d, t, s in messy_rows:
        if d is not None:
            first.setdefault(d, (d, t, s))
    docs = spark.createDataFrame(list(first.values()), "doc_id long, text string, source string")
    out = fingerprints.fingerprints(docs.withColumn("zone", F.lit("x")).withColumn("row", F.lit(1)).repartition(5))
    assert rows(out.columns, out.collect()) == messy_sql(list(first.values()), fingerprints.SQL)
    out = fingerprints.fingerprints(messy).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in messy_rows)
    assert len({r.fingerprint for r in out if r.doc_id in (73, 74)}) == 1
    same = [r for r in out if r.doc_id == 80]
    assert len(same) == 3 and len(set(map(tuple, same))) == 2
    assert fingerprints.fingerprints(nothing).count() == 0
    alone = fingerprints.fingerprints(docs.filter("doc_id = 1")).first()
    assert alone.near_next == 1.0 and alone.n_chars == len(first[1][1])


def test_ranges_follow_each_other(spark):
    """Every row finds the next one, whatever the ranges, with one id and one row that a third of all rows have."""
    r = random.Random(3)
    data = [(r.choice([None, 5, 5, *range(-50, 50)]), f"t{r.randrange(400)}") for _ in range(900)] + [(7, "same")] * 500 + [(5, f"u{i}") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    w = F.expr("lead(text) OVER (PARTITION BY zone ORDER BY ghost, doc_id, h, text)")
    placed = fingerprints.in_ranges(docs)
    found = [x for x in placed.withColumn("after", w).collect() if x.ghost == 0]
    hashes = {(x.doc_id, x.text): x.h for x in found}
    order = sorted(set(data), key=lambda k: (k[0] is not None, k[0] or 0, hashes[k], k[1]))
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    assert len(found) == len(order) and sum(x.copies for x in found) == len(data)
    assert all(after[x.doc_id, x.text][1] == x.after for x in found)
    sizes = [n for _, n in placed.filter("ghost = 0").groupBy("zone").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 200


def test_likeness_follows_the_share_of_terms(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    base = [[word() for _ in range(200)] for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(base)], "doc_id long, text string")
    terms = fingerprints.lexicon(docs, 1)
    near = lambda n: [b[:n] + [word() for _ in b[n:]] for b in base]
    mean = []
    for share in (200, 190, 100, 0):
        texts = [t for pair in zip(base, near(share), strict=True) for t in pair]
        out = fingerprints.fingerprints(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), terms)
        mean.append(out.filter("doc_id % 2 = 0").agg(F.avg("near_next")).first()[0])
    assert mean[0] == 1.0 and 0.6 < mean[1] < 1.0 and 0.15 < mean[2] < 0.6 and mean[3] < 0.1


# Periodic runs


def test_runs_of_random_words():
    """Against a look at every period, for several documents at a time."""
    r = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(r.randint(1, 4)):
            n, k = r.choice([0, 1, 5, 6, 7, 12, 30, 60, 130]), r.choice([1, 2, 2, 3, 5])
            w = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.6:
                a, p = r.randrange(n), r.randint(1, max(1, n // 4))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                w[r.randrange(n)] = r.choice([w[0], 9])
            docs.append(w)
        bounds = np.cumsum([0] + [len(d) for d in docs])
        found = zip(*periods.find_runs(np.array([x for d in docs for x in d], np.uint64), bounds), strict=True)
        assert [tuple(map(int, x)) for x in found] == [(i, *run) for i, d in enumerate(docs) for run in brute.periodic_runs(d)]


def test_runs_of_documents(spark, messy, messy_rows, nothing, tmp_path):
    r = random.Random(2)
    text = lambda n, k: " ".join(r.choice("ab cde é fgh".split()[:k]) for _ in range(n))
    more = [(1000 + i, text(r.randrange(150), r.randint(1, 4)), "s") for i in range(150)] + [(10**18 + i, text(90, 4) + "\n\t", None) for i in range(40)]
    data = [x for x in [*messy_rows, *more] if len((x[1] or "").split()) < 800]
    spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("runs", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    out = periods.op13_periodic_runs(spark, str(tmp_path))
    want = [brute.op13_row(d, t) for d, t, _ in data]
    assert sum(w[1] for w in want) > 60
    assert got(out) == sorted(want, key=str)
    assert periods.periodic_runs(nothing).count() == 0
    kept = periods.periodic_runs(messy)
    assert kept.columns == [*messy.columns, "runs", "n_words", "collapsed"] and kept.count() == len(messy_rows)


def test_runs_of_a_long_text(spark):
    """One text longer than a slice, whose whole is a run, and one without any."""
    long = " ".join(f"w{i % 70_000}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, " ".join(f"w{i}" for i in range(200_000)))], "doc_id long, text string")
    out = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert [tuple(x) for x in out[1].runs] == [(0, 300_000, 70_000)] and out[1].collapsed == " ".join(f"w{i}" for i in range(70_000))
    assert out[2].runs == [] and out[2].n_words == 200_000


def test_word_keys_tell_words_apart():
    """Also words in a pattern that doubles itself, which sums of powers of one base do not tell apart."""
    x, y = "ab", "ba"
    for _ in range(9):
        x, y = x + y, y + x
    words = [x, y, *(f"{'z' * k}{c}" for k in range(1, 140) for c in "ab"), "a", "b", "ab", "é", "aab"]
    raw, offsets = textkernel.text_bytes(pa.array([" ".join([*words, *words])]))
    starts, ends, _ = textkernel.word_places(raw, offsets)
    keys = textkernel.word_keys(raw, starts, ends)
    assert len(set(keys.tolist())) == len(words) and keys[: len(words)].tolist() == keys[len(words) :].tolist()


def test_sql_of_odd_rows(spark, messy_rows, tmp_path):
    """Null and equal ids, null, empty and very long texts, repeated rows: substring dedup and runs against their SQL."""
    spark.createDataFrame(messy_rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for query, sql in ((substrings.op6_substring_dedup, substrings.SQL), (periods.op13_periodic_runs, periods.SQL)):
        out = query(spark, str(tmp_path))
        assert rows(out.columns, out.collect()) == messy_sql(messy_rows, sql)
