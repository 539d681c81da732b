"""The pipeline against its SQL as a whole, and stage by stage on what the stage before it kept."""

from __future__ import annotations

import corpus_pipeline as cp
from docloom.llm import mixing
from docloom.llm.lines import op3_rows
from docloom.llm.quality import quality_metrics
from docloom.llm.shared import written
from tests.compare import duck, same
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        kept[name] = docs
        if name != "source mix":
            assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality rules":
            assert ids == {r.doc_id for r in quality_metrics(before).filter("kept").collect()}
        elif name == "line dedup":
            left = {r.doc_id: r.text for r in op3_rows(before).collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == {d: t for d, t in left.items() if brute.words(t)}
        elif name == "n-gram Jaccard join":
            assert ids == {d for d, c, _ in brute.near_duplicates(rows) if c == d}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert ids == {d for d, _ in rows} - {d for d, _ in brute.leaks(rows, items)}
        else:
            plan = {r.doc_id: r.taken for r in mixing.mix_plan(before).collect()}
            assert {r.doc_id: r.taken for r in docs.collect()} == {d: n for d, n in plan.items() if n}
    assert docs.count() > 0


def test_run_is_the_sql(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    got = [tuple(r) for r in out.collect()]
    assert got and {"doc_id", "text", "taken", "target"} <= set(out.columns)
    same(got, out.columns, duck(sf_dir), cp.ORACLE_SQL)


def test_stages_on_empty_and_clashing_tables(spark, sf_dir, messy, nothing):
    for docs in (messy, nothing):
        columns = docs.columns
        for name, stage in cp.STAGES:
            docs = written(stage(spark, docs, sf_dir))
            assert name == "source mix" or docs.columns == columns
    assert docs.count() == 0
