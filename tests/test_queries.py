"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from docloom.plans import catalog
from tests.compare import duck, same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    out = catalog.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in out.collect()]
    assert got
    if sql := catalog.ORACLES.get(name):
        same(got, out.columns, duck(sf_dir), sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
