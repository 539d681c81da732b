"""The rate limit on quiet and busy keys, and what it leaves of the caller's columns."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from docloom.operators import validation
from docloom.operators.rates import rate_limit
from tests.test_operators import GOOD, SCHEMA


def plain(rows: list[tuple], seconds: int) -> dict[int, tuple[bool, int]]:
    """(id, key, microseconds or None) in a loop."""
    clocks, out = {}, {}
    for i, key, us in sorted(rows, key=lambda r: (str(r[1]), r[2] is not None, r[2] or 0, r[0])):
        rest = 0 if us is None or key not in clocks else clocks[key] + seconds * 1_000_000 - us
        out[i] = (rest <= 0, max(0, -(-rest // 1_000_000)))
        if us is not None and rest <= 0:
            clocks[key] = us
    return out


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, us long").withColumn("ts", F.timestamp_micros("us")).repartition(3)


def some(n: int) -> list[tuple]:
    r = random.Random(11)
    keys = ["hot"] * 4 + [None, "", "a", "b"]
    return [(i, r.choice(keys), None if r.random() < 0.03 else r.choice([r.randrange(4_000_000_000), 60_000_000 * r.randrange(60)])) for i in range(n)]


def test_pointer_jumping_is_the_loop(spark):
    """All keys by jumping, all by one clock a key, and some by each: ties, null keys and events without a time included."""
    rows = some(900)
    want = plain(rows, 60)
    assert sum(not ok for ok, _ in want.values()) > 300
    for hot in (0, None, 150):
        out = rate_limit(events(spark, rows), "key", "ts", "id", 60, hot).collect()
        assert {r.id: (r.allowed, r.wait_seconds) for r in out} == want and len(out) == len(rows)
    assert rate_limit(events(spark, rows).limit(0), "key", "ts", "id", 60, 0).count() == 0
    assert rate_limit(events(spark, rows), "key", "ts", "id", 0).filter("NOT allowed").count() == 0


def test_one_long_chain(spark):
    """A key whose every event is allowed, which is the longest chain there is, and one of which almost none is."""
    rows = [(i, "all", i * 60_000_000) for i in range(300)] + [(1000 + i, "few", i * 1000) for i in range(300)] + [(5000 + i, "same", 7) for i in range(50)]
    out = rate_limit(events(spark, rows), "key", "ts", "id", 60, 0).collect()
    assert {r.id: (r.allowed, r.wait_seconds) for r in out} == plain(rows, 60)
    assert sum(r.allowed for r in out) == 302


def test_a_busy_key_is_spread(spark):
    """The ranges in which times are put in order hold parts of the busy key, none of them all of it."""
    from docloom.operators.ordered import PART, in_order

    rows = some(4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else be one partition
    try:
        placed = in_order(events(spark, rows).filter("key = 'hot'").repartition(8), "key", "us", "id")
        sizes = [n for _, n in placed.groupBy(PART).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_columns_stay_as_they_are(spark):
    """Long ids next to nulls, booleans with nulls, decimals and arrays come out as they went in."""
    schema = "id long, key string, ts timestamp, big long, flag boolean, price decimal(30,10), list array<int>"
    t0 = dt.datetime(2024, 1, 1)
    rows = [(2**53 + 1 + i, "k", t0 + dt.timedelta(seconds=i), *more) for i, more in enumerate([(2**53 + 1, None, None, [1, None]), (None, True, Decimal(1), None), (7, False, Decimal(2), [])])]
    rows.append((None, "k", t0, 2**53 + 3, None, None, None))
    table = spark.createDataFrame(rows, schema)
    for hot in (0, None):
        out = rate_limit(table, "key", "ts", "id", 60, hot)
        assert out.columns == [*table.columns, "allowed", "wait_seconds"]
        assert sorted(map(str, out.select(table.columns).collect())) == sorted(map(str, table.collect()))


def test_requests_keep_their_ids(spark):
    paths = spark.createDataFrame([("docs/v6_docs/known.md",)], "path string")
    rows = [tuple((GOOD | {"request_id": i, "contributorName": f"c{k}"}).values()) for k, i in enumerate((2**53 + 1, None, 5, 2**53 + 3))]
    out = validation.validate_requests(spark.createDataFrame(rows, SCHEMA).coalesce(1), paths)
    assert sorted(str(r.request_id) for r in out.collect()) == sorted(str(r[0]) for r in rows)
    assert out.schema["request_id"].dataType.simpleString() == "bigint" and out.filter("status = 'accepted'").count() == 4


def test_requests_are_judged_once(spark):
    """The plan reads stored verdicts: no pattern is matched in it, and no text goes to the clock."""
    paths = spark.createDataFrame([("docs/v6_docs/known.md",)], "path string")
    out = validation.validate_requests(spark.createDataFrame([tuple(GOOD.values())], SCHEMA), paths)
    plan = out._jdf.queryExecution().toString()
    assert "RLIKE" not in plan.upper().split("PHYSICAL PLAN")[1]
    clock = plan.split("== Physical Plan ==")[1].split("MapInArrow")[1]
    assert "content" not in clock.split("ReadSchema")[1].split("\n")[0]
