"""A rate limit by key: an event is allowed when enough time has passed since the last allowed one of its key.

That is a recurrence. Keys with up to ``HOT_EVENTS`` events are run through in order, with one clock. The events of a busier key are
spread over all tasks instead: each time has one successor, the first time that lies the limit later; which times are
allowed is the chain of successors from the key's first time. Pointer jumping marks it: a round joins the marked times with their
successors and the successors with themselves, which doubles how far they reach, so a chain of n takes log n rounds.

Defined results for odd input: an event without a time is allowed and sets no clock; a null key is a key; of events at one time
the first by ``order`` (then any one) is judged first; a limit of 0 or less allows all; repeated rows are events of their own; an empty
table gives an empty result; all other columns come out as they went in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions import rules
from docloom.operators.ordered import in_order, nearest_after, nearest_before
from docloom.sources.scratch import removed, stored

#: A key with more events is judged by pointer jumping.
HOT_EVENTS = 1_000_000


def greedy(us: np.ndarray, last: int | None, limit: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Verdicts and waits in microseconds of a key's times in order, and the last allowed time."""
    allowed = np.zeros(len(us), bool)
    i = 0 if last is None else int(np.searchsorted(us, last + limit))
    before = last
    while i < len(us):
        allowed[i] = True
        last = int(us[i])
        i = max(int(np.searchsorted(us, last + limit)), i + 1)
    clock = np.maximum.accumulate(np.where(allowed, np.arange(len(us)), -1))
    since = np.where(clock >= 0, us[np.maximum(clock, 0)], us[:1] - limit if before is None else before)
    return allowed, np.where(allowed, 0, since + limit - us), last


def _wait_seconds(micros: np.ndarray) -> np.ndarray:
    return -(-micros // 1_000_000)


def _in_turn(limit: int):
    """For Arrow batches in the order of key and time: the same rows with verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        last: int | None = None
        for b in batches:
            keys, us, n = b["_key"], b["_us"], b.num_rows
            if not n:
                continue
            same = pc.or_(pc.fill_null(pc.equal(keys[1:], keys[:-1]), False), pc.and_(keys[1:].is_null(), keys[:-1].is_null()))
            cuts = np.r_[0, np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1, n]
            times, timed = us.fill_null(0).to_numpy(), us.is_valid().to_numpy(zero_copy_only=False)
            allowed, waits = np.ones(n, bool), np.zeros(n, np.int64)
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (key := (keys[begin].as_py(),)) != now:
                    now, last = key, None
                at = begin + np.flatnonzero(timed[begin:end])
                allowed[at], waits[at], last = greedy(times[at], last, limit)
            kept = [i for i, name in enumerate(b.schema.names) if name not in ("_key", "_us")]
            columns = [*(b.column(i) for i in kept), pa.array(allowed), pa.array(_wait_seconds(waits))]
            yield pa.RecordBatch.from_arrays(columns, [*(b.schema.names[i] for i in kept), "allowed", "wait_seconds"])

    return run


def _allowed_times(times: DataFrame, limit: int) -> DataFrame:
    """Of distinct times (k, us), the allowed ones, and for each other time the allowed one before it: (k, us, since), stored."""
    asked = times.select("k", (F.col("us") + limit).alias("at"), F.lit(0).alias("kind"), "us")
    ordered = in_order(times.select("k", F.col("us").alias("at"), F.lit(1).alias("kind"), "us").unionByName(asked), "k", "at", "kind", "us")
    here = F.when(F.col("kind") == 1, F.struct("k", "us"))
    after = nearest_after(ordered.withColumn("here", here), "here", "next").filter((F.col("kind") == 0) & (F.col("next.k") == F.col("k")))
    jump = stored(after.select("k", "us", F.col("next.us").alias("to")))
    marked = stored(times.groupBy("k").agg(F.min("us").alias("us")))
    while jump.limit(1).count():
        onward = jump.select("k", F.col("us").alias("to"), F.col("to").alias("further"))
        more = stored(marked.unionByName(marked.join(jump, ["k", "us"]).select("k", F.col("to").alias("us"))))
        doubled = stored(jump.join(onward, ["k", "to"]).select("k", "us", F.col("further").alias("to")))
        removed(marked, jump)
        marked, jump = more, doubled
    flagged = ordered.filter("kind = 1").join(marked.withColumn("one", F.lit(True)), ["k", "us"], "left")
    flagged = stored(flagged.withColumn("mark", F.when(F.col("one"), F.col("us"))))
    since = stored(nearest_before(flagged, "mark", "since").select("k", "us", "since"))
    removed(ordered, marked, jump, flagged)
    return since


def _jumped(events: DataFrame, orders: list[str], limit: int) -> DataFrame:
    """Verdicts of ``events`` with _key and _us, whose keys are hot; no key's events meet in one task."""
    rows = stored(events.withColumn("_row", F.monotonically_increasing_id()))
    key = F.struct(F.col("_key").isNull().alias("none"), F.coalesce("_key", F.lit("")).alias("key"))
    narrow = rows.select(key.alias("k"), F.col("_us").alias("us"), F.struct(*orders, "_row").alias("turn"), "_row")
    first = narrow.filter("us IS NOT NULL").groupBy("k", "us").agg(F.min("turn").alias("turn"))
    since = _allowed_times(stored(first.select("k", "us")), limit)
    judged = narrow.join(since, ["k", "us"], "left").join(first.select(F.col("turn._row").alias("_row"), F.lit(True).alias("first")), "_row", "left")
    fine = F.col("us").isNull() | ((F.col("us") == F.col("since")) & F.coalesce("first", F.lit(False)))
    wait = F.ceil((F.col("since") + limit - F.col("us")) / 1_000_000)
    verdict = judged.select("_row", fine.alias("allowed"), F.when(fine, F.lit(0)).otherwise(wait).cast("long").alias("wait_seconds"))
    return rows.join(verdict, "_row").drop("_row", "_key", "_us")


def rate_limit(
    events: DataFrame, key: str, ts: str, order: str | list[str], seconds: float = rules.RATE_SECONDS, hot: int | None = None
) -> DataFrame:
    """Adds ``allowed`` and ``wait_seconds``, whole seconds up to the time at which the event would have been allowed.

    ``hot`` is the number of events from which on a key is judged by pointer jumping (None: `HOT_EVENTS`; 0: all keys are).
    """
    orders, limit = [order] if isinstance(order, str) else order, int(seconds * 1e6)
    if limit <= 0:
        return events.withColumn("allowed", F.lit(True)).withColumn("wait_seconds", F.lit(0).cast("long"))
    hot = HOT_EVENTS if hot is None else hot
    keyed = events.withColumns({"_key": F.col(key).cast("string"), "_us": F.unix_micros(F.col(ts).cast("timestamp"))})
    # There are fewer hot keys than events / hot.
    busy = [r[0] for r in keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("_key").collect()] if hot else None
    schema = StructType([*events.schema]).add("allowed", "boolean").add("wait_seconds", "long")
    if busy == []:
        cold, heat = keyed, None
    elif busy is None:
        cold, heat = None, keyed
    else:
        names = F.broadcast(events.sparkSession.createDataFrame([(b,) for b in busy], "_busy string"))
        on = F.col("_key").eqNullSafe(F.col("_busy"))
        cold, heat = keyed.join(names, on, "left_anti"), keyed.join(names, on, "left_semi")
    parts = []
    if cold is not None:
        parts.append(cold.repartition("_key").sortWithinPartitions("_key", "_us", *orders).mapInArrow(_in_turn(limit), schema))
    if heat is not None:
        parts.append(_jumped(heat, orders, limit).select(schema.names))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
