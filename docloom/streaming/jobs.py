"""The same operators on streams: documents that change, requests that arrive, a rate limit as keyed state.

A verdict is never rewritten. The rate limit has two forms. With a ``delay`` events wait until the watermark has passed them and
are judged in the order of their times, whatever order they came in. Without one each micro-batch is judged as it comes, in order
of time, then id; an event that comes after a later one of its key is then judged by the clock as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions import rules
from docloom.operators.chunks import build_chunks
from docloom.operators.rates import greedy
from docloom.operators.validation import stage_errors
from docloom.sources.buckets import BUCKETS, merge_into_buckets
from docloom.sources.files import write_outcomes


def merge_batch(
    target: str, stream: str, most: int = rules.MAX_TOKENS, embed: Callable | None = None, buckets: int = BUCKETS, **options
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the last version of each path is chunked and replaces its file's chunks in the table at ``target``.

    More ``options`` are those of `build_chunks`.

    Only the buckets of files in the batch are read and rewritten. A batch that runs again changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("text", F.struct("ts", "text")).alias("text"))
        fresh = build_chunks(last, most, **options)
        if embed is not None:
            fresh = fresh.withColumn("embedding", embed(fresh))
        merge_into_buckets(fresh, target, stream, batch_id, buckets)

    return run


def stream_ingest(files: DataFrame, target: str, checkpoint: str, **options):
    """``files(path, text, ts)`` flow into the table at ``target`` (see `read_buckets`); returns the started query of what is there."""
    return (
        files.writeStream.foreachBatch(merge_batch(target, checkpoint, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_outcomes(judged: DataFrame, out: str, checkpoint: str):
    """Payloads of judged requests, a folder a batch, which a batch that runs again overwrites; returns the started query."""
    return (
        judged.writeStream.foreachBatch(lambda batch, batch_id: write_outcomes(batch, out, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_validate(requests: DataFrame, paths: DataFrame) -> DataFrame:
    """Stages 1 to 5 of a request stream; existence is a join with a static table."""
    known = paths.select(F.col("path").alias("filePath")).distinct().withColumn("path_exists", F.lit(True))
    joined = requests.join(known, "filePath", "left").withColumn("path_exists", F.coalesce("path_exists", F.lit(False)))
    return stage_errors(joined)


RATE_SCHEMA = "key long, event_id long, us long, allowed boolean, wait_seconds long"


#: Waiting events of a key that lie in one value of state; a busier key's lie in slots of time, with a quarter as many on average.
FEW = 16_384


def _judge(key, us: np.ndarray, ids: np.ndarray, last: int | None, limit: int) -> tuple[pd.DataFrame, int | None]:
    """Verdicts of a key's events in order, and the time of the last allowed one."""
    order = np.lexsort((ids, us))
    us, ids = us[order], ids[order]
    allowed, waits, last = greedy(us, last, limit)
    return pd.DataFrame({"key": key[0], "event_id": ids, "us": us, "allowed": allowed, "wait_seconds": -(-waits // 1_000_000)}), last


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return frame["us"].to_numpy(np.int64), frame["event_id"].to_numpy(np.int64)


def _both(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([us for us, _ in parts]), np.concatenate([ids for _, ids in parts])


def _read(value: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(value[0], np.int64), np.frombuffer(value[1], np.int64)


def _written(us: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    return us.tobytes(), ids.tobytes()


class RateLimiter(StatefulProcessor):
    """State: the time of a key's last allowed event, in microseconds."""

    def __init__(self, seconds: float) -> None:
        self.limit = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, last = _judge(key, *_both(*map(_arrays, rows)), self.last.get()[0] if self.last.exists() else None, self.limit)
        self.last.update((last,))
        yield out

    def close(self) -> None:
        pass


class OrderedRateLimiter(StatefulProcessor):
    """Events wait in state until the watermark has passed the step of time they fall in, and are then judged in order of time.

    A key has one value: its clock, and its waiting events up to ``few`` of them. What more of them wait lie in slots of time, whose
    width is that in which ``few`` / 4 events of the key lie on average when it gets so busy, and a task holds one slot of one key. A key costs
    a timer and a few reads and writes a micro-batch, however many events it has, and a busy one a read and a write a slot. A clock is
    dropped once the watermark has passed the end of its wait, when it can no longer change a verdict.
    """

    def __init__(self, seconds: float, step_ms: int, few: int = FEW) -> None:
        self.limit, self.step, self.few = int(seconds * 1e6), step_ms, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A width of 0 steps: there are no slots.
        self.state = handle.getValueState("state", "last long, width long, us binary, ids binary")
        self.slots = handle.getMapState("slots", "slot long", "us binary, ids binary")

    def _ends(self, us: np.ndarray) -> np.ndarray:
        """The milliseconds at which the steps of events end."""
        return (us // (1000 * self.step) + 1) * self.step

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, width, *held = self.state.get() or (None, 0, b"", b"")
        first, held = [], _read(held)
        for new in map(_arrays, rows):
            first.append(int(self._ends(new[0]).min()))
            if not width:
                held = new = _both(held, new)
                if len(new[0]) <= self.few:
                    continue
                steps = int(np.ptp(new[0])) // (1000 * self.step) + 1
                width, held = max(1, steps * self.few // (4 * len(new[0]))), _read((b"", b""))
            self._into_slots(width, *new)
        self.state.update((last, width, *_written(*held)))
        self.handle.registerTimer(min(first))
        yield from ()

    def _into_slots(self, width: int, us: np.ndarray, ids: np.ndarray) -> None:
        slot = us // (1000 * self.step * width)
        order = np.argsort(slot, kind="stable")
        names, begin = np.unique(slot[order], return_index=True)
        for name, at in zip(names.tolist(), np.split(order, begin[1:]), strict=True):
            old = self.slots.getValue((name,)) if self.slots.containsKey((name,)) else (b"", b"")
            self.slots.updateValue((name,), _written(*_both(_read(old), (us[at], ids[at]))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value = self.state.get()
        if value is None:
            return
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        last, width, *held = value
        parts, further = [(None, _read(held))], None
        if width:
            names = sorted(name for (name,) in self.slots.keys())
            begins = [name * self.step * width for name in names]
            parts = ((name, _read(self.slots.getValue((name,)))) for name, begin in zip(names, begins, strict=True) if begin < now)
            further = min((begin + self.step for begin in begins if begin >= now), default=None)
        left = _read((b"", b""))
        for name, (us, ids) in parts:
            due = self._ends(us) <= now
            if due.any():
                out, last = _judge(key, us[due], ids[due], last, self.limit)
                yield out
            rest = us[~due], ids[~due]
            if name is None:
                left = rest
            elif not len(rest[0]):
                self.slots.removeKey((name,))
            elif due.any():
                self.slots.updateValue((name,), _written(*rest))
            if len(rest[0]):
                first = int(self._ends(rest[0]).min())
                further = first if further is None else min(first, further)
        if further is None:
            width = 0
            if last is None or last + self.limit <= now * 1000:
                self.state.clear()
                return
            # One step after the end of the wait, so that the step it ends in has been judged.
            further = ((last + self.limit) // (1000 * self.step) + 2) * self.step
        self.state.update((last, width, *_written(*left)))
        self.handle.registerTimer(further)

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, seconds: float = rules.RATE_SECONDS, delay: str | None = None, step_ms: int = 1000) -> DataFrame:
    """``events(key, event_id, us)`` with ``allowed`` and ``wait_seconds``; needs the RocksDB state store.

    With ``delay`` (such as "10 minutes") events may come out of order by so much and get the batch's verdicts. Later ones are left
    out by the watermark, and the verdicts of the last ``delay`` wait for the events that move it on.
    """
    if delay is None:
        return events.groupBy("key").transformWithStateInPandas(
            statefulProcessor=RateLimiter(seconds), outputStructType=RATE_SCHEMA, outputMode="Append", timeMode="None"
        )
    timed = events.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=OrderedRateLimiter(seconds, step_ms, FEW), outputStructType=RATE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
