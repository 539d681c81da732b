"""Periodic run detection: words that go round and round, found by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(least_length, 4 q)`` words long, that no neighbouring word
extends. With L the power of two in q <= L < 2 q (2 for q = 1), such a run contains a whole dyadic block, the L words from a
multiple of L on, and the block occurs again exactly q words on or q words back, and nowhere nearer: L words of a string of
smallest period q <= L recur in it at multiples of q only. So the candidate periods of a block are the distances to its next
occurrences on both sides. All suffixes are sorted by doubling, which leaves the occurrences of every block in one range of the
suffix array; a wavelet tree over that array answers range successor and predecessor. Candidates of neighbouring blocks form
progressions, of which one is enough, and common extensions by the ranks of the doubling make a run of it.

Spark deals the rows out; a task works on texts of about a million bytes at a time, or on one text that is longer. Of a text
of n words it holds some 8 n log2(n) bytes, and time is n log(n) whatever the words are.

Defined results for odd input: a null or empty text has no words and no runs; rows are judged one by one, so repeated rows
and equal or null doc_id values change nothing; a null doc_id counts as the empty string where its checksum is asked for; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.textkernel import parts, text_bytes, word_keys, word_places

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
SLICE_BYTES = 1 << 20
SPACES = r"[\x20\x09-\x0D]+"

RUNS = "array<struct<start: long, length: long, period: long>>"


class Wavelet:
    """A wavelet tree (as a matrix of bits) over whole numbers below ``bound``, for many queries at once."""

    def __init__(self, values: np.ndarray, bound: int) -> None:
        self.bits = range(max(int(bound - 1).bit_length(), 1) - 1, -1, -1)
        self.zeros: list[np.ndarray] = []
        for bit in self.bits:
            one = values >> bit & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            values = np.r_[values[~one], values[one]]

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the numbers lo..hi-1 are below a value."""
        count = np.zeros(len(lo), np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            one = value >> bit & 1 == 1
            a, b = zeros[lo], zeros[hi]
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th of the numbers lo..hi-1 by size, from 0."""
        value = np.zeros(len(lo), np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            a, b = zeros[lo], zeros[hi]
            one = n >= b - a
            value |= one.astype(np.int64) << bit
            n = np.where(one, n - (b - a), n)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return value


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys; for each place in that order, where its group of equal keys begins, and the group's size."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(keys)])
    return order, np.repeat(first, sizes), np.repeat(sizes, sizes)


class _Ranks:
    """Ranks of all strings of 1, 2, 4, ... words, by doubling; equal ranks are equal strings of one document."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray) -> None:
        counts = np.diff(bounds)
        self.n = len(words)
        self.begin, self.end = np.repeat(bounds[:-1], counts), np.repeat(bounds[1:], counts)
        _, names = np.unique(words, return_inverse=True)
        own = np.repeat(np.arange(len(counts)), counts) * (int(names.max(initial=0)) + 1) + names
        order, head, size = _grouped(own)
        rank, often = np.empty(self.n, np.int64), np.empty(self.n, bool)
        rank[order], often[order] = head, size > 1
        self.levels = [rank.astype(np.int32)]
        # The suffix array, of suffixes whose first two words occur again in the document.
        at = np.flatnonzero(often & (np.arange(self.n) + 1 < self.end))
        order, head, size = _grouped(rank[at] * self.n + rank[at + 1])
        again = size > 1
        self.suffixes = at[order][again]
        _, head, self.size = _grouped(head[again])
        self.head = head
        self._told()

    def _told(self) -> None:
        rank = len(self.suffixes) + np.arange(self.n)  # no other has it
        rank[self.suffixes] = self.head
        self.levels.append(rank.astype(np.int32))

    def double(self) -> None:
        """From strings of 2^k words to those of 2^(k+1): only groups of several are sorted, each in its own places."""
        step, rank = 1 << (len(self.levels) - 1), self.levels[-1]
        slots = np.flatnonzero(self.size > 1)
        at = self.suffixes[slots]
        after = np.where(at + step < self.end[at], rank[np.minimum(at + step, self.n - 1)].astype(np.int64) + 1, 0)
        order, head, size = _grouped(self.head[slots] * (2 * self.n + 2) + after)
        self.suffixes[slots], self.head[slots], self.size[slots] = at[order], slots[head], size
        self._told()

    def shared(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """Number of equal words from x and y > x of one document on, or before them."""
        far = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step, rank, live = 1 << k, self.levels[k], np.arange(len(x))
            while len(live):
                a, b = (x[live] - far[live] - step, y[live] - far[live] - step) if back else (x[live] + far[live], y[live] + far[live])
                inside = a >= self.begin[x[live]] if back else b + step <= self.end[x[live]]
                live, a, b = live[inside], a[inside], b[inside]
                live = live[rank[a] == rank[b]]
                far[live] += step
                if k < len(self.levels) - 1:
                    break
        return far


def find_runs(
    words: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period; ``bounds`` are the documents' offsets in ``words``."""
    longest = int(np.diff(bounds).max(initial=0))
    none = np.zeros(0, np.int64)
    if longest < LEAST_LENGTH:
        return none, none, none, none
    ranks = _Ranks(words, bounds)
    asked: list[tuple[np.ndarray, ...]] = []
    block = 2
    while len(ranks.suffixes) and 2 * block + 2 <= longest:
        slots = np.flatnonzero(ranks.size > 1)
        slots = slots[(ranks.suffixes[slots] - ranks.begin[ranks.suffixes[slots]]) % block == 0]
        asked.append((ranks.suffixes[slots], ranks.head[slots], ranks.head[slots] + ranks.size[slots], np.full(len(slots), block)))
        block *= 2
        if 2 * block + 2 <= longest:
            ranks.double()
    if not sum(len(a[0]) for a in asked):
        return none, none, none, none
    at, lo, hi, size = (np.concatenate(c) for c in zip(*asked, strict=True))
    tree = Wavelet(ranks.suffixes, ranks.n)
    n = tree.below(lo, hi, at)
    on, back = n + 1 < hi - lo, n > 0
    x = np.r_[at[on], tree.nth(lo[back], hi[back], n[back] - 1)]
    y = np.r_[tree.nth(lo[on], hi[on], n[on] + 1), at[back]]
    size = np.r_[size[on], size[back]]
    period = y - x
    fits = (period <= size) & ((2 * period > size) | (size == 2))
    x, period, size = x[fits], period[fits], size[fits]
    # Of candidates with one period whose blocks overlap or touch, the first leads to their common run.
    order = np.lexsort((x, period))
    x, period, size = x[order], period[order], size[order]
    lead = np.r_[True, (period[1:] != period[:-1]) | (x[1:] > x[:-1] + size[:-1]) | (ranks.begin[x[1:]] != ranks.begin[x[:-1]])] if len(x) else fits[:0]
    x, period = x[lead], period[lead]
    start = x - ranks.shared(x, x + period, True)
    length = x + period + ranks.shared(x, x + period, False) - start
    long = length >= np.maximum(least_length, LEAST_EXPONENT * period)
    found = np.unique(np.stack([start[long], period[long], length[long]], 1), axis=0)
    doc = np.searchsorted(bounds, found[:, 0], "right") - 1
    return doc, found[:, 0] - bounds[doc], found[:, 2], found[:, 1]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Words joined by one space, a text for each document."""
    sizes = ends - starts + 1
    out = np.r_[0, np.cumsum(sizes)]
    source = np.repeat(starts - out[:-1], sizes) + np.arange(out[-1])
    data = np.r_[raw, np.uint8(32)][np.minimum(source, len(raw))]
    data[out[1:] - 1] = 32
    # The space after a document's last word goes.
    last = out[bounds[1:]][np.diff(bounds) > 0] - 1
    data = np.delete(data, last)
    offsets = out[bounds] - np.r_[0, np.cumsum(np.diff(bounds) > 0)]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def periodic_runs(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words, by start, then period), ``n_words`` and ``collapsed``.

    ``collapsed`` is the text without the words that a run contains after its first period, joined by one space. Columns
    of these names must not be there already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            for i, j in parts(offsets, SLICE_BYTES):
                own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, bounds = word_places(own, at)
                doc, start, length, period = find_runs(word_keys(own, starts, ends), bounds, least_length)
                keep = _kept(len(starts), start + bounds[doc], length, period)
                left = np.r_[0, np.cumsum(keep)][bounds]
                spans = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), spans)
                new = [lists, pa.array(np.diff(bounds), pa.int64()), _joined(own, starts[keep], ends[keep], left).cast(pa.string())]
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, "runs", "n_words", "collapsed"])

    schema = StructType([*docs.schema, *StructType.fromDDL(f"runs {RUNS}, n_words long, collapsed string")])
    return docs.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where the id's checksum h is a multiple of 10, word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words").cast("long"), F.col("g")
    some = F.col("words").isNotNull() & (n > 0)
    rows = rows.withColumn("a", F.when(some, F.pmod(g, n)))
    rows = rows.withColumn("p", F.when(some, 1 + F.floor((n - F.col("a")) / (3 + g % 8))))
    a, p = F.col("a"), F.col("p")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    altered = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(some, altered).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.select("doc_id", "runs", "collapsed", F.get(best, 0).alias("best"), told.alias("told"))
    length, period = -F.col("best.minus"), F.col("best.period")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        digest(F.when(F.size("runs") > 0, F.concat("told", F.lit("\n"))).otherwise("")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: A run of period q has five words or more in a row that are equal q words on: runs are joined from equal strings of five words.
SQL = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: (CASE WHEN c = '' THEN -1 ELSE ord(c) END)::BIGINT)),
               lambda x, y: CASE WHEN y < 0 THEN x ELSE list_reduce(
                   list_prepend(xor(x, y), range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) END
           )) AS h
    FROM documents
),
n AS (SELECT r, h % 10 = 0 AS altered, len(words) AS n, h // 10 AS g FROM d WHERE len(words) > 0),
rule AS MATERIALIZED (SELECT r, altered, n, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM n),
word AS MATERIALIZED (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM d),
text AS MATERIALIZED (
    SELECT r, i, n, word.w
    FROM (SELECT r, i, n, CASE WHEN altered AND i >= a THEN a + (i - a) % p ELSE i END AS j FROM word JOIN rule USING (r)) t
    JOIN (SELECT r, i AS j, w FROM word) word USING (r, j)
),
five AS MATERIALIZED (
    SELECT * FROM (
        SELECT r, i, n, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS f
        FROM text WINDOW o AS (PARTITION BY r ORDER BY i)
    ) WHERE i + 5 <= n
),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM five x JOIN five y ON x.r = y.r AND x.f = y.f AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (
    SELECT r, q, min(i) AS s, max(i) - min(i) + 5 + q AS l
    FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island
),
run AS MATERIALIZED (SELECT r, s, l, min(q) AS q FROM stretch WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY l DESC, s, q) = 1),
told AS (SELECT r, count(*) AS n, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS t FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM text ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(told.n, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
       sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
