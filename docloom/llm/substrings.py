"""Suffix-array dedup: removes every byte covered by a 400-byte string that also starts elsewhere.

The method is not prefix doubling: no position is sorted by pairs of ranks at growing offsets. It picks anchors by
content (winnowing), then compares hashes of whole zones and of 400-byte strings, for the same result:

1. The anchor of a 400-byte string is the 96-byte string in it with the least hash. Equal strings have equal
   anchors at equal places in them. The strings of a document that follow each other with one anchor
   are a zone, about 120 of them. Zones are named by their anchor's 96 bytes; those with a unique name
   hold no repeated string and are dropped.
2. The rest are named by all bytes of their strings. Zones with equal names repeat as a whole, however
   many copies there are.
3. Zones left alone by round 2, in an anchor group that has others, are compared string by string, at the
   full 400 bytes, with one zone for each name of the group. A group of more than HOT such zones is not
   gathered: its strings are counted by an aggregate.

The same rounds run over words: strings of 51 words, with anchors of 11, are passages of over 50 words, which may have
fewer than 400 bytes or other white space. They are reported, as words covered by a passage that also starts elsewhere,
and not removed.

Names are 128-bit hashes, and 64-bit ones in round 1, which only selects candidates.

Defined results for odd input: text is UTF-8 bytes, null as empty; a text shorter than 400 bytes keeps all;
repeated rows repeat each other's strings, with equal results; rows with equal or null doc_id are told
apart by their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkernel as tk
from docloom.llm.shared import dropped, marked, written

LENGTH = 400
HOT = 4096
#: Length of the strings and of their anchors, in bytes and in words.
BYTES, WORDS = 0, 1
UNITS = ((LENGTH, 96), (51, 11))

_PLACES = "unit int, first int, last int, anchor int, begin int, end int"
_ZONES = f"doc_id long, version long, {_PLACES}, k1 long, k2a long, k2b long"
_BYTES = "k1 long, hot boolean, known boolean, doc_id long, version long, unit int, first int, anchor int, bytes binary"
_RUNS = "doc_id long, version long, unit int, first int, last int"
_PLACE = tk.U((1 << 21) - 1)


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = tk.POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, tk.U)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums


def _values(x: np.ndarray, unit: int, seed: int) -> np.ndarray:
    """A 64-bit value for each byte, or for each word's hash."""
    return tk.byte_table(seed)[x] if unit == BYTES else tk.mixed(x + tk.U(seed))


def find_zones(x: np.ndarray, offsets: np.ndarray, unit: int = BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Zones (first, last, anchor, k1, k2a, k2b) of the documents, whose bytes or words are x; places count in x."""
    whole_length, short = UNITS[unit]
    n, width = len(x), whole_length - short + 1
    for begin in range(0, n, tk.SLICE):
        end = min(begin + tk.SLICE, n)
        part = x[begin : min(end + whole_length - 1, n)]
        if len(part) < whole_length:
            continue
        _, down = tk.POWERS.get(len(part) + 1)
        s, t = _sums(_values(part, unit, 11)), _sums(_values(part, unit, 12))
        grams = tk.mixed((s[short:] - s[:-short]) * down[: len(s) - short] + tk.U(unit))
        # The least of each window of grams, the leftmost of equals: place in the low bits.
        least, span = (grams & ~_PLACE) | np.arange(len(grams), dtype=tk.U), 1
        m = len(grams) - width + 1
        while span * 2 <= width:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        least = np.minimum(least[:m], least[width - span : width - span + m])[: end - begin]
        places = np.arange(len(least)) + begin
        whole = places + whole_length <= offsets[np.searchsorted(offsets, places, "right")]
        new, old = whole.copy(), whole.copy()
        change = least[1:] != least[:-1]
        new[1:] &= ~whole[:-1] | change
        old[:-1] &= ~whole[1:] | change
        first, last = np.flatnonzero(new), np.flatnonzero(old)
        anchor = (least[first] & _PLACE).astype(np.int64)
        shape = ((last - first) * whole_length + (anchor - first)).astype(tk.U)
        u, v = ((q[last + whole_length] - q[first]) * down[first] for q in (s, t))
        k2a, k2b = tk.mixed(u + tk.mixed(v + shape)), tk.mixed(v + tk.mixed(u ^ (shape + tk.U(1))))
        yield first + begin, last + begin, anchor + begin, grams[anchor], k2a, k2b


def _zone_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_bytes, all_offsets = tk.text_bytes(batch.column(2))
        for i, j in tk.parts(all_offsets):
            raw, offsets = all_bytes[all_offsets[i] : all_offsets[j]], all_offsets[i : j + 1] - all_offsets[i]
            words, starts, ends, bounds = tk.placed_words(raw, offsets)
            for unit, x, at in ((BYTES, raw, offsets), (WORDS, words, bounds)):
                for first, last, anchor, *names in find_zones(x, at, unit):
                    doc = np.searchsorted(at, first, "right") - 1
                    rows = pa.array(doc + i)
                    begin, end = (first, last + LENGTH) if unit == BYTES else (starts[first], ends[last + UNITS[WORDS][0] - 1])
                    numbers = [np.full(len(doc), unit), *(c - at[doc] for c in (first, last, anchor)), begin - offsets[doc], end - offsets[doc]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows)]
                        + [pa.array(c.astype(np.int32)) for c in numbers]
                        + [pa.array(c.astype(np.int64)) for c in names],
                        ["doc_id", "version", "unit", "first", "last", "anchor", "begin", "end", "k1", "k2a", "k2b"],
                    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        raw, offsets = tk.text_bytes(batch.column(2))
        for i, j in tk.parts(offsets):
            z = [pack(raw[a:b].tobytes()) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(z, pa.binary())], ["doc_id", "version", "z"]
            )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")


def _joined(text: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Documents, their text compressed for the shuffle, joined with a list for each document."""
    packed = text.select("doc_id", "version", "text").mapInArrow(_packed, "doc_id long, version long, z binary")
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "list")
    same = packed["doc_id"].eqNullSafe(lists["_id"]) & (packed["version"] == lists["_version"])
    return packed.join(lists, same, how).select("doc_id", "version", "z", "list")


def _maybe(docs: DataFrame, lists: DataFrame) -> DataFrame:
    key = F.xxhash64("doc_id", "version")
    return marked(_keyed(docs), key, lists, key)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed zones."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows, size = [], 0
        for doc_id, version, z, zones in zip(*(batch.column(k) for k in range(4)), strict=True):
            text = unpack(z.as_py())
            for q in zones.as_py():
                piece = text[q["begin"] : q["end"]]
                rows.append((q["k1"], q["hot"], q["known"], doc_id.as_py(), version.as_py(), q["unit"], q["first"], q["anchor"], piece))
                size += len(piece)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(_CUT_TYPE.names, r, strict=True)) for r in rows], _CUT_TYPE)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_CUT_TYPE.names, r, strict=True)) for r in rows], _CUT_TYPE)


_CUT_TYPE = pa.schema(
    [("k1", pa.int64()), ("hot", pa.bool_()), ("known", pa.bool_()), ("doc_id", pa.int64()), ("version", pa.int64()),
     ("unit", pa.int32()), ("first", pa.int32()), ("anchor", pa.int32()), ("bytes", pa.binary())]
)


def _by_unit(t: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    units = t.column("unit").to_numpy()
    for unit in (BYTES, WORDS):
        if (units == unit).any():
            yield unit, t.filter(pa.array(units == unit))


def _strings(t: pa.RecordBatch, unit: int) -> tuple[np.ndarray, ...]:
    """All strings of the zones: zone, place in the document, and two hashes with the offset of the anchor."""
    data, length = t.column("bytes").cast(pa.large_binary()), UNITS[unit][0]
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    x = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if unit == WORDS:
        x, at = tk.word_hashes(x, at)
    counts = np.diff(at) - length + 1
    zone = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = t.column("first").to_numpy().astype(np.int64)
    s = at[:-1][zone] + step
    _, down = tk.POWERS.get(len(x) + 1)
    u, v = ((q[s + length] - q[s]) * down[s] for q in (_sums(_values(x, unit, 13)), _sums(_values(x, unit, 14))))
    place = first[zone] + step
    offset = (t.column("anchor").to_numpy().astype(np.int64)[zone] - place).astype(tk.U)
    k1 = t.column("k1").to_numpy().astype(tk.U)[zone]
    return zone, place, tk.mixed(u + tk.mixed(v + offset) + k1), tk.mixed(v + tk.mixed(u ^ (k1 + offset)))


def _runs(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of repeated strings in the zones that round 2 left alone; all zones of a group are in t."""
    for unit, own in _by_unit(t):
        zone, place, h, g = _strings(own, unit)
        order = np.lexsort((g, h))
        same = np.r_[False, (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1]), False]
        again = np.zeros(len(h), bool)
        again[order] = same[1:] | same[:-1]
        again &= ~own.column("known").to_numpy(zero_copy_only=False)[zone]
        z, p = zone[again], place[again]
        if len(z):
            new = np.r_[True, (z[1:] != z[:-1]) | (p[1:] != p[:-1] + 1)]
            rows = pa.array(z[new])
            yield pa.RecordBatch.from_arrays(
                [own.column(c).take(rows) for c in ("doc_id", "version", "unit")]
                + [pa.array(c.astype(np.int32)) for c in (p[new], p[np.r_[new[1:], True]])],
                ["doc_id", "version", "unit", "first", "last"],
            )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_runs` over whole groups of k1, a few hundred zones or one group at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        k = table["k1"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1]
        done = 0
        for i, cut in enumerate(cuts):
            if cut - done >= 512 or i == len(cuts) - 1:
                if cut > done:
                    yield from _runs(table.slice(done, cut - done).combine_chunks().to_batches()[0])
                done = cut
        rest = table.slice(done)
    if rest is not None and rest.num_rows:
        yield from _runs(rest.combine_chunks().to_batches()[0])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            for unit, t in _by_unit(batch.slice(i, 512)):
                zone, place, h, g = _strings(t, unit)
                rows = pa.array(zone)
                yield pa.RecordBatch.from_arrays(
                    [t.column(c).take(rows) for c in ("doc_id", "version", "unit")]
                    + [pa.array(place.astype(np.int32)), t.column("known").take(rows), pa.array(h.astype(np.int64)), pa.array(g.astype(np.int64))],
                    ["doc_id", "version", "unit", "first", "known", "h", "g"],
                )


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs of places where a repeated string starts, for each unit: doc_id, version, unit, first, last; runs may overlap."""
    zones = _keyed(docs).mapInArrow(_zone_rows, _ZONES)
    # Written, so that both sides of the join are plain exchanges, whose hot partitions adaptive execution splits.
    shared = written(zones.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1"))
    some = marked(zones, F.col("k1"), shared, F.col("k1")).filter("maybe").select(*zones.columns)
    zones = written(some.join(shared, "k1").select(*zones.columns))
    dropped(shared)
    place = F.struct("doc_id", "version", "unit", "first", "last", "anchor", "begin", "end")
    names = written(zones.groupBy("k1", "k2a", "k2b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("zone")))
    whole = names.filter("n > 1").select("k2a", "k2b")
    runs = zones.join(whole, ["k2a", "k2b"]).select("doc_id", "version", "unit", "first", "last")
    # Written, so that a hot key's partition of names is split, as above.
    mixed_groups = written(
        names.groupBy("k1")
        .agg(F.count(F.lit(1)).alias("names"), F.min("n").alias("least"))
        .filter("names > 1 AND least = 1")
        .select("k1", (F.col("names") > HOT).alias("hot"))
    )
    wanted = names.join(mixed_groups, "k1").select(
        "zone.doc_id", "zone.version",
        F.struct("k1", "hot", (F.col("n") > 1).alias("known"), *[f"zone.{c}" for c in ("unit", "first", "last", "anchor", "begin", "end")]).alias("q"),
    )
    lists = written(wanted.groupBy("doc_id", "version").agg(F.collect_list("q").alias("list")))
    # Repeated rows of a document would cut its zones again.
    pieces = written(
        _joined(_maybe(docs, lists).filter("maybe"), lists).mapInArrow(_cut, _BYTES).dropDuplicates(["doc_id", "version", "unit", "first"])
    )
    dropped(lists, mixed_groups)
    runs = runs.union(
        pieces.filter("NOT hot").repartition("k1").sortWithinPartitions("k1").mapInArrow(_compared, _RUNS)
    )
    if pieces.filter("hot").limit(1).count():
        strings = pieces.filter("hot").mapInArrow(
            _counted, "doc_id long, version long, unit int, first int, known boolean, h long, g long"
        )
        again = strings.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g")
        found = strings.filter("NOT known").join(again, ["h", "g"])
        runs = runs.union(found.select("doc_id", "version", "unit", "first", F.col("first").alias("last")))
    out = written(runs)
    dropped(zones, names, pieces)
    return out


def _merged(runs: list[tuple[int, int]], length: int) -> list[list[int]]:
    spans: list[list[int]] = []
    for first, last in sorted(runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    return spans


_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
     ("kept", pa.binary()), ("passage_words", pa.int64())]
)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows, size = [], 0
        for doc_id, z, runs in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
            text, runs = unpack(z.as_py()), runs.as_py() or ()
            spans, passages = (_merged([(r["first"], r["last"]) for r in runs if r["unit"] == u], UNITS[u][0]) for u in (BYTES, WORDS))
            kept, at = [], 0
            for start, end in spans:
                kept.append(text[at:start])
                at = end
            words = sum(end - start for start, end in passages)
            rows.append((doc_id.as_py(), len(text), [{"start": a, "end": b} for a, b in spans], b"".join([*kept, text[at:]]), words))
            size += len(text)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KEPT.types, strict=True)], schema=_KEPT)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KEPT.types, strict=True)], schema=_KEPT)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans removed (start, end), kept bytes, words in repeated passages."""
    runs = repeated_runs(docs)
    lists = written(runs.groupBy("doc_id", "version").agg(F.collect_set(F.struct("unit", "first", "last")).alias("list")))
    dropped(runs)
    rows = _maybe(docs, lists)
    changed = _joined(rows.filter("maybe"), lists, "left").mapInArrow(
        _kept, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, passage_words long"
    )
    raw = F.coalesce("text", F.lit("")).cast("binary")
    same = rows.filter("NOT maybe").select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.array().cast(changed.schema["spans"].dataType).alias("spans"),
        raw.alias("kept"), F.lit(0).cast("long").alias("passage_words"),
    )
    return changed.union(same)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "passage_words",
    )


#: Every string of 400 bytes and of 51 words by its digest; texts are cut first, as DuckDB walks a text to find a place in it.
SQL = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
piece AS (SELECT r, k, substr(x, 2000 * k + 1, 2798) AS y FROM d, unnest(range(0, strlen(x) // 2000 + 1)) AS u(k)),
place AS MATERIALIZED (
    SELECT r, 1000 * k + i AS o, md5(substr(y, 2 * i + 1, 800)) AS h
    FROM piece, unnest(range(0, least(1000, strlen(y) // 2 - 399))) AS u(i)
),
again AS (SELECT r, o FROM place WHERE h IN (SELECT h FROM place GROUP BY h HAVING count(*) > 1)),
cut AS (SELECT r, o, o - lag(o, 1, -1000) OVER (PARTITION BY r ORDER BY o) > 400 AS new FROM again),
span AS (
    SELECT r, min(o) AS s, max(o) + 400 AS e
    FROM (SELECT r, o, sum(new::INT) OVER (PARTITION BY r ORDER BY o) AS g FROM cut) GROUP BY r, g
),
gap AS (
    SELECT r, s AS k, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS a, s AS b FROM span
    UNION ALL SELECT r, strlen(x) // 2 + 1, coalesce(e, 0), strlen(x) // 2 FROM d LEFT JOIN (SELECT r, max(e) AS e FROM span GROUP BY r) USING (r)
),
kept AS (SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY k) AS y FROM gap JOIN d USING (r) GROUP BY r),
word AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS o FROM d),
passage AS MATERIALIZED (
    SELECT r, o, md5(y) AS h
    FROM (
        SELECT r, o, string_agg(w, ' ') OVER f AS y, count(*) OVER f AS n
        FROM word WINDOW f AS (PARTITION BY r ORDER BY o ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)
    ) WHERE n = 51
),
said AS (SELECT r, o FROM passage WHERE h IN (SELECT h FROM passage GROUP BY h HAVING count(*) > 1)),
spoken AS (
    SELECT r, sum(least(51, o - before)) AS n
    FROM (SELECT r, o, lag(o, 1, -51) OVER (PARTITION BY r ORDER BY o) AS before FROM said) GROUP BY r
)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(c.n, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(y)) AS kept_sha256, coalesce(p.n, 0)::BIGINT AS passage_words
FROM d JOIN kept USING (r) LEFT JOIN (SELECT r, sum(e - s) AS n, count(*) AS spans FROM span GROUP BY r) c USING (r) LEFT JOIN spoken p USING (r)
"""
