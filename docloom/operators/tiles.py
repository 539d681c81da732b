"""The best k rows for each of many queries, by tiles: every query meets every row, but no pair of them is a row of a table.

Queries are cut into tiles of bounded size and rows into shares. Each share is given every tile, tile first, so that a task reads a tile into
memory and then streams the share's rows past it, in slices; it keeps the best k of its share for each query, and only these are
shuffled again. Queries never pass the driver. Rows are read once; they travel once for each tile, of which there is one up to
QUERY_TILE queries.

Ties go by (sourceFile, chunk_index), nulls first: a share's rows come in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries in a tile, bytes of what a tile's queries are scored with, rows that are scored at once, and scores made at once.
QUERY_TILE, TILE_BYTES, SLICE, SCORES = 32_768, 128 << 20, 1024, 1 << 21

HITS = "query_id long, sourceFile string, chunk_index int, score double"
_HITS = pa.schema([("query_id", pa.int64()), ("sourceFile", pa.string()), ("chunk_index", pa.int32()), ("score", pa.float64())])
_KEYS = ["sourceFile", "chunk_index"]

#: For the queries' column, a function from the rows' column to scores of (rows, queries first to last) for any first and last.
Scorer = Callable[[pa.Array], Callable[[pa.Array, int, int], np.ndarray]]


class Versions:
    """Which rows' versions fit which queries: those of all and both take any, others their own and both."""

    def __init__(self, queries: list) -> None:
        self.code = {v: i for i, v in enumerate(dict.fromkeys(v for v in queries if v not in ("all", "both")))}
        self.asked = np.array([-1 if v in ("all", "both") else self.code[v] for v in queries], np.int64)

    def fit(self, rows: list, first: int, last: int) -> np.ndarray:
        own = np.array([-2 if v == "both" else self.code.get(v, -3) if v is not None else -3 for v in rows], np.int64)[:, None]
        asked = self.asked[None, first:last]
        return (asked == -1) | (own == -2) | (own == asked)


class Best:
    """The best k of the rows seen so far for each of n queries; an earlier row wins a tie."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.floor = np.full(n, -np.inf)
        self.most = max(2 * k * n, 1 << 16)
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.keys = [pa.table({"sourceFile": pa.array([], pa.string()), "chunk_index": pa.array([], pa.int32())})]
        self.rows = 0

    def add(self, scores: np.ndarray, fits: np.ndarray, first: int) -> None:
        """Scores of the slice that `follow` was told, for the queries from ``first`` on."""
        scores = np.where(fits & (scores > self.floor[first : first + scores.shape[1]]), scores, -np.inf)
        if len(scores) > self.k:
            kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            scores[scores < kth] = -np.inf
        row, query = np.nonzero(scores > -np.inf)
        if len(row):
            self.held.append((query + first, row + self.begin, scores[row, query]))
            self.size += len(row)
            if self.size > self.most:
                self.compact()

    def follow(self, keys: pa.Table) -> None:
        self.begin = self.rows
        self.keys.append(keys)
        self.rows += keys.num_rows

    def compact(self) -> None:
        query, row, score = (np.concatenate(c) for c in zip((self.query, self.row, self.score), *self.held, strict=True))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        query, row, score = query[keep], row[keep], score[keep]
        last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1)
        self.floor[query[last]] = score[last]
        # Keys of rows that are no one's best go; those that come get numbers from there on.
        used, row = np.unique(row, return_inverse=True)
        moved = self.rows - self.begin
        self.keys = [pa.concat_tables(self.keys).take(pa.array(used)), *([self.keys[-1]] if moved else [])]
        self.begin, self.rows = len(used), len(used) + moved
        self.query, self.row, self.score, self.held, self.size = query, row, score, [], 0

    def result(self, ids: pa.Array) -> pa.RecordBatch:
        self.compact()
        keys = pa.concat_tables(self.keys).take(pa.array(self.row)).combine_chunks()
        columns = [ids.take(pa.array(self.query)), *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in keys.columns), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(columns, schema=_HITS)


def _kernel(scorer: Scorer, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best, versions, score = None, [], None, None, None
        for batch in batches:
            tile, share, kind = (batch.column(c).to_numpy() for c in ("_tile", "_share", "_kind"))
            changes = (tile[1:] != tile[:-1]) | (share[1:] != share[:-1]) | (kind[1:] != kind[:-1])
            cuts = np.r_[0, np.flatnonzero(changes) + 1, len(tile)].tolist() if len(tile) else []
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if (tile[begin], share[begin]) != now:
                    if best is not None:
                        yield best.result(ids)
                    now, asked, best = (tile[begin], share[begin]), [], None
                part = batch.slice(begin, end - begin)
                if kind[begin] == 0:
                    asked.append(part.select(["query_id", "version", "asked"]))
                    continue
                if not asked:  # rows that no query looks at
                    continue
                if best is None:
                    queries = pa.Table.from_batches(asked).combine_chunks()
                    ids, want = (queries[c].chunk(0) for c in ("query_id", "asked"))
                    versions, score, best = Versions(queries["version"].to_pylist()), scorer(want), Best(len(ids), k)
                for at in range(0, part.num_rows, SLICE):
                    rows = part.slice(at, SLICE)
                    best.follow(pa.Table.from_batches([rows.select(_KEYS)]))
                    own, told = rows.column("version").to_pylist(), rows.column("told")
                    step = max(1, SCORES // rows.num_rows)
                    for first in range(0, len(ids), step):
                        last = min(first + step, len(ids))
                        scores = score(told, first, last)
                        best.add(scores, versions.fit(own, first, last) & (scores >= least), first)
        if best is not None:
            yield best.result(ids)

    return run


def best_by_tiles(queries: DataFrame, rows: DataFrame, scorer: Scorer, k: int, least: float) -> DataFrame:
    """(query_id, sourceFile, chunk_index, score): the best k of each share of ``rows`` for each query, of scores from ``least`` on.

    ``queries(query_id, version, asked)`` and ``rows(sourceFile, chunk_index, version, told)``; what is asked and told is for the scorer.
    """
    spark = queries.sparkSession
    n, longest = queries.agg(F.count(F.lit(1)), F.max(F.size("asked"))).first()
    tiles = max(1, -(-n // min(QUERY_TILE, max(1024, TILE_BYTES // (8 * max(longest or 0, 1))))))
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked, told = queries.schema["asked"].dataType, rows.schema["told"].dataType
    tile = F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int")
    null = lambda kind: F.lit(None).cast(kind)
    left = queries.select(
        tile.alias("_tile"), numbers(shares).alias("_share"), F.lit(0).alias("_kind"), F.col("query_id").cast("long").alias("query_id"), "version", "asked",
        null("string").alias("sourceFile"), null("int").alias("chunk_index"), null(told).alias("told"),
    )
    right = rows.select(
        numbers(tiles).alias("_tile"), F.pmod(F.xxhash64("sourceFile", "chunk_index"), F.lit(shares)).cast("int").alias("_share"), F.lit(1).alias("_kind"),
        null("long").alias("query_id"), "version", null(asked).alias("asked"), "sourceFile", F.col("chunk_index").cast("int").alias("chunk_index"), "told",
    )
    dealt = left.unionByName(right).repartition("_tile", "_share").sortWithinPartitions("_tile", "_share", "_kind", *_KEYS)
    return dealt.mapInArrow(_kernel(scorer, k, least), HITS)


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their size: where they are, and a matrix; null ones are left out, and null entries are not numbers."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = at, (flat if len(at) == len(sizes) else flat[(ends[at] - d)[:, None] + np.arange(d)]).reshape(-1, d)
    return out


def dot_scorer(asked: pa.Array) -> Callable[[pa.Array, int, int], np.ndarray]:
    """Dot products; vectors of other sizes have no score."""
    queries, n = _vectors(asked), len(asked)

    def score(told: pa.Array, first: int, last: int) -> np.ndarray:
        out = np.full((len(told), last - first), np.nan)
        for d, (at, matrix) in _vectors(told).items():
            if d in queries:
                where, vectors = queries[d]
                a, b = np.searchsorted(where, (first, last))
                if len(at) == len(told) and len(where) == n:
                    return matrix @ vectors[a:b].T
                out[np.ix_(at, where[a:b] - first)] = matrix @ vectors[a:b].T
        return out

    return score


def count_scorer(asked: pa.Array) -> Callable[[pa.Array, int, int], np.ndarray]:
    """How many of a query's terms, which may be repeated, are among a row's terms, which are distinct."""
    owner = np.repeat(np.arange(len(asked)), pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False))
    terms = asked.flatten().to_numpy()
    order = np.lexsort((owner, terms))
    terms, owner = terms[order], owner[order]

    def score(told: pa.Array, first: int, last: int) -> np.ndarray:
        width = last - first
        sizes = pc.fill_null(pc.list_value_length(told), 0).to_numpy(zero_copy_only=False)
        own, row = told.flatten().to_numpy(), np.repeat(np.arange(len(told)), sizes)
        begin, end = np.searchsorted(terms, own), np.searchsorted(terms, own, "right")
        n = end - begin
        place = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        query, of = owner[place], np.repeat(row, n)
        inside = (query >= first) & (query < last)
        flat = np.bincount(of[inside] * width + query[inside] - first, minlength=len(told) * width)
        return flat.reshape(len(told), width).astype(np.float64)

    return score
