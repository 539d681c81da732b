"""Embedding whitening by polarisation: variances of sums give covariances.

Vectors become whole numbers x, so that all sums are exact. One pass counts the rows and adds up every dimension. The next
squares the centred values of every dimension and of the sum of every pair of dimensions and adds up the squares; half
of what the variance of a sum has above those of its two dimensions is their covariance. The matrix, exact up to its last division,
goes to the driver, which finds its eigenvectors: it has the square of the number of dimensions, however many rows there are.
Rows are then projected where they are, and the covariance of what comes out is measured in a pass of its own.

A task holds one slice of rows and one table of pairs. What is shuffled is a row for each pair and task. Values are centred by
the whole part of their mean; the rest of the mean is taken off exactly when the sums are put together.

Defined results for odd input: rows whose vector is null, empty, or holds null, NaN or infinite entries are dropped; of vectors of
several sizes those of the most frequent size (the largest of equally frequent ones) remain; rows are independent, so repeated
rows and equal or null ids stay; numbers beyond a long become the nearest long; ``deviation`` is null where it is beyond a long;
components whose eigenvalue is 0 within rounding are left out, so a table of equal vectors gives no rows, as does an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_COMPONENTS = 32
#: What an entry is multiplied with before it is rounded down, and what is added.
SCALE, SHIFT = 64, 1_000_000
#: Rows that are squared at once; values below SMALL can be squared and added up in a slice without overflow.
SLICE, SMALL = 1 << 13, 1 << 23
#: Sums travel as longs of so many bits, which can themselves be added up.
LIMB, LIMBS = 40, 5
_SUMS = "a int, b int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def _finite(batch: pa.RecordBatch, vector: str, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of ``dims`` finite entries (of one entry or more where that is None), and these vectors end to end."""
    column = batch.column(batch.schema.get_field_index(vector))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fine = (sizes > 0) if dims is None else sizes == dims
    fine = fine & (np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) == 0)
    return fine, flat[fine[owner]]


def _whole(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as longs."""
    x = np.floor(SCALE * entries)
    inside = np.abs(x) < 2.0**62
    return np.where(inside, np.where(inside, x, 0).astype(np.int64) + SHIFT, np.where(x > 0, np.int64(2**63 - 1), np.int64(-(2**63))))


def _limbs(n: int) -> list[int]:
    """A whole number as LIMBS longs of LIMB bits; the last has the sign."""
    out = [(n >> LIMB * k) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*out, n >> LIMB * (LIMBS - 1)]


def _sums(rows: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    columns = list(zip(*[(a, b, *_limbs(n)) for a, b, n in rows], strict=True)) if rows else [[]] * (2 + LIMBS)
    kinds = [pa.int32()] * 2 + [pa.int64()] * LIMBS
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", *[f"l{k}" for k in range(LIMBS)]])


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Totals by (a, b): as many as there are pairs of dimensions."""
    totals = parts.groupBy("a", "b").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    return {(r[0], r[1]): sum(r[2 + k] << LIMB * k for k in range(LIMBS)) for r in totals}


def _exact_total(values: np.ndarray) -> int:
    return int(values.sum()) if len(values) and int(np.abs(values // 2).max()) < 2**62 // len(values) else sum(values.tolist())


@dataclass
class Whitening:
    """A fitted model; ``axes`` has a component a column, already divided by the roots of ``eigenvalues``."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    axes: np.ndarray

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part of the mean, and what is left of the sum: n * x - sum is n * (x - whole) - rest."""
        return (np.array([f(s, self.n) for s in self.sums], np.int64) for f in (lambda a, b: a // b, lambda a, b: a % b))


def _shifted(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """x - whole, in Python's whole numbers where a long might not do."""
    return x - whole if not len(x) or (np.abs(x // 2).max() < 2**61 and np.abs(whole // 2).max() < 2**61) else x.astype(object) - whole.astype(object)


def _square_sums(whole: np.ndarray, vector: str):
    """For Arrow batches: sums of the squares of each dimension (a, a), and of each pair's sum (a, b), of centred values."""
    dims = len(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            _, flat = _finite(batch, vector, dims)
            x = _whole(flat).reshape(-1, dims)
            for at in range(0, len(x), SLICE):
                y = _shifted(x[at : at + SLICE], whole)
                if y.dtype != object and np.abs(y).max(initial=0) >= SMALL:
                    y = y.astype(object)
                for a in range(dims):
                    pairs = y[:, a + 1 :] + y[:, a : a + 1]
                    total[a, a] += int((y[:, a] * y[:, a]).sum())
                    total[a, a + 1 :] += (pairs * pairs).sum(axis=0).astype(object)
        yield from _sums([(a, b, int(total[a, b])) for a in range(dims) for b in range(a, dims)])

    return run


def fit_whitening(rows: DataFrame, vector: str = "embedding", most: int = MOST_COMPONENTS) -> Whitening | None:
    """The model of all rows, or None where no vector remains."""
    only = rows.select(vector)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            fine, flat = _finite(batch, vector)
            sizes = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)[fine].astype(np.int64)
            ends = np.cumsum(sizes)
            for d in np.unique(sizes).tolist():
                own = np.concatenate([np.arange(e - d, e) for e in ends[sizes == d]]) if len(set(sizes.tolist())) > 1 else slice(None)
                x = _whole(flat[own]).reshape(-1, d)
                for key, n in [((d, -1), len(x)), *(((d, a), _exact_total(x[:, a])) for a in range(d))]:
                    total[key] = total.get(key, 0) + n
        yield from _sums([(a, b, n) for (a, b), n in total.items()])

    found = _added(only.mapInArrow(counted, _SUMS))
    if not found:
        return None
    n, dims = max((n, d) for (d, a), n in found.items() if a == -1)
    sums = [found[dims, a] for a in range(dims)]
    model = Whitening(n, sums, np.zeros(0), 0.0, np.zeros((dims, 0)))
    whole, rest = model.centre()
    squares = _added(only.mapInArrow(_square_sums(whole, vector), _SUMS))
    # The sum of (n y - r)^2, with r the sum of y, is n (n * sum of y^2 - r^2).
    spread = lambda a, b: n * squares[min(a, b), max(a, b)] - (int(rest[a]) + (int(rest[b]) if a != b else 0)) ** 2
    cov = np.zeros((dims, dims))
    for a in range(dims):
        for b in range(a, dims):
            exact = spread(a, a) if a == b else Fraction(spread(a, b) - spread(a, a) - spread(b, b), 2)
            cov[a, b] = cov[b, a] = float(Fraction(exact, n * n))
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    real = (values > max(values[0], 0) * dims * np.finfo(float).eps * 8)[:most]
    values, axes = values[:most][real], axes[:, :most][:, real]
    return Whitening(n, sums, values, float(np.trace(cov)), axes / np.sqrt(values))


def _projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Centred values, as doubles, and their whitened components."""
    whole, rest = model.centre()
    centred = _shifted(x, whole).astype(np.float64) - rest / model.n
    return centred, centred @ model.axes


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, flat = _finite(batch, vector, len(model.sums))
            _, w = _projected(_whole(flat).reshape(-1, len(model.sums)), model)
            total += w.sum(axis=0)
            products += w.T @ w
        a, b = np.triu_indices(k)
        columns = [np.r_[a, np.arange(k)], np.r_[b, np.full(k, -1)], np.r_[products[a, b], total]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["a", "b", "v"])

    parts = rows.select(vector).mapInArrow(run, "a int, b int, v double")
    found = {(r.a, r.b): r.v / model.n for r in parts.groupBy("a", "b").agg(F.sum("v").alias("v")).collect()}
    return max(abs(found[a, b] - found[a, -1] * found[b, -1] - (a == b)) for a in range(k) for b in range(a, k))


def _deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sums of (n * x - sum)^2 a row. Longs wrap around, so what is below 2^63 comes out right; what is near or above is added up anew."""
    whole, rest = model.centre()
    y = _shifted(x, whole)
    about = ((model.n * y.astype(np.float64) - rest) ** 2).sum(axis=1)
    if y.dtype != object and model.n < 2**62:
        with np.errstate(over="ignore"):
            exact = ((y * np.int64(model.n) - rest) ** 2).sum(axis=1)
        sure = about < 2.0**62
    else:
        exact, sure = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    out: list = exact.tolist()
    for i in np.flatnonzero(~sure).tolist():
        d = sum((model.n * (int(v) - int(w)) - int(r)) ** 2 for v, w, r in zip(x[i], whole, rest, strict=True)) if about[i] < 2.0**64 else 2**63
        out[i] = d if d < 2**63 else None
    return pa.array(out, pa.int64())


def whitened(rows: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened): for each row that remains, its squared distance from the mean and its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                fine, flat = _finite(part, vector, len(model.sums))
                x = _whole(flat).reshape(-1, len(model.sums))
                _, w = _projected(x, model)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(fine)), _deviations(x, model), lists], [key, "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    columns = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    model = fit_whitening(rows)
    if model is None or not len(model.eigenvalues):
        kinds = ("long", "int", "long", "long", "double", "double", "double")
        return spark.range(0).select(*[F.lit(None).cast(k).alias(c) for c, k in zip(columns, kinds, strict=True)])
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    error = identity_error(rows, model)
    each = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
