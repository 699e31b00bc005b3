"""Whitening of embeddings by a compensated covariance.

Each entry c of a vector becomes the whole number x = floor(scale * c) + shift. The fit is over the distinct x vectors: n of them with exact sums S.
Covariances are centred before multiplying and hold about twice the digits of a double (a high and a low part):

- The mean S / n is a high and a low part of the exact fraction. x minus its high part is exact in two parts (the two-sum of Knuth); the low part is taken off the second.
- Outer products go a block of rows at a time. Each centred column is cut error-free into two slices of few bits and a remainder (Rump's extraction by a
  power of two). Products of slices have no rounding at all, so their sums by matrix multiplication are exact; the small products with the remainder are rounded far below the
  low part. Block sums enter the task's high and low part by two-sums.
- Parts of tasks are merged by row of the matrix, in two levels, again by two-sums; what reaches the driver is one matrix.
- The eigenvectors of the matrix (its side is the dimension) come from LAPACK's symmetric solver `syevd`: reduction to tridiagonal form, then divide and conquer.

Rows whose vector is null, or holds a null, an infinity, a NaN, or a number whose x needs more than 52 bits, are dropped, as are empty vectors and vectors
whose length isn't the most frequent one (ties: the shorter). Components whose variance is not above 1e-12 of the largest can't be whitened and are left out; so one
distinct vector, or an empty table, gives no rows. Copies of a vector count once in the fit and get a row each. Extra columns don't matter. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
MOST, SLICE_BITS, ROWS, FLAT = float(1 << 52), 20, 4096, 1e-12


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): the vectors as whole numbers, without those that have none."""
    c = F.transform(vector_col, lambda v: v.cast("double") * scale)
    fine = F.coalesce(F.forall(c, lambda v: F.coalesce(F.abs(v) < MOST - shift, F.lit(False)) & ~F.coalesce(F.isnan(v), F.lit(True))), F.lit(False)) & (F.size(c) > 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, F.transform(c, lambda v: F.floor(v) + shift)).alias("x")).filter("x is not null")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.min(F.struct((-F.col("n")).alias("n"), "d")).alias("b")).first()["b"]
    return rows.filter(F.size("x") == (best["d"] if best else 0))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as its double and the exact rest."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two numbers of a high and a low part."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as a high and a low part."""
    s, e = two_sum(x, -mean[0])
    return two_sum(s, e - mean[1])


def _sliced(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a as a slice of SLICE_BITS bits a column and the exact rest."""
    most = np.abs(a).max(0)
    grid = np.exp2(np.where(most > 0, np.frexp(most)[1], 0) + (53 - SLICE_BITS))
    top = (a + grid) - grid
    return top, a - top


def products(c: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of outer products of at most ROWS centred rows."""
    a, rest = _sliced(c[0])
    b, rest = _sliced(rest)
    rest = rest + c[1]
    total = two_sum(a.T @ a, (m := a.T @ b) + m.T)
    small = (r := a.T @ rest) + r.T + b.T @ b + (q := b.T @ rest) + q.T + rest.T @ rest
    return add(total, (small, np.zeros_like(small)))


def _matrix(batch: pa.RecordBatch, d: int, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, d)


@dataclass
class Fit:
    """Vectors of the fit, sums by dimension, the mean in two parts, the covariance in two parts, eigenvalues and vectors of the components, falling."""

    n: int
    sums: list[int]
    mean: tuple[np.ndarray, np.ndarray]
    cov: tuple[np.ndarray, np.ndarray]
    values: np.ndarray
    vectors: np.ndarray
    error: float = 0.0

    @property
    def whitener(self) -> np.ndarray:
        """The matrix from centred vectors to whitened ones."""
        return self.vectors / np.sqrt(self.values)


def _sums(x: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sums by dimension."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for b in batches:
            m = _matrix(b, d)
            n += len(m)
            for k in range(0, len(m), 1024):  # 2**10 numbers below 2**53 stay below 2**63
                total = total + m[k : k + 1024].sum(0).astype(object)
        yield pa.RecordBatch.from_pydict({"at": np.arange(d + 1, dtype=np.int32), "s": [str(v) for v in [*total, n]]})

    rows = x.select("x").mapInArrow(of, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # d + 1 rows
    found = {r["at"]: int(r["s"]) for r in rows}
    return found.get(d, 0), [found.get(k, 0) for k in range(d)]


def merged(parts: DataFrame, width: int) -> DataFrame:
    """Sums of (at, part, hi, lo) by at, in two levels: arrays of numbers of a high and a low part."""

    def close(group: pd.DataFrame) -> pd.DataFrame:
        total = (np.zeros(width), np.zeros(width))
        for hi, lo in zip(group["hi"], group["lo"]):
            total = add(total, (np.asarray(hi), np.asarray(lo)))
        return pd.DataFrame({"at": group["at"].iloc[:1], "part": 0, "hi": [total[0]], "lo": [total[1]]})

    schema = "at int, part int, hi array<double>, lo array<double>"
    return parts.groupBy("at", (F.col("part") % 64).alias("part64")).applyInPandas(close, schema).groupBy("at").applyInPandas(close, schema)


def covariance(x: DataFrame, n: int, mean: tuple[np.ndarray, np.ndarray], project: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The covariance (divisor n) of the rows of x, or of their projections, in two parts."""
    d = len(mean[0])
    k = d if project is None else project.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros((k, k)), np.zeros((k, k)))
        for b in batches:
            m = _matrix(b, d)
            for r in range(0, len(m), ROWS):
                c = centred(m[r : r + ROWS].astype(float), mean)
                if project is not None:
                    c = ((c[0] @ project) + (c[1] @ project), np.zeros((len(c[0]), k)))
                total = add(total, products(c))
        part = np.full(k, TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_pydict({"at": np.arange(k, dtype=np.int32), "part": part, "hi": list(total[0]), "lo": list(total[1])})

    rows = merged(x.select("x").mapInArrow(of, "at int, part int, hi array<double>, lo array<double>"), k).collect()  # the matrix, a row a dimension
    hi, lo = np.zeros((k, k)), np.zeros((k, k))
    for r in rows:
        hi[r["at"]], lo[r["at"]] = r["hi"], r["lo"]
    q = hi / n
    # The remainder of hi / n, exact by fractions: the matrix is small.
    rest = [[float(Fraction(h) - Fraction(v) * n) for h, v in zip(hr, vr)] for hr, vr in zip(hi.tolist(), q.tolist())]
    return two_sum(q, (np.array(rest).reshape(k, k) + lo) / n)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit of rows (id, x), or None without any."""
    distinct = materialize(rows.select("x").dropDuplicates(), "distinct-vectors")
    first = distinct.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    n, sums = _sums(distinct, d)
    means = [Fraction(s, n) for s in sums]
    hi = np.array([float(m) for m in means])
    mean = (hi, np.array([float(m - Fraction(h)) for m, h in zip(means, hi.tolist())]))
    cov = covariance(distinct, n, mean)
    values, vectors = np.linalg.eigh(cov[0])
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    good = values > FLAT * max(float(values[0]), 0) if len(values) else np.zeros(0, bool)
    found = Fit(n, sums, mean, cov, values[good], vectors[:, good])
    if good.any():
        seen = covariance(distinct, n, mean, found.whitener)[0]
        found.error = float(np.abs(seen - np.eye(len(seen))).max())
    return found


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n x - S)^2 of each row; None beyond a long."""
    near = np.array([s // n for s in sums])
    rest = np.array([s - n * int(m) for s, m in zip(sums, near)], object)
    by = x - near  # n x - S = n (x - near) - rest, with 0 <= rest < n
    most = (int(np.abs(by).max(initial=0)) + 1) * n
    exact = by * n - rest.astype(np.int64) if most * most * x.shape[1] < 1 << 63 else by.astype(object) * n - rest
    return [v if v < 1 << 63 else None for v in (exact * exact).sum(1).tolist()]


def transform(rows: DataFrame, model: Fit | None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each row of rows and component."""
    kind = rows.schema["id"].dataType.simpleString()
    k = 0 if model is None else len(model.values)
    d = 0 if model is None else len(model.sums)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.whitener
        for b in batches:
            m = _matrix(b, d)
            c = centred(m.astype(float), model.mean)
            out = c[0] @ w + c[1] @ w
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviations(m, model.n, model.sums), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, (len(m) + 1) * k, k), pa.int32()), out.ravel())], ["id", "deviation", "w"])

    schema = f"id {kind}, deviation bigint, w array<double>"
    done = rows.select("id", "x").mapInArrow(of, schema) if k else rows.sparkSession.createDataFrame([], schema)
    shares = [] if not k else (model.values / np.trace(model.cov[0])).tolist()
    each = done.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, shares)) if shares else F.array(F.lit(0.0)), F.col("at") + 1)
    n, error = (0, 0.0) if model is None else (model.n, model.error)
    return each.select("id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """transform of the table by its own fit."""
    rows = materialize(whole(vectors, id_col, vector_col, scale, shift), "whole-vectors")
    return transform(rows, fit(rows, components)).withColumnRenamed("id", id_col)
