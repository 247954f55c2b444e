"""Embedding whitening: a randomised range finder, then Rayleigh-Ritz.

Vectors are put on an integer grid, so counts and sums are exact.  Every pass
goes over all centred rows: a task multiplies its rows, batch by batch, and
gives one small matrix; Spark adds those up entry by entry, and the driver gets
a matrix of at most dimension x dimension.  Its size depends on the dimension
alone, never on the rows.

1. A random basis of ``components + OVERSAMPLE`` directions is multiplied by
   the covariance and orthonormalised, ``POWERS`` times: the range finder.
2. Rayleigh-Ritz: the covariance within the basis is decomposed; Ritz vectors
   with small residuals are eigenvectors.  That none larger was missed is
   proved by the trace: what the basis leaves of it must be no more than the
   least eigenvalue that is kept.
3. If a residual fails, or the proof does, the basis is expanded to the full
   dimension, where Rayleigh-Ritz is the whole decomposition.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches, saved

#: Directions beyond those asked for, and passes of the range finder.
OVERSAMPLE, POWERS = 8, 4
#: Residuals up to so many units of rounding of the largest eigenvalue pass.
ROUNDING = 256
#: The grid: floor(STEPS * c) + ORIGIN.
STEPS, ORIGIN = 64, 1_000_000

_EDGE = float(1 << 62)


def _grid(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """The rows of a list column on the grid; entries a row lacks count as 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(size.max(initial=0)) if dim is None else dim
    c = np.zeros((n, dim))
    row = np.repeat(np.arange(n), size)
    c[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * STEPS), -_EDGE, _EDGE).astype(np.int64) + ORIGIN


def _moments(batches):
    """One row for each dimension: rows that have it, both halves of their sum, least and largest x."""
    n, high, low, least, most = 0, *(np.zeros(0, np.int64),) * 4
    for b in batches:
        x = _grid(b.column(0))
        if not len(x):
            continue
        d = x.shape[1]
        if d > len(high):
            high, low = (np.concatenate([s, np.full(d - len(s), n * t)]) for s, t in ((high, ORIGIN >> 32), (low, ORIGIN & 0xFFFFFFFF)))
            least, most = (np.concatenate([s, np.full(d - len(s), ORIGIN if n else t, np.int64)]) for s, t in ((least, 1 << 62), (most, -(1 << 62))))
        elif d < len(high):
            x = np.concatenate([x, np.full((len(x), len(high) - d), ORIGIN, np.int64)], axis=1)
        n += len(x)
        high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
    if n:
        yield pa.record_batch([pa.array(np.arange(-1, len(high))), pa.array(np.full(len(high) + 1, n)), *(pa.array(np.concatenate([[0], s])) for s in (high, low, least, most))], ["i", "n", "high", "low", "least", "most"])


class Centre:
    """n and S of the fit list, exact, and rows less their mean."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]) -> None:
        self.n, self.sums, self.dim = n, sums, len(sums)
        base = [round(s / n) if n else 0 for s in sums]
        # The mean is an integer, exactly, and a rest below 1.
        self.base = np.array(base, np.int64)
        self.rest = np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])
        reach = max((max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(least, most, sums, strict=True)), default=0)
        self.narrow = reach * reach * max(1, self.dim) < 1 << 63 and all(abs(n * v) < 1 << 62 for v in (*least, *most))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum of (n * x - S)^2 of each row, exact; what no long holds becomes the largest long."""
        if self.narrow:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1)
        top = (1 << 63) - 1
        return np.array([min(top, sum((self.n * v - s) ** 2 for v, s in zip(r, self.sums, strict=True))) for r in x.tolist()], np.int64)


def _centre(rows: DataFrame) -> Centre:
    parts = rows.select("v").mapInArrow(_moments, "i long, n long, high long, low long, least long, most long")
    # A task whose rows are all shorter lacks the last dimensions; there its rows stand at the origin.
    got = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")], F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    if not got:
        return Centre(0, [], [], [])
    n = got[0]["n"]
    lack = [n - r["n"] for r in got[1:]]
    sums = [(r["high"] << 32) + r["low"] + m * ORIGIN for r, m in zip(got[1:], lack, strict=True)]
    least = [min(r["least"], ORIGIN) if m else r["least"] for r, m in zip(got[1:], lack, strict=True)]
    return Centre(n, sums, least, [max(r["most"], ORIGIN) if m else r["most"] for r, m in zip(got[1:], lack, strict=True)])


def _summed(rows: DataFrame, centre: Centre, product, shape: tuple[int, int]) -> np.ndarray:
    """The sum of product(z) over all batches z of centred rows: added up in each task, then by Spark, entry by entry."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = product(centre.rows(_grid(b.column(0), centre.dim)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    got = rows.select("v").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in got:
        out[r["i"]] = r["v"]
    return out.reshape(shape)


@functools.lru_cache(8)
def _random(dim: int, n: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(13).standard_normal((dim, n)))[0]


def principal(rows: DataFrame, centre: Centre, k: int) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Eigenvalues, eigenvectors (columns) and trace of the covariance of rows (v), and whether the basis was expanded to all dimensions."""
    d, n = centre.dim, centre.n
    width = min(d, k + OVERSAMPLE)
    times = lambda q: _summed(rows, centre, lambda z: z.T @ (z @ q), (d, q.shape[1])) / n
    trace = float(_summed(rows, centre, lambda z: np.array([[(z * z).sum()]]), (1, 1))[0, 0]) / n
    if width < d:
        q = _random(d, width)
        for _ in range(POWERS):
            q = np.linalg.qr(times(q))[0]
        image = times(q)
        small = q.T @ image
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        ritz = q @ u
        residual = np.linalg.norm(image @ u - ritz * e, axis=0)[:k]
        unit = np.finfo(float).eps * max(float(e[0]), 0.0)
        if residual.max() <= ROUNDING * unit and trace - float(e.sum()) <= max(float(e[k - 1]), ROUNDING * unit):
            return np.maximum(e[:k], 0), ritz[:, :k], trace, False
    whole = times(np.eye(d))
    e, u = np.linalg.eigh((whole + whole.T) / 2)
    k = min(k, d)
    return np.maximum(e[::-1][:k], 0), u[:, ::-1][:, :k], trace, True


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """Whitened principal components of vectors: a row for each vector and component.

    Takes vec_id and embedding, whatever else there is; returns vec_id,
    component (from 1, by falling variance), n (vectors fitted), deviation (the
    sum of (n * x - S)^2 over the dimensions, x the vector on the grid and S
    the sums of all), whitened, explained (the component's share of the
    variance) and identity_error (the largest entry of whitened's covariance
    less the identity).

    Vectors that are null or hold a null or non-finite entry are dropped.
    Vectors shorter than the longest are filled up with zeros; empty ones too,
    and if all are empty there is no component and no row.  An entry beyond
    2^62 steps of the grid stands at that edge, and a deviation that no long
    holds is the largest long.  Repeated rows count and are returned each; a
    null vec_id stays null.  A component without variance can't be whitened:
    its values are 0, and identity_error leaves it out.
    """
    v = F.col("embedding").cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    table = saved(in_batches(vectors).filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")), "vectors")
    centre = _centre(table)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not centre.dim:
        return vectors.sparkSession.createDataFrame([], schema)
    e, u, trace, _ = principal(table, centre, min(components, centre.dim))
    k = len(e)
    real = e > np.finfo(float).eps * centre.dim * e[0] if e[0] > 0 else np.zeros(k, bool)
    scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1)), 0)
    share = e / trace if trace > 0 else np.zeros(k)
    w = u * scale

    # What whitening gives is measured on all rows, centred before it is multiplied.
    def spread(z):
        y = z @ w
        return np.concatenate([y.T @ y, y.sum(axis=0)[None]])

    sums = _summed(table, centre, spread, (k + 1, k))
    mean = sums[k] / centre.n
    cov = sums[:k] / centre.n - np.outer(mean, mean)  # the mean is rounding alone, so nothing cancels
    off = np.abs(cov - np.eye(k))[np.ix_(real, real)]
    error = float(off.max()) if off.size else 0.0

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _grid(part.column(1), centre.dim)
                m = len(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.record_batch([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)), pa.array(np.repeat(centre.deviation(x), k)),
                    pa.array((centre.rows(x) @ w).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.mapInArrow(run, schema)


