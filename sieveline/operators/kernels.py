"""Two-sample statistics with kernels that are no inner product: distributed blocks of the kernel matrix.

Rows of a sample are numbered and cut to blocks.  Each two blocks meet in one
task, which works out their part of the kernel and multiplies it with the
memberships of all permutations; sums of those, a few numbers for each
permutation, are all that is shuffled and added up.  No task holds more than
two blocks and their kernel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut
from .ranking import ranked
from .shift import _shuffled

#: Rows of a block.
BLOCK = 512


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0)


def tanimoto(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared over all marks of 0/1 vectors; 0 where both are empty."""
    shared = a @ b.T
    union = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def rbf(gamma: float):
    return lambda a, b: np.exp(-gamma * _squared(a, b))


def numbered(sample: DataFrame, label: str, vector: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, r, y, v, n, n1): rows numbered from 0 in the order of the key within their group, with its size and how many have label 1; a saved table."""
    rows = sample.select(*by, F.col(key).alias("_key"), F.col(label).cast("int").alias("y"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    rows = cut(ranked(rows, [*by, "_key"], "_r"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("n1"), F.min("_r").alias("_first"))
    rows = rows.join(sizes, [*by]) if by else rows.crossJoin(F.broadcast(sizes))  # one row
    return cut(rows.select(*by, (F.col("_r") - F.col("_first")).alias("r"), "y", "v", "n", F.col("n1").cast("long").alias("n1")))


def _pairs(rows: DataFrame, by: tuple[str, ...], block: int) -> DataFrame:
    """Each row once for every pair of blocks that its own is in: by, a, b, k (its block) and the row."""
    k = F.floor(F.col("r") / block)
    last = F.floor((F.col("n") - 1) / block)
    each = rows.withColumn("k", k).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.select(*by, F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b"), "k", "r", "y", "v", "n", "n1")


def _two(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    k, a, b = (table.column(c).to_numpy() for c in ("k", "a", "b"))
    return table.take(np.flatnonzero(k == a)), table.take(np.flatnonzero(k == b)), bool(a[0] != b[0])


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def kernel_null(rows: DataFrame, kernel, by: tuple[str, ...] = (), permutations: int = 200, block: int = BLOCK) -> DataFrame:
    """(by, n0, n1, mmd2, p): unbiased squared MMD between labels 1 and 0 with any kernel, and the p value of a permutation null.

    rows: numbered ones.  kernel: a function of two matrices of rows.  A
    permutation is a function of a row's number, so any engine and partitioning
    gives the same.  p counts the permutations at least as far apart, and the
    one seen.  Both labels need two rows, else mmd2 and p are null.
    """

    def members(t: pa.Table) -> np.ndarray:
        n, n1 = t.column("n")[0].as_py(), t.column("n1")[0].as_py()
        at = t.column("r").to_numpy()
        return np.stack([t.column("y").to_numpy() == 1] + [_shuffled(at, n, p) < n1 for p in range(1, permutations + 1)]).astype(float)

    def part(table: pa.Table) -> pa.Table:
        one, two, twice = _two(table)
        k = kernel(_matrix(one), _matrix(two))
        u, w = members(one), members(two)
        ku = k @ w.T  # rows of one x permutations
        inside = (u.T * ku).sum(axis=0) * (2 if twice else 1)
        touching = u @ k.sum(axis=1) + (w @ k.sum(axis=0) if twice else 0)
        diagonal = np.zeros(len(u)) if twice else u @ np.diag(k)
        every, trace = k.sum() * (2 if twice else 1), 0.0 if twice else float(np.trace(k))
        m = permutations + 1
        out = {c: [table.column(c)[0].as_py()] * m for c in (*by, "n", "n1")}
        sums = zip(("sxx", "sx", "dx", "s", "d"), (inside, touching, diagonal, np.full(m, every), np.full(m, trace)), strict=True)
        return pa.table([pa.array(out[c], table.schema.field(c).type) for c in (*by, "n", "n1")] + [pa.array(np.arange(m))] + [pa.array(x) for _, x in sums], [*by, "n", "n1", "p", "sxx", "sx", "dx", "s", "d"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*by, "n", "n1"))
    parts = _pairs(rows, by, block).groupBy(*by, "a", "b").applyInArrow(part, f"{kinds}, p long, sxx double, sx double, dx double, s double, d double")
    sums = parts.groupBy(*by, "n", "n1", "p").agg(*[F.sum(c).alias(c) for c in ("sxx", "sx", "dx", "s", "d")])
    n1, n0 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    sxy = F.col("sx") - F.col("sxx")
    syy = F.col("s") - 2 * sxy - F.col("sxx")
    value = (F.col("sxx") - F.col("dx")) / (n1 * (n1 - 1)) + (syy - (F.col("d") - F.col("dx"))) / (n0 * (n0 - 1)) - 2 * sxy / (n1 * n0)
    m = F.when((F.col("n1") > 1) & (F.col("n") - F.col("n1") > 1), value)
    seen = F.max(F.when(F.col("p") == 0, F.col("m"))).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))  # permutations, not rows
    tried = sums.withColumn("m", m).withColumn("mmd2", seen)
    return tried.groupBy(*by, (F.col("n") - F.col("n1")).alias("n0"), "n1", "mmd2").agg(F.when(F.col("mmd2").isNotNull(), F.count_if((F.col("p") > 0) & (F.col("m") >= F.col("mmd2") - 1e-12)) + 1).alias("_c")).select(*by, "n0", "n1", "mmd2", (F.col("_c") / (permutations + 1)).alias("p"))


def _counted(low: float | None, high: float | None, cells: int):
    """Two blocks to counts of their pairs' squared distances: below low (cell -1) and in cells from there to high; a cell with its least and largest."""

    def run(table: pa.Table) -> pa.Table:
        one, two, twice = _two(table)
        d = _squared(_matrix(one), _matrix(two))
        d = d.ravel() if twice else d[np.triu_indices(len(d), 1)]
        if low is None:
            cell = np.zeros(len(d), np.int64)
        else:
            inside = np.minimum((d - low) / (high - low) * cells, cells - 1)
            cell = np.where(d < low, -1, np.where(d > high, cells, inside)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        at, first, count = np.unique(cell[order], return_index=True, return_counts=True)
        bounds = [f.reduceat(d[order], first) if len(at) else d for f in (np.minimum, np.maximum)]
        return pa.table([pa.array(at), pa.array(count.astype(np.int64)), *map(pa.array, bounds)], ["cell", "c", "least", "most"])

    return run


def median_squared_distance(rows: DataFrame, block: int = BLOCK, cells: int = 4096, rounds: int = 200) -> float | None:
    """The median squared distance of all pairs of numbered rows, the lower one of an even number: found by counting, in rounds.

    Each round counts the distances in cells between two bounds and goes on in
    the cell that holds the median, from its least to its largest distance.
    Pairs are worked out anew each time, never kept; counts are shuffled.
    """
    n = rows.count()
    if n < 2:
        return None
    k = (n * (n - 1) // 2 - 1) // 2
    pairs = cut(_pairs(rows, (), block))
    low = high = None
    for _ in range(rounds):
        got = pairs.groupBy("a", "b").applyInArrow(_counted(low, high, cells), "cell long, c long, least double, most double")
        before = 0
        for r in got.groupBy("cell").agg(F.sum("c").alias("c"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("cell").collect():  # as many as cells
            if before + r["c"] > k:
                low, high = r["least"], r["most"]
                break
            before += r["c"]
        if low == high:
            return low
    raise RuntimeError(f"the median isn't found after {rounds} rounds")


def rbf_null(rows: DataFrame, by: tuple[str, ...] = (), permutations: int = 200) -> DataFrame:
    """kernel_null with a Gaussian kernel, of the median distance's width."""
    median = median_squared_distance(rows)
    return kernel_null(rows, rbf(1 / median if median else 1.0), by, permutations)
