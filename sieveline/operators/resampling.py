"""An exact clustered bootstrap: in each round, exactly as many keys are drawn as there are.

Counts of a round are multinomial.  They are dealt down a tree of ranges of
key numbers: the draws of a range are split between its halves by a binomial
number, and among the BLOCK keys of a leaf by a multinomial one.  Each number
comes from a generator named by the round and the range, so a task works out
the leaves it has rows of and no others, and any partitioning gives the same.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut
from .ranking import ranked

#: Keys of a leaf.
BLOCK = 1024


def _generator(seed: int, b: int, low: int, high: int, leaf: bool = False) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, b, low, high, leaf])))


@functools.lru_cache(1 << 16)
def _draws(n: int, seed: int, b: int, low: int, high: int, block: int) -> int:
    """How many of round b's n draws are of keys low .. high - 1, a range of the tree."""
    if (low, high) == (0, n):
        return n
    up, top = 0, n
    while True:
        middle = up + -(-(top - up) // (2 * block)) * block  # whole leaves on the left
        if (low, high) in ((up, middle), (middle, top)):
            every = _draws(n, seed, b, up, top, block)
            left = int(_generator(seed, b, up, top).binomial(every, (middle - up) / (top - up)))
            return left if low == up else every - left
        up, top = (up, middle) if high <= middle else (middle, top)


def leaf_counts(n: int, seed: int, b: int, leaf: int, block: int = BLOCK) -> np.ndarray:
    """How often round b draws each key of a leaf."""
    low, high = leaf * block, min(n, (leaf + 1) * block)
    return _generator(seed, b, low, high, True).multinomial(_draws(n, seed, b, low, high, block), np.full(high - low, 1 / (high - low)))


def _summed(n: int, rounds: int, seed: int, k: int, c: int, block: int):
    """Rows (by, values, number), to (by, b, sums) of their values times how often each round draws their key; k columns of by, c of values."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(k + c).to_numpy()
            values = np.stack([batch.column(k + i).to_numpy(zero_copy_only=False).astype(float) for i in range(c)], axis=1)
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True)) if k else [()] * len(at)
            codes: dict[tuple, int] = {}
            own = np.array([codes.setdefault(g, len(codes)) for g in groups])
            total = np.zeros((rounds, len(codes), c))
            for leaf in np.unique(at // block).tolist():
                w = kept.get(leaf)
                if w is None:
                    if len(kept) > 8:
                        kept.clear()
                    w = kept[leaf] = np.stack([leaf_counts(n, seed, b, leaf, block) for b in range(1, rounds + 1)])
                rows = np.flatnonzero(at // block == leaf)
                mine = w[:, at[rows] - leaf * block]
                for g in np.unique(own[rows]).tolist():
                    inside = own[rows] == g
                    total[:, g] += mine[:, inside] @ values[rows[inside]]
            first = np.array([np.flatnonzero(own == g)[0] for g in range(len(codes))])
            index = pa.array(np.repeat(first, rounds))
            cols = [batch.column(i).take(index) for i in range(k)]
            sums = total.transpose(1, 0, 2).reshape(-1, c)
            yield pa.record_batch([*cols, pa.array(np.tile(np.arange(1, rounds + 1), len(codes))), *(pa.array(sums[:, i]) for i in range(c))], [*batch.schema.names[:k], "b", *batch.schema.names[k : k + c]])

    return run


def resampled(df: DataFrame, key: str, values: list[str], by: tuple[str, ...] = (), rounds: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(by, b, values): the sums of values in each of the rounds, in which whole keys are drawn with replacement, as many as there are.

    Rows are summed by key and stratum first.  A stratum that a round draws no key of has a sum of 0.
    """
    per = df.groupBy(key, *by).agg(*[F.coalesce(F.sum(F.col(v).cast("double")), F.lit(0.0)).alias(v) for v in values])
    per = cut(per)
    numbers = cut(ranked(per.select(key).distinct(), [F.col(key)], "_number"))
    n = numbers.count()
    rows = per.join(numbers, key).select(*by, *values, (F.col("_number") - 1).alias("_number"))
    rows = rows.repartitionByRange("_number").sortWithinPartitions("_number")
    kinds = "".join(f"`{c}` {per.schema[c].dataType.simpleString()}, " for c in by)
    parts = rows.mapInArrow(_summed(n, rounds, seed, len(by), len(values), block), f"{kinds}b long, " + ", ".join(f"`{v}` double" for v in values))
    return parts.groupBy(*by, "b").agg(*[F.sum(v).alias(v) for v in values])


def clustered_ratio(df: DataFrame, key: str, num: str, den: str, by: tuple[str, ...] = (), rounds: int = 1000, seed: int = 0, coverage: float = 0.95) -> DataFrame:
    """(by, ratio, low, high): sum(num) / sum(den), with the percentile interval of the exact clustered bootstrap."""
    seen = df.groupBy(*by).agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0))).alias("ratio"))
    tried = resampled(df, key, [num, den], by, rounds, seed).withColumn("_r", F.col(num) / F.nullif(F.col(den), F.lit(0.0)))
    edge = (1 - coverage) / 2
    inside = tried.groupBy(*by).agg(F.percentile("_r", edge).alias("low"), F.percentile("_r", 1 - edge).alias("high"))  # rounds, not rows
    return seen.join(inside, [*by]) if by else seen.crossJoin(inside)  # single rows


def clustered_difference(df: DataFrame, key: str, num: str, den: str, by: str, one, two, rounds: int = 1000, seed: int = 0, coverage: float = 0.95) -> DataFrame:
    """(difference, ratio, low, high, excludes_zero): ratio of stratum one less that of stratum two, and by it, in the same rounds of the same keys."""
    of = lambda df, v: F.sum(F.when(F.col(by) == F.lit(v), F.col(num))) / F.nullif(F.sum(F.when(F.col(by) == F.lit(v), F.col(den))), F.lit(0))
    pick = df.filter(F.col(by).isin(one, two))
    seen = pick.agg((of(df, one) - of(df, two)).alias("difference"), (of(df, one) / F.nullif(of(df, two), F.lit(0))).alias("ratio"))
    tried = resampled(df.select(key, by, num, den), key, [num, den], (by,), rounds, seed).groupBy("b").agg((of(df, one) - of(df, two)).alias("_d"))
    edge = (1 - coverage) / 2
    inside = tried.agg(F.percentile("_d", edge).alias("low"), F.percentile("_d", 1 - edge).alias("high"))
    return seen.crossJoin(inside).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))  # single rows
