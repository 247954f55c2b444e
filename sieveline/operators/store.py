"""Coordinate tables: what a system's poses and residues hold, whole steps, and the choice among equivalent atom orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import quantise

_XYZ = ("x", "y", "z")


def centroids(atoms: DataFrame, by: list[str]) -> DataFrame:
    return atoms.groupBy(*by).agg(*[F.avg(v).alias(f"c{v}") for v in _XYZ])


def stored(atoms: DataFrame, by: list[str], scale: float = 100.0) -> DataFrame:
    """atoms with qx, qy, qz: whole steps from the system's centroid; and cx, cy, cz, that centroid in single precision, as it is kept."""
    c = centroids(atoms, by).select(*by, *[F.col(f"c{v}").cast("float").alias(f"c{v}") for v in _XYZ])
    return atoms.join(c, by).withColumns({f"q{v}": quantise(F.col(v), F.col(f"c{v}").cast("double"), scale) for v in _XYZ})


def restored(rows: DataFrame, scale: float = 100.0) -> DataFrame:
    return rows.withColumns({v: F.col(f"q{v}") / scale + F.col(f"c{v}").cast("double") for v in _XYZ})


def side_centroids(atoms: DataFrame, by: list[str], side: str) -> DataFrame:
    """(by, sx, sy, sz, valid): the mean of the atoms that ``side`` marks, or of all where it marks none."""
    mean = lambda v: F.coalesce(F.avg(F.when(F.col(side), F.col(v))), F.avg(v)).alias(f"s{v}")
    return atoms.groupBy(*by).agg(*[mean(v) for v in _XYZ], (F.count_if(F.col(side)) > 0).alias("valid"))


def best_order(candidates: DataFrame, anchor: DataFrame, by: list[str]) -> DataFrame:
    """(by, candidate, score): of each group's candidate orders the one that, both centred, is nearest to the anchor; the first of equals.

    candidates: by, candidate, atom, x, y, z; anchor: by, atom, x, y, z.  The
    mean squared distance after centring is that of the atoms' differences
    less their mean, so it takes one join and one aggregation.
    """
    a = anchor.select(*by, "atom", *[F.col(v).alias(f"a{v}") for v in _XYZ])
    d = [F.col(v) - F.col(f"a{v}") for v in _XYZ]
    per = candidates.join(a, [*by, "atom"]).groupBy(*by, "candidate").agg(F.round(sum((F.avg(x * x) - F.avg(x) * F.avg(x) for x in d[1:]), F.avg(d[0] * d[0]) - F.avg(d[0]) * F.avg(d[0])), 9).alias("score"))
    return per.groupBy(*by).agg(F.min_by("candidate", F.struct("score", "candidate")).alias("candidate"), F.min("score").alias("score"))


def presence_census(poses: DataFrame, arm: str, system: str, valid: str) -> tuple[DataFrame, DataFrame]:
    """(arm, systems, poses) of the poses that are valid, and (arms, systems): how many systems have how many arms, none included."""
    per = poses.groupBy(system, arm).agg(F.count_if(F.col(valid)).alias("n"))
    arms = per.groupBy(arm).agg(F.count_if(F.col("n") > 0).alias("systems"), F.sum("n").alias("poses"))
    counts = per.groupBy(system).agg(F.count_if(F.col("n") > 0).alias("arms")).groupBy("arms").agg(F.count("*").alias("systems"))
    return arms, counts


def best_pose(poses: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """The pose with the least score of each group; poses without a score (null or NaN) come last, in their order."""
    known = F.when(~F.isnan(score), F.col(score))
    first = F.struct(known.isNull().alias("a"), known.alias("b"), F.col(order).alias("c"))
    rest = [c for c in poses.columns if c not in by]
    return poses.groupBy(*by).agg(F.min_by(F.struct(*rest), first).alias("_r")).select(*by, "_r.*")
