"""Contact tables: thresholded distances per (system, residue, ligand atom) and the sets that arms assert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_grid, squared_distance

XYZ = ("x", "y", "z")


def distance_join(residues: DataFrame, ligand: DataFrame, cutoff: float = 15.0) -> DataFrame:
    """Least distance of each (system, res_row, atom_idx) within the cutoff, and the distance to the residue's anchor.

    residues: system, res_row, is_anchor, x, y, z (a row for each heavy atom);
    ligand: system, atom_idx, x, y, z.  Atoms meet in square columns as wide as
    the cutoff, a ligand atom in its own and the eight around it, so no system
    is one key; then the theta condition.  d_anchor is null where a residue has
    no anchor atom.
    """
    bands = lambda df: df.withColumn("band", F.floor(F.col("x") / cutoff)).withColumn("lane", F.floor(F.col("y") / cutoff))
    left = bands(residues).select("system", "band", "lane", *[F.col(c).alias(f"r{c}") for c in XYZ], "res_row")
    steps = [F.struct((F.col("band") + i).alias("band"), (F.col("lane") + j).alias("lane")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    right = bands(ligand).select("system", "atom_idx", *XYZ, F.inline(F.array(*steps)))
    d = F.sqrt(squared_distance([F.col(f"r{c}") for c in XYZ], [F.col(c) for c in XYZ]))
    near = left.join(right, ["system", "band", "lane"]).filter(d <= cutoff)
    hits = near.groupBy("system", "res_row", "atom_idx").agg(F.min(d).alias("d_min"))
    return _with_anchors(hits, residues, ligand)


def _with_anchors(hits: DataFrame, residues: DataFrame, ligand: DataFrame) -> DataFrame:
    """The hits with the distance to the residue's anchor, wherever that lies."""
    d = F.sqrt(squared_distance([F.col(f"r{c}") for c in XYZ], [F.col(c) for c in XYZ]))
    anchors = residues.filter("is_anchor").select("system", "res_row", *[F.col(c).alias(f"r{c}") for c in XYZ])
    full = hits.join(anchors, ["system", "res_row"], "left").join(ligand.select("system", "atom_idx", *XYZ), ["system", "atom_idx"])
    return full.groupBy("system", "res_row", "atom_idx").agg(F.first("d_min").alias("d_min"), F.min(d).alias("d_anchor"))


def _cells_around(cutoff: float) -> Column:
    """The 27 cells as wide as the cutoff around a point, as structs cx, cy, cz."""
    cell = lambda c: F.floor(F.col(c) / cutoff)
    return F.array(*[F.struct(*[(cell(c) + d).alias(f"c{c}") for c, d in zip(XYZ, (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])


def distance_join_grid(residues: DataFrame, ligand: DataFrame, cutoff: float = 15.0) -> DataFrame:
    """The rows of distance_join by way of cells as wide as the cutoff: each ligand atom goes to the 27 cells around it.

    For systems with many atoms; anchors are joined afterwards, as an anchor may lie outside the neighbouring cells.
    """
    left = residues.select("system", "res_row", *[F.floor(F.col(c) / cutoff).alias(f"c{c}") for c in XYZ], *[F.col(c).alias(f"r{c}") for c in XYZ])
    right = ligand.select("system", "atom_idx", *XYZ, F.inline(_cells_around(cutoff)))
    d = F.sqrt(squared_distance([F.col(f"r{c}") for c in XYZ], [F.col(c) for c in XYZ]))
    near = left.join(right, ["system", *[f"c{c}" for c in XYZ]]).withColumn("d", d).filter(F.col("d") <= cutoff)
    hits = near.groupBy("system", "res_row", "atom_idx").agg(F.min("d").alias("d_min"))
    return _with_anchors(hits, residues, ligand)


def flags(contacts: DataFrame, thresholds: tuple[float, ...] = (4, 5, 8), column: str = "d_min") -> DataFrame:
    """Distances on the half grid, then a flag for each threshold: rounding comes first, as stored values decide."""
    out = contacts.withColumn(column, half_grid(F.col(column)))
    return out.withColumns({f"contact_{t:g}": F.col(column) <= t for t in thresholds})


def asserted(contacts: DataFrame, threshold: float) -> DataFrame:
    """Distinct (arm, system, res_row) with a distance within the threshold."""
    return contacts.filter(F.col("d_min") <= threshold).select("arm", "system", "res_row").distinct()


def support(sets: DataFrame, arms: list[str]) -> DataFrame:
    """How many of the arms assert each (system, res_row)."""
    return sets.filter(F.col("arm").isin(arms)).groupBy("system", "res_row").agg(F.count_distinct("arm").alias("n_arms_asserting"))


def support_gradient(sets: DataFrame, arms: list[str], truth: str) -> DataFrame:
    """Precision by level of support, each level's share of rows, and the recall of the union.

    Only systems that the truth and every arm assert something for.  One
    aggregation by (system, res_row), no outer joins.
    """
    cohort = sets.filter(F.col("arm").isin([*arms, truth])).groupBy("system").agg(F.count_distinct("arm").alias("n")).filter(F.col("n") == len(arms) + 1).select("system")
    rows = sets.join(cohort, "system", "left_semi").groupBy("system", "res_row").agg(
        F.count_distinct(F.when(F.col("arm").isin(arms), F.col("arm"))).alias("support"), F.max((F.col("arm") == truth).cast("int")).alias("is_true")
    )
    level = rows.groupBy("support").agg(F.count("*").alias("n_rows"), F.sum("is_true").alias("n_true")).filter("support > 0")
    totals = rows.agg(F.sum("is_true").alias("all_true"), F.sum(F.when(F.col("support") > 0, F.col("is_true")).otherwise(0)).alias("found"), F.count_if(F.col("support") > 0).alias("all_rows"))
    out = level.crossJoin(F.broadcast(totals))  # one row
    return out.select("support", "n_rows", (F.col("n_true") / F.col("n_rows")).alias("precision"), (F.col("n_rows") / F.col("all_rows")).alias("row_share"), (F.col("found") / F.col("all_true")).alias("union_recall"))


def pocket_extension(residues: DataFrame, pocket: DataFrame, centre: DataFrame, factor: float = 1.5) -> DataFrame:
    """Residues within factor times the pocket's radius of the ligand's centre.

    residues: system, res_row, x, y, z; pocket: system, res_row; centre: system, x, y, z.
    """
    c = centre.select("system", *[F.col(v).alias(f"c{v}") for v in XYZ])
    d = F.sqrt(squared_distance([F.col(v) for v in XYZ], [F.col(f"c{v}") for v in XYZ]))
    placed = residues.join(c, "system").select("system", "res_row", d.alias("d"))
    radius = placed.join(pocket, ["system", "res_row"], "left_semi").groupBy("system").agg(F.max("d").alias("radius"))
    return placed.join(radius, "system").filter(F.col("d") <= factor * F.col("radius")).select("system", "res_row", "d")


def shell_atoms(atoms: DataFrame, ligand: DataFrame, cutoff: float = 15.0) -> DataFrame:
    """Atoms (system, atom_id, x, y, z) whose least distance to the ligand is within the cutoff.

    Atoms meet the ligand's in cells as wide as the cutoff, so atoms far from it meet none.
    """
    left = atoms.select("system", "atom_id", *[F.floor(F.col(c) / cutoff).alias(f"c{c}") for c in XYZ], *[F.col(c).alias(f"r{c}") for c in XYZ])
    right = ligand.select("system", *XYZ, F.inline(_cells_around(cutoff)))
    d = F.sqrt(squared_distance([F.col(f"r{c}") for c in XYZ], [F.col(c) for c in XYZ]))
    near = left.join(right, ["system", *[f"c{c}" for c in XYZ]]).withColumn("d", d).filter(F.col("d") <= cutoff)
    return near.groupBy("system", "atom_id").agg(F.min("d").alias("d_min"))


def residue_minimum(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("arm", "system", "res_row").agg(F.min("d_min").alias("d_min"))


def packed(contacts: DataFrame) -> DataFrame:
    """One row for each (arm, system) with its contacts in order: the ragged form of a contact table."""
    return contacts.groupBy("arm", "system").agg(F.array_sort(F.collect_list(F.struct("res_row", "d_min"))).alias("contacts"))


def unpacked(shards: DataFrame) -> DataFrame:
    return shards.select("arm", "system", F.inline("contacts"))
