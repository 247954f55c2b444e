"""Checks of a finished deposit: files against their manifests, label tables, stored residues, and what was stored against its source.

Every function takes the tables it judges, so that the same checks run on what
the library makes and on what was read; each is an aggregate row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_grid
from .checks import count_check, measured, suite
from .iterate import cut

#: Half a step of the half-precision grid at the largest distance that is kept.
HALF_STEP = 0.01
XYZ = ("x", "y", "z")


def _zero(name: str, rows: DataFrame) -> DataFrame:
    return measured(name, rows.agg(F.count("*").alias("observed")), F.col("observed") == 0)


def file_checks(manifest: DataFrame, files: DataFrame, declared: DataFrame, inventory: DataFrame, counted: DataFrame) -> DataFrame:
    """Files against what was written about them.

    manifest: path, sha256; files: path, length, sha256, as they are; declared:
    path, sha256, another declaration; inventory: path, rows, bytes; counted:
    path, rows, of the files that hold rows.  A path that one side lacks is a
    failure, also where nothing is listed at all.
    """
    both = manifest.select("path", F.col("sha256").alias("listed")).join(files.select("path", "sha256", "length"), "path", "full")
    verified = both.filter("listed IS NOT NULL").agg(F.count_if(~F.col("listed").eqNullSafe(F.col("sha256"))).alias("observed"), F.count("*").alias("n"))
    shared = declared.select("path", F.col("sha256").alias("d")).join(manifest.select("path", "sha256"), "path")
    rows = counted.join(inventory.select("path", F.col("rows").alias("r"), "bytes"), "path", "left").join(files.select("path", "length"), "path", "left")
    wrong = ~(F.col("rows").eqNullSafe(F.col("r")) & F.col("length").eqNullSafe(F.col("bytes")))
    return suite([
        measured("q06_manifest_verifies", verified, (F.col("observed") == 0) & (F.col("n") > 0)),
        _zero("q07_manifest_complete", both.filter("listed IS NULL OR sha256 IS NULL")),
        measured("q08_declared_hashes", shared.agg(F.count_if(~F.col("d").eqNullSafe(F.col("sha256"))).alias("observed")), F.col("observed") == 0),
        _zero("q09_data_declared", counted.select("path").join(declared.select("path"), "path", "left_anti")),
        measured("q10_inventory", rows.agg(F.count_if(wrong).alias("observed")), F.col("observed") == 0),
    ])


def footer_checks(files: DataFrame) -> DataFrame:
    """Footers of Parquet files (sources.structures.footers): one codec, and no trace of a local path among the keys."""
    return suite([
        measured("q04_one_codec", files.agg(F.count_distinct("codec").alias("observed")), F.col("observed") == 1),
        measured("q11_no_paths_in_footers", files.agg(F.count_if(F.col("keys").rlike("/(workspace|home/[a-z]+|mnt|tmp|root)/")).alias("observed")), F.col("observed") == 0),
    ])


def label_checks(labels: DataFrame, meta: DataFrame, most: float = 500.0) -> DataFrame:
    """A stored contact table (system, d_ca, d_min, contact_4, contact_5, contact_8) and its systems (system, has_contacts), as they were read."""
    d = F.col("d_min")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > most)
    flag = lambda t: ~F.col(f"contact_{t}").eqNullSafe(d <= t)
    grid = lambda c: ~F.col(c).cast("double").eqNullSafe(half_grid(F.col(c).cast("double")))
    mine = labels.filter("contact_4").select("system").distinct().withColumn("_seen", F.lit(True))
    has = meta.join(mine, "system", "left")
    return suite([
        count_check("q18_least_at_most_anchor", labels, ~F.coalesce(d <= F.col("d_ca") + HALF_STEP, F.lit(False))),
        count_check("q19_distance_domain", labels, bad("d_min") | bad("d_ca")),
        count_check("q20_flags_match", labels, flag(4) | flag(5) | flag(8)),
        count_check("q21_flags_nested", labels, F.expr("contact_4 AND NOT contact_5 OR contact_5 AND NOT contact_8")),
        count_check("q22_half_grid", labels, grid("d_min") | grid("d_ca")),
        count_check("q23_has_contacts", has, ~F.col("has_contacts").eqNullSafe(F.coalesce("_seen", F.lit(False)))),
        _zero("q12_systems_known", labels.select("system").distinct().join(meta.select("system"), "system", "left_anti")),
    ])


def store_checks(store: DataFrame, alphabet: list[str], constants: list[str]) -> DataFrame:
    """Stored systems, ragged: system, res_types, ca, sc, pep (arrays of x, y, z), sc_valid, shell (the same), shell_index, and columns that are one constant."""
    n = F.size("ca")
    same = (F.size("sc") == n) & (F.size("pep") == n) & (F.size("res_types") == n) & (F.size("sc_valid") == n)
    odd = lambda c: F.exists(c, lambda p: p.isNull() | reduce(lambda a, b: a | b, [F.coalesce(F.isnan(p[v]), F.lit(True)) for v in XYZ]))
    out = F.exists("shell_index", lambda i: i.isNull() | (i < 0) | (i >= n))
    checks = [
        measured("q30_contents", store.agg(F.count("*").alias("observed"), F.count_if(n > 0).alias("n")), (F.col("observed") > 0) & (F.col("n") == F.col("observed"))),
        count_check("q32_arrays_aligned", store, ~F.coalesce(same, F.lit(False))),
        count_check("q33_no_side_chain_is_glycine", store, F.exists(F.arrays_zip("sc_valid", "res_types"), lambda r: ~F.coalesce(r["sc_valid"], F.lit(False)) & (r["res_types"] != "GLY"))),
        count_check("q35_residue_alphabet", store, F.size(F.array_except("res_types", F.array(*map(F.lit, alphabet)))) > 0),
        count_check("q36_bead_shapes", store, odd("ca") | odd("sc") | odd("pep") | odd("shell")),
        count_check("q37_shell_indexed", store, (F.size("shell") != F.size("shell_index")) | out),
    ]
    return suite([*checks, *[measured(f"q39_one_{c}", store.agg(F.count_distinct(c).alias("observed"), F.count_if(F.col(c).isNull()).alias("none")), (F.col("observed") == 1) & (F.col("none") == 0)) for c in constants]])


def _gap(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}.{v}") - F.col(f"{b}.{v}")) ** 2 for v in "yz"), (F.col(f"{a}.x") - F.col(f"{b}.x")) ** 2))


def source_checks(stored: DataFrame, source: DataFrame, counts: DataFrame, tolerance: float = 0.02, names: tuple[str, ...] = ("51", "52", "53", "54", "55", "57")) -> DataFrame:
    """Stored residues against those read again from the source structure.

    stored and source: system, res_row, residue, ca, sc, pep (x, y, z) and
    sc_valid; counts: system, n_res, a third account of how many there are.
    Residues that one side lacks fail the first check.
    """
    a = stored.select("system", "res_row", *[F.col(c).alias(f"a_{c}") for c in ("residue", "ca", "sc", "pep", "sc_valid")])
    b = source.select("system", "res_row", *[F.col(c).alias(f"b_{c}") for c in ("residue", "ca", "sc", "pep", "sc_valid")])
    both = a.join(b, ["system", "res_row"], "full")
    there = F.col("a_residue").isNotNull() & F.col("b_residue").isNotNull()
    checks = [count_check(f"q{names[0]}_residues_against_source", both, ~F.col("a_residue").eqNullSafe(F.col("b_residue")))]
    for q, c, what in zip(names[1:4], ("ca", "sc", "pep"), ("ca", "side_centroid", "peptide_carbon"), strict=True):
        far = both.filter(there).agg(F.max(_gap(f"a_{c}", f"b_{c}")).alias("observed"), F.count_if(F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()).alias("n"))
        checks.append(measured(f"q{q}_{what}_against_source", far, (F.coalesce("observed", F.lit(0.0)) <= tolerance) & (F.col("n") == 0)))
    checks.append(count_check(f"q{names[4]}_invalid_explained", both.filter(there), ~F.col("a_sc_valid") & F.col("b_sc_valid")))
    own = stored.groupBy("system").agg(F.count("*").alias("n")).join(counts, "system", "full")
    checks.append(count_check(f"q{names[5]}_residue_count", own, ~F.col("n").eqNullSafe(F.col("n_res").cast("long"))))
    return suite(checks)


def unordered_comparison(stored: DataFrame, again: DataFrame, by: list[str], value: str | None = None, tolerance: float = 0.021, limit: float | None = None, margin: float = 0.05) -> DataFrame:
    """For each group, how two sets of points (by, x, y, z) agree whatever their order: n_stored, n_again, lost, added, worst.

    A member is matched if the other side has one within the tolerance; lost
    are those of stored without a match, added those of again.  With a limit,
    members whose ``value`` is above limit - margin may be in one table alone:
    they count neither way.  Points meet in cells of the tolerance along x, so
    a group isn't compared all with all.
    """
    keep = [*by, *XYZ, *([value] if value else [])]
    side = lambda df, i: df.select(*keep).withColumn("_i", F.monotonically_increasing_id()).withColumn("_c", F.floor(F.col("x") / tolerance)).select(*by, *[F.col(c).alias(f"{c}{i}") for c in (*XYZ, "_i", "_c", *([value] if value else []))])
    a, b = cut(side(stored, 1)), cut(side(again, 2))
    near = a.withColumn("_c2", F.explode(F.array(F.col("_c1") - 1, F.col("_c1"), F.col("_c1") + 1))).join(b, [*by, "_c2"])
    d = F.sqrt(sum(((F.col(f"{v}1") - F.col(f"{v}2")) ** 2 for v in "yz"), (F.col("x1") - F.col("x2")) ** 2))
    pairs = cut(near.withColumn("d", d).filter(F.col("d") <= tolerance).select(*by, "_i1", "_i2", "d"))
    counted = lambda df, i: df.filter(F.col(f"{value}{i}") <= limit - margin) if value and limit is not None else df
    out = None
    for df, i, size, name in ((a, 1, "n_stored", "lost"), (b, 2, "n_again", "added")):
        best = pairs.groupBy(f"_i{i}").agg(F.min("d").alias("d"))
        one = counted(df, i).join(best, f"_i{i}", "left").groupBy(*by).agg(F.count("*").alias(size), F.count_if(F.col("d").isNull()).alias(name), F.max("d").alias(f"worst{i}"))
        out = one if out is None else out.join(one, by, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*by, *map(zero, ("n_stored", "n_again", "lost", "added")), F.greatest("worst1", "worst2").alias("worst"))
