"""What goes into a run: receptors without water and without the ligand, and alignments put together from paired and unpaired rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of water residues (fixed values).
WATER = "HOH DOD WAT H2O OH2".split()
#: Rows of an alignment that are paired at most, and in all.
MOST_PAIRED, MOST_ROWS = 8192, 16384


def receptors(atoms: DataFrame, codes: DataFrame, by: str = "system") -> DataFrame:
    """The atoms of a structure that a ligand is docked against: all of the first model but water and every copy of the ligand.

    atoms: by, model, residue and whatever else; codes: by, code.  Metals,
    cofactors and nucleic acids stay.  A structure without a code loses water alone.
    """
    first = atoms.groupBy(by).agg(F.min("model").alias("_first"))
    rows = atoms.join(first, by).filter((F.col("model") == F.col("_first")) & ~F.col("residue").isin(WATER)).drop("_first")
    own = codes.select(by, F.col("code").alias("residue")).distinct()
    return rows.join(own, [by, "residue"], "left_anti").select(*atoms.columns)


def hetero_residues(kept: DataFrame, standard: list[str], by: str = "system") -> DataFrame:
    """(by, n_hetero): residues of a receptor that are none of the standard ones; 0 counts too."""
    one = kept.select(by, "chain", "number", "residue").distinct()
    return one.groupBy(by).agg(F.count_if(~F.col("residue").isin(standard)).alias("n_hetero"))


def pdb_lines(atoms: DataFrame, standard: list[str], by: str = "system") -> DataFrame:
    """(by, value): fixed-column text of atoms (id, name, residue, chain, number, element, x, y, z), in their order, which pdb readers take."""
    name = F.when(F.length("element") >= 2, F.rpad("name", 4, " ")).when(F.length("name") >= 4, F.substring("name", 1, 4)).otherwise(F.rpad(F.concat(F.lit(" "), "name"), 4, " "))
    record = F.when(F.col("residue").isin(standard), "ATOM  ").otherwise("HETATM")
    xyz = [F.lpad(F.format_string("%.3f", F.col(v)), 8, " ") for v in "xyz"]
    line = F.concat(
        record, F.lpad((F.col("id") % 100_000).cast("string"), 5, " "), F.lit(" "), name, F.lit(" "), F.lpad("residue", 3, " "), F.lit(" "), F.substring("chain", 1, 1), F.lpad("number", 4, " "),
        F.lit("    "), *xyz, F.lit("  1.00  0.00          "), F.lpad("element", 2, " "),
    )
    return atoms.select(by, F.struct("id", line.alias("line")).alias("l")).groupBy(by).agg(F.array_sort(F.collect_list("l")).alias("ls")).select(by, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("value"))


def _rows(text: Column) -> Column:
    """The sequences of a text of names and sequences, line by line in turn."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), "\r\n|\n|\r")
    return F.filter(lines, lambda _, i: i % 2 == 1)


def alignments(paired: DataFrame, unpaired: DataFrame, by: tuple[str, ...] = ("target", "chain"), most_paired: int = MOST_PAIRED, most: int = MOST_ROWS) -> DataFrame:
    """(by, row, key, sequence): each chain's alignment, its paired rows first, then the others.

    Both: by, text.  Of the first ``most_paired`` paired rows those that are
    gaps alone go; a row's key is its place among them, so rows of several
    chains with one key belong together.  Unpaired rows fill up to ``most``
    and have key -1; their first row is the query again and goes if there are
    paired ones.
    """
    both = unpaired.select(*by, _rows(F.col("text")).alias("u")).join(paired.select(*by, _rows(F.col("text")).alias("p")), [*by], "left")
    numbered = F.transform(F.slice(F.coalesce("p", F.array().cast("array<string>")), 1, most_paired), lambda s, i: F.struct(i.cast("int").alias("key"), s.alias("sequence")))
    rows = both.withColumn("p", F.filter(numbered, lambda r: r["sequence"] != F.repeat(F.lit("-"), F.length(r["sequence"]))))
    room = F.greatest(F.lit(most) - F.size("p"), F.lit(0))
    skipped = F.when(F.size("p") > 0, 1).otherwise(0)
    rest = F.filter(F.col("u"), lambda _, i: (i < room) & (i >= skipped))
    rest = F.transform(rest, lambda s: F.struct(F.lit(-1).alias("key"), s.alias("sequence")))
    return rows.select(*by, F.posexplode(F.concat("p", rest)).alias("row", "r")).select(*by, "row", "r.key", "r.sequence")


def alignment_texts(rows: DataFrame, by: tuple[str, ...] = ("target", "chain")) -> DataFrame:
    """(by, depth, value): each alignment as a text of keys and sequences under a heading."""
    line = F.concat_ws(",", F.col("key").cast("string"), "sequence")
    per = rows.groupBy(*by).agg(F.count("*").alias("depth"), F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("ls"))
    return per.select(*by, "depth", F.concat(F.lit("key,sequence\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("value"))
