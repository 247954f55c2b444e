"""The operators on Parquet tables from a command line: python -m sieveline --help."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _fractions(text: str) -> tuple[float, float, float]:
    parts = tuple(float(x) for x in text.split(","))
    if len(parts) != 3 or abs(sum(parts) - 1) > 1e-9 or min(parts) < 0:
        raise argparse.ArgumentTypeError("three fractions that add up to 1, as in 0.8,0.1,0.1")
    return parts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveline", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)

    def add(name: str, text: str, *tables: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=text, description=text)
        for t in tables:
            s.add_argument(t)
        return s

    add("list", "names of the queries over the fixture tables")
    s = add("run", "run a query over a folder of tables", "query", "data")
    s.add_argument("--out", help="folder for the rows; twenty are shown without one")
    s = add("split", "a split of a context (system, pc, lc) by family: C1, C2p, C2l, C3 or C3comp", "family", "context", "out")
    s.add_argument("--seed", default="0")
    s.add_argument("--fractions", type=_fractions, default=(0.8, 0.1, 0.1))
    s = add("temporal", "a split of a dated table, at fixed dates or at quantiles", "table", "out")
    s.add_argument("--date", required=True)
    s.add_argument("--val-start")
    s.add_argument("--test-start")
    s.add_argument("--low", type=float, default=0.8)
    s.add_argument("--high", type=float, default=0.9)
    for name, text in (("pairs", "pairs of sets (id, feature) from a similarity on"), ("neighbours", "each set's nearest ones"), ("cluster", "leader clusters of sets")):
        s = add(name, text, "features", "out")
        s.add_argument("--floor", type=float, default=0.3)
        s.add_argument("--bits", type=int, default=2048)
        if name == "neighbours":
            s.add_argument("--top", type=int, default=256)
    add("components", "connected components of edges (a, b)", "edges", "out")
    s = add("permutation", "squared MMD with the p value of a permutation null", "table")
    for a, d in (("key", "id"), ("label", "label"), ("vector", "vector")):
        s.add_argument(f"--{a}", default=d)
    s.add_argument("--permutations", type=int, default=200)
    s = add("calibrate", "out-of-fold isotonic calibration and its skill", "table", "out")
    for a, d in (("x", "agreement"), ("y", "accuracy"), ("group", "system")):
        s.add_argument(f"--{a}", default=d)
    s.add_argument("--folds", type=int, default=5)
    s = add("sweep", "all splits of entities (system, protein, ligand) over clusterings of proteins and ligands; folds, audit and index go to the folder", "entities", "proteins", "ligands", "out")
    s.add_argument("--families", nargs="*", default=["C1", "C2p", "C2l", "C3", "C3comp"])
    s.add_argument("--protein-thresholds", nargs="*")
    s.add_argument("--ligand-variants", nargs="*")
    s.add_argument("--seeds", nargs="*", type=int, default=[0, 1, 2, 3, 4])
    s.add_argument("--fractions", type=_fractions, default=(0.8, 0.1, 0.1))
    add("validate", "problems of a sweep that was written; exits with 1 if there are any", "sweep")
    s = add("shift", "the shift row of every split of a sweep, from vectors (ligand, v) and pairs (i, j, sim) of ligands and proteins", "sweep", "vectors", "ligand_pairs", "protein_pairs", "out")
    s.add_argument("--n-sample", type=int, default=1500)
    s.add_argument("--n-perm", type=int, default=200)
    s = add("sequences", "greedy clusters of sequences (id, s) by identity", "sequences", "out")
    s.add_argument("--identity", type=float, default=0.5)
    add("manifest", "files of a folder against its sha256 manifest; exits with 1 if one fails", "folder", "manifest")
    s = sub.add_parser("dictionary", help="a Markdown dictionary of tables' fields")
    s.add_argument("tables", nargs="+")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    from .plans.registry import QUERIES

    if a.what == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = spark or SparkSession.builder.appName("sieveline").getOrCreate()
    read = spark.read.parquet

    def write(df: DataFrame, out: str) -> None:
        df.write.mode("overwrite").parquet(out)

    if a.what == "run":
        if a.query not in QUERIES:
            p.error(f"no query {a.query}; see sieveline list")
        df = QUERIES[a.query](spark, a.data)
        write(df, a.out) if a.out else df.show(truncate=False)
    elif a.what == "split":
        from .operators import splits

        assign = {"C1": splits.random_covered, "C2p": lambda c, s, f: splits.cold_axis(c, "pc", "lc", s, f), "C2l": lambda c, s, f: splits.cold_axis(c, "lc", "pc", s, f), "C3": splits.block, "C3comp": splits.component_block}
        if a.family not in assign:
            p.error(f"no family {a.family}")
        splits.write(assign[a.family](read(a.context), a.seed, a.fractions), a.family, a.out)
    elif a.what == "temporal":
        from .operators.splits import temporal

        write(temporal(read(a.table), a.date, a.val_start, a.test_start, a.low, a.high), a.out)
    elif a.what in ("pairs", "neighbours", "cluster"):
        from .operators import iterate, similarity

        features = read(a.features)
        pairs = similarity.pairs_above(features, a.floor, a.bits)
        if a.what == "neighbours":
            pairs = similarity.top_neighbours(pairs, a.top)
        elif a.what == "cluster":
            pairs = iterate.leader_clusters(features.selectExpr("CAST(id AS BIGINT) AS node").distinct(), pairs)
        write(pairs, a.out)
    elif a.what == "components":
        from .operators.iterate import connected_components

        write(connected_components(read(a.edges)), a.out)
    elif a.what == "permutation":
        from .operators.shift import mmd_permutation

        mmd_permutation(read(a.table), a.key, a.label, a.vector, a.permutations).show(truncate=False)
    elif a.what == "calibrate":
        from .operators import calibration

        rows = read(a.table)
        scored = calibration.out_of_fold(rows.join(calibration.balanced_folds(rows, a.group, a.folds), a.group), a.x, a.y)
        write(scored, a.out)
        calibration.skill(read(a.out), a.y).show(truncate=False)
    elif a.what == "sweep":
        from .operators import sweep

        proteins, ligands = read(a.proteins), read(a.ligands)
        names = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())  # noqa: E731  # settings, not rows
        wanted = sweep.tags(spark, a.families, a.protein_thresholds or names(proteins, "protein_threshold"), a.ligand_variants or names(ligands, "ligand_variant"), a.seeds)
        audit = sweep.contexts(read(a.entities), proteins, ligands, wanted)
        sweep.write_sweep(sweep.sweep(audit, wanted, a.fractions), wanted, audit, a.out)
        sweep.summary(sweep.read_sweep(spark, a.out)[2], a.fractions[2]).show(truncate=False)
    elif a.what == "validate":
        from .operators import sweep

        problems = sweep.validate_sweep(*sweep.read_sweep(spark, a.sweep)).orderBy("tag", "problem").limit(100).collect()
        if problems:
            raise SystemExit("\n".join(f"{r['tag']}: {r['problem']}" for r in problems))
    elif a.what == "shift":
        from .operators import sweep, sweep_shift

        folds, audit, index = sweep.read_sweep(spark, a.sweep)
        full = folds.join(index.select("tag", *sweep.CONTEXT), "tag").join(audit, [*sweep.CONTEXT, "system"]).select("tag", "system", "protein", "ligand", "fold")
        write(index.join(sweep_shift.shift_rows(full, read(a.vectors), read(a.ligand_pairs), {"identity": read(a.protein_pairs)}, a.n_sample, a.n_perm), "tag"), a.out)
    elif a.what == "sequences":
        from .operators import sequences

        rows = read(a.sequences)
        write(sequences.require_cover(sequences.sequence_clusters(rows, a.identity), rows), a.out)
        sequences.cluster_report(read(a.out)).show(truncate=False)
    elif a.what == "manifest":
        from pyspark.sql import functions as F

        from .sources import formats

        files = formats.file_hashes(spark, a.folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("sha256").alias("is"))
        listed = formats.manifest(spark.read.text(a.manifest))
        bad = listed.join(files, "path", "full").filter(~F.col("sha256").eqNullSafe(F.col("is"))).orderBy("path").limit(100).collect()
        if bad or listed.isEmpty():
            raise SystemExit("\n".join(f"{r['path']}: {'unlisted' if r['sha256'] is None else 'missing' if r['is'] is None else 'differs'}" for r in bad) or "nothing is listed")
    else:
        from .operators.reports import dictionary

        print(dictionary({t.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet"): read(t).schema for t in a.tables}))


if __name__ == "__main__":
    main()
