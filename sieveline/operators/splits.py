"""Leakage-controlled splits, their assertions and audits.

A context has a row per system: system, protein, ligand and their clusters pc,
lc.  A split adds fold (train, val, test or excluded).  Contracts are checked
on the folds before they are written and on what was written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import stable_order
from .iterate import connected_components, cut
from .quantiles import quantiles
from .ranking import ranked

FOLDS = ("train", "val", "test")
#: The fraction of systems that each fold is due.
FRACTIONS = (0.8, 0.1, 0.1)


def axis_fractions(fractions: tuple[float, float, float] = FRACTIONS) -> tuple[float, float, float]:
    """Fractions of each of two axes whose diagonal blocks are in proportion to the given ones."""
    roots = [f**0.5 for f in fractions]
    return tuple(r / sum(roots) for r in roots)


def greedy_partition(sizes: DataFrame, key: str, seed: str | Column, fractions: tuple[float, float, float] = FRACTIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, fold): groups, largest first, each to the fold that lacks most of its due.

    sizes: key, n.  Ties between groups follow a stable hash, between folds
    their order.  Each step depends on all before it, so groups (clusters, of
    which there are far fewer than systems) stream in order through one task,
    in Arrow batches; what it keeps is what each fold lacks.  With ``by``,
    every value of those columns is a partition of its own, dealt to a task as
    a whole, and seed may be a column.
    """
    import pyarrow as pa

    total = sizes.groupBy(*by).agg(F.sum("n").alias("_total"))
    turn = [*by, F.desc("n"), F.col("_turn"), F.col(key)]
    rows = sizes.select(*by, key, "n", stable_order(F.col(key), seed).alias("_turn"))
    rows = rows.join(total, [*by]) if by else rows.crossJoin(F.broadcast(total))  # one row
    rows = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*turn).select(*by, key, "n", "_total")
    k = len(by)

    def fold(batches):
        own, lack = None, None
        for b in batches:
            out = []
            groups = zip(*(b.column(c).to_pylist() for c in range(k)), strict=True) if k else [()] * b.num_rows
            for group, n, all_ in zip(groups, b.column(k + 1).to_pylist(), b.column(k + 2).to_pylist(), strict=True):
                if group != own:
                    own, lack = group, [f * all_ for f in fractions]
                most = max(lack) - 1e-9
                best = next(i for i, v in enumerate(lack) if v >= most)
                lack[best] -= n
                out.append(FOLDS[best])
            yield pa.record_batch([*b.columns[: k + 1], pa.array(out, pa.string())], [*by, key, "fold"])

    return rows.mapInArrow(fold, ", ".join(f"`{c}` {sizes.schema[c].dataType.simpleString()}" for c in (*by, key)) + ", fold string")


def _sizes(context: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    return context.groupBy(*by, key).agg(F.count("*").alias("n"))


def random_covered(context: DataFrame, seed: str | Column, fractions: tuple[float, float, float] = FRACTIONS, rounds: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """A random split whose val and test systems keep both clusters in train.

    In a stable order the first systems are due for test, the next for val, in
    exact numbers.  One after another they leave train, unless they are the
    last of one of their clusters there.

    Only a cluster whose members are all due can run out, and only its last
    one in the order can find itself alone.  So all others leave at once, and
    the last ones are decided in rounds: a round decides those whose clusters
    have no other undecided member.  That gives the folds of the walk.  With
    ``by``, every value of those columns is walked by itself, in the same rounds.
    """
    h = stable_order(F.col("system"), seed)
    rows = ranked(context.withColumn("_h", h), [*by, "_h", "system"], "_r")
    if by:
        rows = cut(rows)
        sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), (F.min("_r") - 1).alias("_before"))
        rows = rows.join(sizes, [*by]).withColumn("_r", F.col("_r") - F.col("_before")).drop("_before")
        # round(): halves to even, as the number of one split is.
        n_test, n_val = (F.bround(F.lit(f) * F.col("_n")) for f in fractions[:0:-1])
    else:
        n = context.count()
        rows = rows.withColumn("_n", F.lit(n))
        n_test, n_val = (F.lit(round(f * n)) for f in fractions[:0:-1])
    due = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val")
    rows = cut(rows.withColumn("_due", due).drop("_h", "_n"))
    going = rows.filter("_due IS NOT NULL").select(*by, "system", "pc", "lc", "_r")
    # Clusters all of whose members are due, and their last ones.
    last = going
    for c in ("pc", "lc"):
        full = rows.groupBy(*by, c).agg(F.count("*").alias("_size"), F.count("_due").alias("_n"), F.max("_r").alias("_last")).filter("_size = _n").select(*by, c, F.col("_last").alias(f"_last_{c}"))
        last = last.join(full, [*by, c], "left")
    state = last.select(*by, "system", "pc", "lc", *[(F.col("_r") == F.col(f"_last_{c}")).alias(f"at_{c}") for c in ("pc", "lc")], *[F.col(f"_last_{c}").isNotNull().alias(f"full_{c}") for c in ("pc", "lc")])
    # stays: null while it is undecided.
    either = F.coalesce("at_pc", F.lit(False)) | F.coalesce("at_lc", F.lit(False))
    state = cut(state.withColumn("stays", F.when(either, F.lit(None).cast("boolean")).otherwise(F.lit(False))))
    state = _decided(state, by, rounds)
    stay = state.filter("stays").select(*by, "system", F.lit(True).alias("_stay"))
    fold = F.when(F.col("_due").isNull() | F.col("_stay"), "train").otherwise(F.col("_due"))
    return rows.join(stay, [*by, "system"], "left").withColumn("fold", fold).drop("_r", "_due", "_stay")


def _decided(state: DataFrame, by: tuple[str, ...], rounds: int) -> DataFrame:
    """The last members of clusters whose members are all due, each with whether it stays; those that don't know yet are decided in rounds."""
    for _ in range(rounds):
        if state.filter("stays IS NULL").isEmpty():
            break
        for c in ("pc", "lc"):
            other = state.filter(f"full_{c} AND NOT at_{c}").groupBy(*by, c).agg(F.bool_or("stays").alias(f"kept_{c}"), F.count_if(F.col("stays").isNull()).alias(f"open_{c}"))
            state = state.join(other, [*by, c], "left")
        alone = {c: F.when(~F.coalesce(f"at_{c}", F.lit(False)) | F.coalesce(f"kept_{c}", F.lit(False)), False).when(F.coalesce(f"open_{c}", F.lit(0)) == 0, True) for c in ("pc", "lc")}
        now = F.when(alone["pc"] | alone["lc"], True).when(~alone["pc"] & ~alone["lc"], False)
        state = cut(state.withColumn("stays", F.coalesce("stays", now)).drop("kept_pc", "open_pc", "kept_lc", "open_lc"))
    else:
        raise RuntimeError(f"systems are undecided after {rounds} rounds")
    return state


#: Classes of the stable order that are counted to find its n-th system; only systems in the class of a bound are ranked.
_CLASSES = 16**3


def random_covered_tags(systems: DataFrame, tags: list[tuple[str, str, str]], fractions: tuple[float, float, float] = FRACTIONS, rounds: int = 100) -> DataFrame:
    """(tag, system, fold): random_covered() of many tags, each its own seed, over systems: system, which is a key, and a column for each clustering.

    tags: (tag, column of pc, column of lc), 62 at most.  A system's due tags
    are the bits of a word, so a cluster's members are all due where the "and"
    of their words says so, and no row is moved or saved for each system and
    tag: such rows are those of clusters all of whose members are due, and what
    the last step gives.
    """
    if len(tags) > 62:
        raise ValueError(f"{len(tags)} tags; a word holds 62")
    if not tags:
        raise ValueError("no tags")
    spark, at = systems.sparkSession, {t: i for i, (t, _, _) in enumerate(tags)}
    bit = lambda i: F.lit(1 << i).cast("long")
    key = lambda t: stable_order(F.col("system"), t)
    number = lambda h: F.conv(F.substring(h, 1, 3), 16, 10).cast("int")

    # Bounds of the two folds in each tag's order: by the counts of classes, then by rank in the class that holds the bound.
    each = systems.select("system", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), key(t).alias("h")) for t, i in at.items()])).alias("x")).select("system", "x.t", "x.h")
    counts = each.groupBy("t", number(F.col("h")).alias("k")).agg(F.count("*").alias("n"))
    per: dict[int, list] = {i: [0] * _CLASSES for i in at.values()}
    for r in counts.collect():  # a row for each tag and class
        per[r["t"]][r["k"]] = r["n"]
    total = sum(per[0])
    n_test, n_val = (round(f * total) for f in fractions[:0:-1])
    wanted = []
    for i, own in per.items():
        for which, rank in ((0, n_test), (1, n_test + n_val)):
            before = 0
            for k, n in enumerate(own):
                if before < rank <= before + n:
                    wanted.append((i, which, k, rank - before))
                before += n
    bounds = {}
    if wanted:
        near = each.withColumn("k", number(F.col("h"))).join(F.broadcast(spark.createDataFrame(wanted, "t int, which int, k int, place long")), ["t", "k"])
        place = F.row_number().over(Window.partitionBy("t", "which").orderBy("h", "system"))  # a class of one tag
        bounds = {(r["t"], r["which"]): F.struct(F.lit(r["h"]), F.lit(r["system"]).cast(systems.schema["system"].dataType)) for r in near.withColumn("p", place).filter("p = place").collect()}  # two rows for each tag

    def word(which):
        return sum((F.when(F.struct(key(t), "system") <= bounds[i, which], bit(i)).otherwise(F.lit(0).cast("long")) for t, i in at.items() if (i, which) in bounds), F.lit(0).cast("long"))

    rows = cut(systems.withColumns({"_test": word(0), "_due": word(1)}))
    # Clusters all of whose members are due, for some tag, with those tags.
    own, full = [], {}
    for axis, c in {(a, t[a]) for t in tags for a in (1, 2)}:
        mine = sum(1 << at[t[0]] for t in tags if t[axis] == c)
        full[axis, c] = cut(rows.groupBy(c).agg(F.expr(f"bit_and(_due) & {mine}L").alias("_full")).filter("_full <> 0"))
        found = rows.select("system", c, "_due").join(full[axis, c], c)
        i = F.explode(F.filter(F.array(*[F.lit(at[t[0]]) for t in tags if t[axis] == c]), lambda t: F.getbit("_full", t) == 1)).alias("t")
        own.append(found.select("system", i, F.lit(axis).alias("axis"), F.col(c).cast("string").alias("c")))
    # A row for each member of such a cluster, tag and axis.
    names = F.create_map(*[F.lit(x) for t, i in at.items() for x in (i, t)])
    members = cut(reduce(DataFrame.unionByName, own).withColumn("h", stable_order(F.col("system"), names[F.col("t")])))
    last = members.groupBy("t", "axis", "c").agg(F.max(F.struct("h", "system")).alias("last"))
    members = members.join(last, ["t", "axis", "c"])
    here = [F.max(F.when(F.col("axis") == axis, v)).alias(n) for axis, x in ((1, "pc"), (2, "lc")) for n, v in ((x, F.col("c")), (f"at_{x}", F.col("last.system") == F.col("system")), (f"full_{x}", F.lit(True)))]
    state = members.groupBy("t", "system").agg(*here).withColumns({f"full_{x}": F.coalesce(f"full_{x}", F.lit(False)) for x in ("pc", "lc")})
    either = F.coalesce("at_pc", F.lit(False)) | F.coalesce("at_lc", F.lit(False))
    state = _decided(cut(state.withColumn("stays", F.when(either, F.lit(None).cast("boolean")).otherwise(F.lit(False)))), ("t",), rounds)
    stay = cut(state.filter("stays").groupBy("system").agg(F.expr("bit_or(shiftleft(1L, t))").alias("_stay")))
    rows = rows.join(stay, "system", "left").withColumn("_stay", F.coalesce("_stay", F.lit(0).cast("long")))
    on = lambda c, i: F.getbit(c, F.lit(i)) == 1
    fold = lambda i: F.when(~on("_due", i) | on("_stay", i), "train").when(on("_test", i), "test").otherwise("val")
    return rows.select("system", F.inline(F.array(*[F.struct(F.lit(t).alias("tag"), fold(i).alias("fold")) for t, i in at.items()]))).select("tag", "system", "fold")


def cold_axis(context: DataFrame, cold: str, warm: str, seed: str | Column, fractions: tuple[float, float, float] = FRACTIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """The cold axis is partitioned; val and test keep systems whose warm cluster train has, the rest is excluded."""
    folds = greedy_partition(_sizes(context, cold, by), cold, seed, fractions, by)
    rows = context.join(folds, [*by, cold])
    seen = rows.filter("fold = 'train'").select(*by, warm).distinct().withColumn("seen", F.lit(True))
    fold = F.when((F.col("fold") == "train") | F.col("seen"), F.col("fold")).otherwise("excluded")
    return rows.join(seen, [*by, warm], "left").withColumn("fold", fold).drop("seen")


def block(context: DataFrame, seed: str | Column, fractions: tuple[float, float, float] = FRACTIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """Both axes are partitioned, by roots of the fractions; a system is in a fold if its clusters are in the same one, else excluded."""
    parts = axis_fractions(fractions)
    p, q = (greedy_partition(_sizes(context, c, by), c, F.concat(F.lit(seed), F.lit(axis)), parts, by).withColumnRenamed("fold", f"{axis}f") for c, axis in (("pc", "p"), ("lc", "l")))
    fold = F.when(F.col("pf") == F.col("lf"), F.col("pf")).otherwise("excluded")
    return context.join(p, [*by, "pc"]).join(q, [*by, "lc"]).withColumn("fold", fold).drop("pf", "lf")


def cluster_components(context: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pc, component): connected components of the graph of clusters, named by their least one; edges are distinct pairs of clusters, not systems."""
    name = lambda axis, c: F.struct(*by, F.concat(F.lit(axis), F.col(c).cast("string")).alias("_name"))
    edges = context.select(name("p", "pc").alias("a"), name("l", "lc").alias("b")).distinct()
    comp = connected_components(edges).filter("node._name LIKE 'p%'").select("node", F.col("component._name").alias("component"))
    return context.select(*by, "pc", name("p", "pc").alias("node")).distinct().join(comp, "node").drop("node")


def component_block(context: DataFrame, seed: str | Column, fractions: tuple[float, float, float] = FRACTIONS, by: tuple[str, ...] = (), components: DataFrame | None = None) -> DataFrame:
    """C3comp: whole components of the graph of clusters go to folds; components (by, pc, component) may be given."""
    if components is None:
        components = cluster_components(context, by)
    rows = context.join(components, [*by, "pc"])
    return rows.join(greedy_partition(_sizes(rows, "component", by), "component", seed, fractions, by), [*by, "component"])


def temporal(df: DataFrame, date: str, val_start: str | None = None, test_start: str | None = None, low: float = 0.8, high: float = 0.9) -> DataFrame:
    """Train before the first date, val up to the second, test from there.

    Dates are given, or are (interpolated) quantiles of the dates; a row without a date is excluded.
    """
    t = F.unix_micros(F.col(date).cast("timestamp"))
    if val_start is None:
        cuts = quantiles(df, t, [low, high]).select(*[F.col("quantiles")[i].alias(n) for i, n in enumerate(("val_start", "test_start"))])
    else:
        if not val_start <= test_start:
            raise ValueError(f"val begins {val_start}, after test: {test_start}")
        cuts = df.sparkSession.range(1).select(*[F.unix_micros(F.lit(x).cast("timestamp")).alias(n) for x, n in ((val_start, "val_start"), (test_start, "test_start"))])
    rows = df.crossJoin(F.broadcast(cuts))  # one row
    fold = F.when(t < F.col("val_start"), "train").when(t < F.col("test_start"), "val").when(t.isNotNull(), "test").otherwise("excluded")
    return rows.withColumn("fold", fold).drop("val_start", "test_start")


def shares_in_train(split: DataFrame, entities: list[str]) -> DataFrame:
    """(entity, share_in_train): for each column, the share of test rows whose value train has too; null without test rows."""
    out = None
    for c in entities:
        m = split.groupBy(c).agg(mask().alias("m"), F.count_if(F.col("fold") == "test").alias("n"))
        one = m.agg(F.lit(c).alias("entity"), (F.sum(F.when(F.col("m").bitwiseAND(1) != 0, F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias("share_in_train"))
        out = one if out is None else out.unionByName(one)
    return out


def temporal_checks(split: DataFrame, tier: DataFrame, index: DataFrame, key: str, date: str, entry: str) -> DataFrame:
    """The nine checks of a temporal split (key, fold) of a tier (key, date, entry) as rows (check, passed).

    index: one row with n_train, n_val and n_test, as they were published.
    """
    dated = split.join(tier, key)
    at = lambda f, fold: f(F.when(F.col("fold") == fold, F.col(date)))
    per = split.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"))
    names = tier.select(key).distinct()
    entries = dated.groupBy(entry).agg(mask().alias("m"))
    sizes = split.agg(*[F.count_if(F.col("fold") == f).alias(f"got_{f}") for f in FOLDS])
    row = lambda name, df, ok: df.select(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"))
    both = names.select(key, F.lit(1).alias("a")).join(split.select(key, F.lit(1).alias("b")), key, "full")
    return reduce(DataFrame.unionByName, [
        split.sparkSession.createDataFrame([("schema", [n for n, _ in split.dtypes] == [key, "fold"] and split.schema[key].dataType == tier.schema[key].dataType)], "check string, passed boolean"),
        row("covers_tier", both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n"), F.count("*").alias("all")).crossJoin(tier.agg(F.count("*").alias("tier"))), (F.col("n") == 0) & (F.col("all") == F.col("tier"))),
        row("unique", per.agg(F.max("n").alias("n")), F.col("n") == 1),
        row("vocabulary", split.agg(F.count_if(~F.coalesce(F.col("fold").isin(*FOLDS), F.lit(False))).alias("n")), F.col("n") == 0),
        row("disjoint", per.agg(F.max("folds").alias("n")), F.col("n") == 1),
        row("train_before_val", dated.agg(at(F.max, "train").alias("a"), at(F.min, "val").alias("b")), F.col("a") < F.col("b")),
        row("val_before_test", dated.agg(at(F.max, "val").alias("a"), at(F.min, "test").alias("b")), F.col("a") < F.col("b")),
        row("entries_in_one_fold", entries.agg(F.count_if(F.col("m").bitwiseAND(5) == 5).alias("n")), F.col("n") == 0),
        row("index_sizes", sizes.crossJoin(index), reduce(lambda x, y: x & y, [F.col(f"got_{f}") == F.col(f"n_{f}") for f in FOLDS])),
    ])


ASSIGNERS: dict[str, Callable[..., DataFrame]] = {
    "C1": random_covered,
    "C2p": lambda c, seed, *a, **k: cold_axis(c, "pc", "lc", seed, *a, **k),
    "C2l": lambda c, seed, *a, **k: cold_axis(c, "lc", "pc", seed, *a, **k),
    "C3": block,
    "C3comp": component_block,
}
#: What each family promises: clusters of an axis are in one fold only, or those of val and test are in train too.
CONTRACTS = {"C1": ((), ("pc", "lc")), "C2p": (("pc",), ("lc",)), "C2l": (("lc",), ("pc",)), "C3": (("pc", "lc"), ()), "C3comp": (("pc", "lc"), ())}


def mask() -> Column:
    return F.bit_or(F.when(F.col("fold") == "train", 1).when(F.col("fold") == "val", 2).when(F.col("fold") == "test", 4).otherwise(0))


def violations(split: DataFrame, axis: str) -> DataFrame:
    """For an axis: clusters, those in more than one fold, and those in val or test but not in train."""
    per = split.filter("fold <> 'excluded'").groupBy(axis).agg(mask().alias("m"))
    return per.agg(F.lit(axis).alias("axis"), F.count("*").alias("clusters"), F.count_if(F.bit_count("m") > 1).alias("shared"), F.count_if((F.col("m").bitwiseAND(6) != 0) & (F.col("m").bitwiseAND(1) == 0)).alias("uncovered"))


def require_contract(split: DataFrame, family: str) -> DataFrame:
    """The split, or an error: it must keep its family's contract, know all folds and have a test fold."""
    disjoint, covered = CONTRACTS[family]
    bad = split.filter(~F.col("fold").isin(*FOLDS, "excluded") | F.col("fold").isNull())
    if not bad.isEmpty() or split.filter("fold = 'test'").isEmpty():
        raise ValueError(f"{family}: unknown folds, or no test fold")
    for axis in disjoint + covered:
        r = violations(split, axis).first()
        if (axis in disjoint and r["shared"]) or (axis in covered and r["uncovered"]):
            raise ValueError(f"{family}: {axis} leaks: {r}")
    return split


def audit(split: DataFrame) -> DataFrame:
    return split.agg(F.count("*").alias("n_systems"), *[F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in (*FOLDS, "excluded")], F.count_distinct("pc").alias("n_pc"), F.count_distinct("lc").alias("n_lc"))


def exact_entities(split: DataFrame) -> DataFrame:
    """The share of test systems whose protein, or ligand, is in train as well."""
    return shares_in_train(split, ["protein", "ligand"])


def underpowered(index: DataFrame, test_fraction: float = 0.1) -> DataFrame:
    return index.filter(F.col("n_test") < 0.5 * test_fraction * F.col("n_systems"))


def write(split: DataFrame, family: str, path: str, key: str = "system") -> DataFrame:
    """Check, write partitioned by fold, read again and check what was written: contract, coverage, repeats and sizes."""
    split = require_contract(cut(split), family)
    split.write.partitionBy("fold").mode("overwrite").parquet(path)
    back = split.sparkSession.read.parquet(path)
    sizes = lambda df: {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    if sizes(back) != sizes(split):
        raise ValueError("folds differ in size from what was to be written")
    lost = split.select(key).join(back.select(key), key, "left_anti")
    if not lost.isEmpty() or not back.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("systems were lost or repeated in writing")
    return require_contract(back, family)
