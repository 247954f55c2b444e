"""The cold splits of a sweep without a row for each system and tag.

In the families C2p, C2l, C3 and C3comp a system's fold follows from what its
protein and its ligand have: each allows some folds of a tag, and the system is
in the fold that both allow, else excluded.  So a tag is three bits (train, val,
test), each entity has words of 21 tags, and a system's folds are the "and" of
its protein's and its ligand's words.  Clusters, components and partitions are
worked out on entities, which are far fewer than systems.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import stable_order
from .iterate import connected_components, cut
from .splits import CONTRACTS, FOLDS, FRACTIONS, axis_fractions, greedy_partition
from .sweep import BALANCEABLE, CONTEXT, DESCRIPTIONS

BIT = {"train": 1, "val": 2, "test": 4}
#: An axis that binds nothing allows all folds.
ANY = 7
PER_WORD = 21
#: Families whose folds follow from the entities; C1 decides system by system.
FAMILIES = ("C2p", "C2l", "C3", "C3comp")


@dataclass(frozen=True)
class Entities:
    """Systems with two entities, the clusterings of those that have systems, and how the clusters hang together; saved tables.

    systems: system, protein, ligand.  proteins: protein_threshold, protein, pc, n (its systems);
    ligands: ligand_variant, ligand, lc, n.  components: the context, pc and component.
    """

    systems: DataFrame
    proteins: DataFrame
    ligands: DataFrame
    components: DataFrame


@dataclass(frozen=True)
class Packed:
    """Words of proteins and ligands for all tags; slots: the tags with their word and the place of their bits."""

    entities: Entities
    slots: DataFrame
    words: int
    tags: int
    proteins: DataFrame
    ligands: DataFrame

    @property
    def names(self) -> list[str]:
        return [f"w{i}" for i in range(self.words)]

    def folds(self) -> DataFrame:
        """(system, protein, ligand, w0, ...): each system's folds of all tags."""
        p, q = (df.select(axis, *[F.col(w).alias(f"{axis}_{w}") for w in self.names]) for df, axis in ((self.proteins, "protein"), (self.ligands, "ligand")))
        both = self.entities.systems.join(p, "protein").join(q, "ligand")
        return both.select("system", "protein", "ligand", *[F.col(f"protein_{w}").bitwiseAND(F.col(f"ligand_{w}")).alias(w) for w in self.names])

    def bits(self, slot: Column, prefix: str = "w") -> Column:
        """The three bits of a slot."""
        word = F.col(f"{prefix}0")
        for i in range(1, self.words):
            word = F.when(slot >= i * PER_WORD, F.col(f"{prefix}{i}")).otherwise(word)
        return F.call_function("shiftright", word, (3 * (slot % PER_WORD)).cast("int")).bitwiseAND(ANY).cast("int")

    def each_slot(self, df: DataFrame, *columns) -> DataFrame:
        """Rows once for each tag's slot; only for what is added up at once."""
        return df.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(self.tags - 1)))).select("slot", *columns)

    def tagged(self, df: DataFrame, *columns: str) -> DataFrame:
        """Figures of slots as figures of tags."""
        return df.join(F.broadcast(self.slots.select("slot", "tag")), "slot").select("tag", *(columns or [c for c in df.columns if c != "slot"]))  # settings, not rows


def fold_name(bits: Column) -> Column:
    return reduce(lambda acc, f: acc.when(bits == BIT[f], f), FOLDS[1:], F.when(bits == BIT[FOLDS[0]], FOLDS[0])).otherwise("excluded")


def entities(systems: DataFrame, proteins: DataFrame, ligands: DataFrame, wanted: DataFrame | None = None) -> Entities:
    """What sweep.contexts takes, kept by entity.  A system whose entities a clustering lacks, or has twice, is an error."""
    # A ligand's systems lie together, so that sums over them are small before they are shuffled.
    systems = cut(systems.select("system", "protein", "ligand").repartition("ligand").sortWithinPartitions("ligand", "protein"))
    kept = []
    for df, setting, axis, c in ((proteins, "protein_threshold", "protein", "pc"), (ligands, "ligand_variant", "ligand", "lc")):
        settings = F.broadcast((df if wanted is None else wanted).select(setting).distinct())  # settings, not rows
        due = systems.groupBy(axis).agg(F.count("*").alias("n")).crossJoin(settings)
        rows = cut(due.join(df.select(setting, axis, c), [setting, axis], "left").select(setting, axis, c, "n"))
        bad = rows.groupBy(setting, axis).agg(F.count("*").alias("rows"), F.count(c).alias("known")).filter("rows <> 1 OR known <> 1").first()
        if bad:
            raise ValueError(f"clusterings don't map every system once: no_{c} or several, {bad.asDict()}")
        kept.append(rows)
    contexts = kept[0].select(CONTEXT[0]).distinct().crossJoin(F.broadcast(kept[1].select(CONTEXT[1]).distinct())) if wanted is None else wanted.select(*CONTEXT).distinct()
    return Entities(systems, *kept, cut(_components(systems, *kept, cut(contexts))))


def _components(systems: DataFrame, proteins: DataFrame, ligands: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, pc, component), as cluster_components names them.

    Every context's graph is that of the entities with some of them made one.
    So the components of the entities are found once (bases), and a context
    joins bases by the clusters that lie in several.
    """
    hubs = cut(systems.groupBy("ligand").agg(F.min("protein").alias("hub")))
    links = systems.join(hubs, "ligand").select("protein", "hub").distinct()
    base = cut(_labels(systems.select("protein").distinct(), "protein", links.toDF("a", "b"), "base"))
    of_ligand = hubs.join(base.withColumnRenamed("protein", "hub"), "hub").select("ligand", "base")
    pcs = cut(proteins.join(base, "protein").select("protein_threshold", "pc", "base").distinct())
    lcs = cut(ligands.join(of_ligand, "ligand").select("ligand_variant", "lc", "base").distinct())
    contexts = F.broadcast(contexts)  # settings, not rows
    edges = []
    for df, setting, c in ((pcs, "protein_threshold", "pc"), (lcs, "ligand_variant", "lc")):
        least = df.groupBy(setting, c).agg(F.min("base").alias("least"))
        edges.append(df.join(least, [setting, c]).filter("base <> least").select(setting, "base", "least").distinct().join(contexts, setting).select(*CONTEXT, "base", "least"))
    node = lambda c: F.struct(*CONTEXT, F.col(c).alias("base"))
    moved = connected_components(reduce(DataFrame.unionByName, edges).select(node("base").alias("a"), node("least").alias("b")))
    moved = moved.select(*[F.col(f"node.{x}").alias(x) for x in (*CONTEXT, "base")], F.col("component.base").alias("root"))
    every = pcs.select("protein_threshold", "base").distinct().join(contexts, "protein_threshold").join(moved, [*CONTEXT, "base"], "left")
    every = cut(every.select(*CONTEXT, "base", F.coalesce("root", "base").alias("root")))
    # A component is named by its least cluster, and those of ligands come first.
    first = lcs.groupBy("ligand_variant", "base").agg(F.min(F.concat(F.lit("l"), F.col("lc").cast("string"))).alias("name"))
    names = every.join(first, ["ligand_variant", "base"]).groupBy(*CONTEXT, "root").agg(F.min("name").alias("component"))
    one = pcs.groupBy("protein_threshold", "pc").agg(F.min("base").alias("base"))  # all of a cluster's bases are in one component
    return one.join(every, ["protein_threshold", "base"]).join(names, [*CONTEXT, "root"]).select(*CONTEXT, "pc", "component")


def _labels(nodes: DataFrame, key: str, edges: DataFrame, name: str) -> DataFrame:
    found = connected_components(edges).select(F.col("node").alias(key), F.col("component").alias(name))
    return nodes.join(found, key, "left").select(key, F.coalesce(name, key).alias(name))


def packed(known: Entities, wanted: DataFrame, fractions: tuple[float, float, float] = FRACTIONS) -> Packed:
    """The folds of all wanted tags, each that of sweep.sweep()."""
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError(f"fractions of folds must sum to 1: {fractions}")
    rows = sorted(tuple(r) for r in wanted.select("tag", "family", *CONTEXT).collect())  # settings, not rows
    if other := {r[1] for r in rows} - set(FAMILIES):
        raise ValueError(f"the folds of {sorted(other)} don't follow from entities")
    spark = wanted.sparkSession
    slots = spark.createDataFrame([(*r, i, i // PER_WORD, 3 * (i % PER_WORD)) for i, r in enumerate(rows)], "tag string, family string, protein_threshold string, ligand_variant string, slot int, word int, place int")
    words = -(-len(rows) // PER_WORD)
    out = Packed(known, slots, words, len(rows), known.proteins, known.ligands)
    small = F.broadcast(slots)

    def pack(df, *by):
        """Bits of slots (by, word, place, bits) to one row of words."""
        at = F.call_function("shiftleft", F.col("bits").cast("long"), F.col("place"))
        return df.groupBy(*by).agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == i, at)), F.lit(0).cast("long")).alias(w) for i, w in enumerate(out.names)])

    p_sizes = cut(known.proteins.groupBy("protein_threshold", "pc").agg(F.sum("n").alias("n")))
    l_sizes = cut(known.ligands.groupBy("ligand_variant", "lc").agg(F.sum("n").alias("n")))
    bits = reduce(lambda acc, f: acc.when(F.col("fold") == f, BIT[f]), FOLDS[1:], F.when(F.col("fold") == FOLDS[0], BIT[FOLDS[0]]))

    def dealt(sizes, on, key, families, suffix="", parts=fractions):
        rows = sizes.join(F.broadcast(slots.filter(F.col("family").isin(families))), on).select("tag", key, "n")  # settings, not rows
        got = greedy_partition(rows, key, F.concat("tag", F.lit(suffix)), parts, ("tag",))
        return got.select("tag", key, bits.alias("bits")).join(small, "tag")

    axis = axis_fractions(fractions)
    p = dealt(p_sizes, "protein_threshold", "pc", ["C2p"]).unionByName(dealt(p_sizes, "protein_threshold", "pc", ["C3"], "p", axis))
    q = dealt(l_sizes, "ligand_variant", "lc", ["C2l"]).unionByName(dealt(l_sizes, "ligand_variant", "lc", ["C3"], "l", axis))
    if any(r[1] == "C3comp" for r in rows):
        sizes = known.components.join(p_sizes, ["protein_threshold", "pc"]).groupBy(*CONTEXT, "component").agg(F.sum("n").alias("n"))
        whole = dealt(sizes, [*CONTEXT], "component", ["C3comp"]).select("component", "bits", *slots.columns)
        p = p.unionByName(known.components.join(whole, [*CONTEXT, "component"]).select(*p.columns))
    p, q = cut(pack(p, "protein_threshold", "pc")), cut(pack(q, "ligand_variant", "lc"))

    def constant(families, value):
        """A word of this value in every slot of the families, for each word."""
        return [sum(value << 3 * (i % PER_WORD) for i, r in enumerate(rows) if r[1] in families and i // PER_WORD == w) for w in range(words)]

    def own(df, clusters, setting, axis, c):
        """Words of clusters to words of entities."""
        return df.select(setting, axis, c).join(clusters, [setting, c], "left").groupBy(axis).agg(*[F.coalesce(F.bit_or(w), F.lit(0).cast("long")).alias(w) for w in out.names])

    done = {}
    p_own, q_own = cut(own(known.proteins, p, "protein_threshold", "protein", "pc")), cut(own(known.ligands, q, "ligand_variant", "ligand", "lc"))
    for cold, cold_own, warm, df, setting, c, family in (("protein", p_own, "ligand", known.ligands, "ligand_variant", "lc", "C2p"), ("ligand", q_own, "protein", known.proteins, "protein_threshold", "pc", "C2l")):
        if not any(r[1] == family for r in rows):
            continue
        # A warm cluster that train has allows all folds, others train alone: those that any of its systems' cold entities brings to train.
        train = constant([family], BIT["train"])
        of = cold_own.select(cold, *[F.col(w).bitwiseAND(F.lit(train[i]).cast("long")).alias(w) for i, w in enumerate(out.names)])
        met = known.systems.join(of, cold).groupBy(warm).agg(*[F.bit_or(w).alias(w) for w in out.names])
        near = df.select(setting, warm, c).join(met, warm).groupBy(setting, c).agg(*[F.bit_or(w).alias(w) for w in out.names])
        # A cluster's words hold for the tags of its own setting only.
        mine = pack(slots.withColumn("bits", F.lit(ANY)), setting).select(setting, *[F.col(w).alias(f"m{w}") for w in out.names])
        near = near.join(F.broadcast(mine), setting)  # settings, not rows
        all_ = [F.col(w).bitwiseOR(F.call_function("shiftleft", F.col(w), F.lit(1))).bitwiseOR(F.call_function("shiftleft", F.col(w), F.lit(2))) for w in out.names]
        done[warm] = cut(near.select(setting, c, *[(x.bitwiseOR(F.lit(train[i]).cast("long"))).bitwiseAND(F.col(f"m{w}")).alias(w) for i, (x, w) in enumerate(zip(all_, out.names, strict=True))]))

    def final(base, df, setting, axis, c, free):
        if axis in done:
            more = own(df, done[axis], setting, axis, c).select(axis, *[F.col(w).alias(f"s{w}") for w in out.names])
            base = base.join(more, axis).select(axis, *[F.col(w).bitwiseOR(F.col(f"s{w}")).alias(w) for w in out.names])
        return cut(base.select(axis, *[F.col(w).bitwiseOR(F.lit(free[i]).cast("long")).alias(w) for i, w in enumerate(out.names)]))

    return Packed(known, slots, words, len(rows), final(p_own, known.proteins, "protein_threshold", "protein", "pc", constant([], 0)), final(q_own, known.ligands, "ligand_variant", "ligand", "lc", constant(["C3comp"], ANY)))


def component_stats(known: Entities) -> DataFrame:
    """The rows of sweep.component_stats."""
    sizes = known.proteins.groupBy("protein_threshold", "pc").agg(F.sum("n").alias("n"))
    per = known.components.join(sizes, ["protein_threshold", "pc"]).groupBy(*CONTEXT, "component").agg(F.sum("n").alias("n"))
    share = F.max("n") / F.sum("n")
    return per.groupBy(*CONTEXT).agg(F.count("*").alias("n_components"), share.alias("largest_component_fraction"), F.count_if(F.col("n") == 1).alias("singleton_components"), (share <= BALANCEABLE).alias("balanceable"))


def seen(own: Packed, folds: DataFrame, axis: str) -> DataFrame:
    """(axis, w0, ...): the folds of all tags in which an entity has systems; a saved table."""
    return cut(folds.groupBy(axis).agg(*[F.bit_or(w).alias(w) for w in own.names]))


def _clusters(own: Packed, met: DataFrame, axis: str) -> DataFrame:
    """(setting, slot, m): the folds in which each cluster has systems, a row for each cluster and tag of its setting."""
    df, setting, c = (own.entities.proteins, "protein_threshold", "pc") if axis == "protein" else (own.entities.ligands, "ligand_variant", "lc")
    rows = df.select(setting, axis, c).join(met, axis).groupBy(setting, c).agg(*[F.bit_or(w).alias(w) for w in own.names])
    return rows.join(F.broadcast(own.slots.select(setting, "slot")), setting).select("slot", own.bits(F.col("slot")).alias("m"))  # settings, not rows


def fold_sizes(own: Packed, folds: DataFrame) -> DataFrame:
    """(slot, m, n): how many systems have each fold, by its bits (0: excluded)."""
    return own.each_slot(folds, own.bits(F.col("slot")).alias("m")).groupBy("slot", "m").agg(F.count("*").alias("n"))


def contract_breaches(own: Packed) -> DataFrame:
    """The rows of sweep.contract_breaches; folds here are known ones by their making."""
    folds = cut(own.folds())
    met = {axis: seen(own, folds, axis) for axis in ("protein", "ligand")}
    clusters = {c: _clusters(own, met[axis], axis) for axis, c in (("protein", "pc"), ("ligand", "lc"))}
    # A tag has a test fold if any entity has a system there.
    some = clusters["pc"].groupBy("slot").agg(F.bit_or("m").alias("m"))
    problems = [own.slots.join(some, "slot", "left").filter((F.coalesce("m", F.lit(0)).bitwiseAND(BIT["test"])) == 0).select("tag", F.lit("no test fold").alias("problem"))]
    for axis, rows in clusters.items():
        per = rows.groupBy("slot").agg(F.count_if(F.bit_count("m") > 1).alias("shared"), F.count_if((F.col("m").bitwiseAND(6) != 0) & (F.col("m").bitwiseAND(1) == 0)).alias("uncovered")).join(F.broadcast(own.slots), "slot")
        for kind, of, name in (("shared", 0, "clusters in several folds"), ("uncovered", 1, "clusters that train lacks")):
            bound = [f for f, c in CONTRACTS.items() if axis in c[of]]
            problems.append(per.filter((F.col(kind) > 0) & F.col("family").isin(bound)).select("tag", F.concat_ws(" ", F.lit(axis), F.lit(name)).alias("problem")))
    return reduce(DataFrame.unionByName, problems)


def split_index(own: Packed, wanted: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """The rows of sweep.split_index; folds: own.folds() if they are saved already."""
    folds = cut(own.folds()) if folds is None else folds
    met = {axis: seen(own, folds, axis) for axis in ("protein", "ligand")}
    rows = folds
    for axis, x in (("protein", "p"), ("ligand", "l")):
        rows = rows.join(met[axis].select(axis, *[F.col(w).alias(f"{x}{w}") for w in own.names]), axis)
    slot = F.col("slot")
    rows = own.each_slot(rows, own.bits(slot).alias("m"), own.bits(slot, "pw").bitwiseAND(1).alias("p"), own.bits(slot, "lw").bitwiseAND(1).alias("l"))
    per = cut(rows.groupBy("slot", "m", "p", "l").agg(F.count("*").alias("n")))
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    test = F.col("m") == BIT["test"]
    n = own.tagged(per.groupBy("slot").agg(
        F.sum("n").alias("n_systems"), *[of(F.col("m") == b).alias(f"n_{f}") for f, b in (*BIT.items(), ("excluded", 0))],
        *[(of(test & (F.col(x) == 1)) / F.nullif(of(test), F.lit(0))).alias(f"test_frac_exact_{axis}_seen") for axis, x in (("protein", "p"), ("ligand", "l"))],
    ))
    for axis in ("protein", "ligand"):
        c = _clusters(own, met[axis], axis).groupBy("slot").agg(*[F.count_if(F.col("m").bitwiseAND(BIT[f]) != 0).alias(f"n_{f}_{axis}_clusters") for f in ("train", "test")])
        n = n.join(own.tagged(c), "tag")
    describe = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
    return wanted.withColumn("family_desc", describe[F.col("family")]).join(n, "tag").join(component_stats(own.entities).select(*CONTEXT, "n_components", "largest_component_fraction"), [*CONTEXT])


def clusters_in_folds(own: Packed, folds: DataFrame, axis: str) -> DataFrame:
    """(slot, m): for each cluster and tag, the folds in which it has systems, by their bits."""
    return _clusters(own, seen(own, folds, axis), axis)


def nearest(own: Packed, folds: DataFrame, pairs: DataFrame, axis: str) -> tuple[DataFrame, DataFrame]:
    """What sweep_shift.neighbour_figures takes: (tag, near, none) for each entity that a tag's test has, and (tag, n) of those that train has.

    A pair is met once, with the words of both; only where one is in test alone and the other in train does it become a row of a tag.
    """
    met = seen(own, folds, axis)
    both = pairs.select("i", "j", F.col("sim").cast("double").alias("sim")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sim").cast("double").alias("sim")))
    for c in "ij":
        both = both.join(met.select(F.col(axis).alias(c), *[F.col(w).alias(f"{c}{w}") for w in own.names]), c)
    lowest = F.lit(sum(1 << 3 * i for i in range(PER_WORD))).cast("long")
    counts = [F.call_function("shiftright", F.col(f"i{w}"), F.lit(2)).bitwiseAND(F.bitwise_not(F.col(f"i{w}"))).bitwiseAND(F.col(f"j{w}")).bitwiseAND(lowest).alias(w) for w in own.names]
    both = both.select("i", "sim", *counts).filter(reduce(lambda a, b: a | b, [F.col(w) != 0 for w in own.names]))
    near = own.each_slot(both, "i", "sim", own.bits(F.col("slot")).alias("m")).filter("m = 1").groupBy("slot", "i").agg(F.max("sim").alias("near"))
    every = own.each_slot(met, F.col(axis).alias("i"), own.bits(F.col("slot")).alias("m"))
    test = every.filter(F.col("m").bitwiseAND(4) != 0)
    alone = test.filter(F.col("m").bitwiseAND(1) == 0).join(near, ["slot", "i"], "left").select("slot", F.coalesce("near", F.lit(0.0)).alias("near"), F.col("near").isNull().alias("none"))
    best = test.filter(F.col("m").bitwiseAND(1) != 0).select("slot", F.lit(1.0).alias("near"), F.lit(False).alias("none")).unionByName(alone)
    n = every.filter(F.col("m").bitwiseAND(1) != 0).groupBy("slot").agg(F.count("*").alias("n"))
    return own.tagged(best), own.tagged(n)


def sampled_sides(own: Packed, folds: DataFrame, most: int) -> DataFrame:
    """(tag, system, ligand, y, turn): the rows of sweep_shift.sampled_sides.

    A side of n systems has its first ones below a bound on their stable order
    that leaves some more than are wanted; a side for which it left too few is
    read again with a wider one, at last with none.
    """
    sizes = own.tagged(fold_sizes(own, folds).filter(F.col("m").isin(BIT["train"], BIT["test"])), "slot", "m", "n").collect()  # two rows a tag
    todo, found, spare = {(r["slot"], r["m"]): (r["tag"], r["n"]) for r in sizes}, [], 2
    while todo:
        span = lambda n: "g" if spare * most + 50 >= n else f"{(spare * most + 50) * 16**15 // n:015x}"  # noqa: E731, B023
        bounds = own.slots.sparkSession.createDataFrame([(*k, tag, span(n)) for k, (tag, n) in todo.items()], "slot int, m int, tag string, bound string")
        rows = own.each_slot(folds, "system", "ligand", own.bits(F.col("slot")).alias("m")).join(F.broadcast(bounds), ["slot", "m"])  # two rows a tag
        rows = rows.withColumn("_h", stable_order(F.col("system"), F.concat("tag", F.lit("|shift")))).filter("_h < bound")
        rows = cut(rows.select("slot", "m", "tag", "system", "ligand", "_h"))
        got = {(r["slot"], r["m"]): r["count"] for r in rows.groupBy("slot", "m").count().collect()}  # two rows a tag
        short = {k for k, (_, n) in todo.items() if got.get(k, 0) < min(n, most)}
        few = own.slots.sparkSession.createDataFrame([(*k,) for k in todo if k not in short], "slot int, m int")
        found.append(rows.join(F.broadcast(few), ["slot", "m"], "left_semi"))
        todo, spare = {k: v for k, v in todo.items() if k in short}, 8 * spare
    if not found:
        return own.tagged(own.each_slot(folds, "system", "ligand", F.lit(0).alias("y"), F.lit(1).alias("turn")).filter("false"))
    rows = reduce(DataFrame.unionByName, found).withColumn("y", (F.col("m") == BIT["test"]).cast("int"))
    first = cut(rows.withColumn("turn", F.row_number().over(Window.partitionBy("tag", "y").orderBy("_h", "system"))).filter(F.col("turn") <= most))
    n = first.groupBy("tag").agg(F.least(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).alias("_m"))
    return first.join(F.broadcast(n), "tag").filter(F.col("turn") <= F.col("_m")).select("tag", "system", "ligand", "y", "turn")  # a row for each tag
