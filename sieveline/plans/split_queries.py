"""Splits, shift and calibration over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packed as P
from ..operators import shift as M
from ..operators import splits as L
from ..operators import sweep as S
from ..operators import sweep_shift as D
from ..operators.iterate import cut
from ..operators.kernels import kernel_null, numbered, tanimoto
from .contact_queries import _SCORES, scores
from .fixtures import table

Q, O = {}, {}  # noqa: E741


def query(sql=None):
    def add(f):
        if f.__name__ in Q:
            raise ValueError(f"{f.__name__} is registered twice")
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


_CTX = """ctx AS (SELECT DISTINCT l_suppkey * 1000000 + l_partkey AS system, l_suppkey AS protein, l_partkey AS ligand, l_suppkey AS pc, p_brand || p_type AS lc FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def context(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("ligand"), F.concat("p_brand", "p_type").alias("lc"))
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_partkey").alias("ligand")).distinct()
    return s.join(part, "ligand").select((F.col("protein") * 1000000 + F.col("ligand")).alias("system"), "protein", "ligand", F.col("protein").alias("pc"), "lc")


def _greedy(name, source, key, seed, fractions=L.FRACTIONS):
    """Largest first, each to the fold with the largest deficit, the first of equals."""
    x, y, z = ("({:.17g}::DOUBLE * max(total))".format(f) for f in fractions)
    first, second = "a >= greatest(a, b, c) - 1e-9", "b >= greatest(a, b, c) - 1e-9"
    return f"""{name}_g AS (SELECT {key} AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5('{seed}|' || {key}), {key}) AS r, sum(count(*)) OVER () AS total FROM {source} GROUP BY {key}),
  {name}_r AS (SELECT 0::BIGINT AS r, NULL::VARCHAR AS g, 0 AS f, {x} AS a, {y} AS b, {z} AS c FROM {name}_g
    UNION ALL SELECT y.r, y.g::VARCHAR, CASE WHEN {first} THEN 1 WHEN {second} THEN 2 ELSE 3 END, CASE WHEN {first} THEN a - n ELSE a END, CASE WHEN NOT ({first}) AND {second} THEN b - n ELSE b END,
      CASE WHEN NOT ({first}) AND NOT ({second}) THEN c - n ELSE c END FROM {name}_r x JOIN {name}_g y ON y.r = x.r + 1),
  {name} AS (SELECT g, ['train', 'val', 'test'][f] AS fold FROM {name}_r WHERE r > 0)"""


@query(f"WITH RECURSIVE {_CTX}, {_greedy('gp', 'ctx', 'ligand', 's0')} SELECT g::BIGINT AS ligand, fold FROM gp")
def greedy_partition(spark, d):
    return L.greedy_partition(context(spark, d).groupBy("ligand").agg(F.count("*").alias("n")), "ligand", "s0")


def order_context(spark, d):
    """Orders as systems of small clusters: ten or so of a customer, a few of a date."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("system"), F.col("o_custkey").alias("protein"), F.col("o_custkey").alias("pc"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ligand"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("lc"))


# One system after another, with what each cluster still has in train.
_C1 = """o AS (SELECT o_orderkey AS system, o_custkey AS protein, strftime(o_orderdate, '%Y-%m-%d') AS ligand, dense_rank() OVER (ORDER BY o_custkey) AS p, dense_rank() OVER (ORDER BY o_orderdate::DATE) AS q, row_number() OVER (ORDER BY md5('s0|' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders),
  np AS (SELECT list(c ORDER BY p) AS a FROM (SELECT p, count(*) AS c FROM o GROUP BY p)), nq AS (SELECT list(c ORDER BY q) AS b FROM (SELECT q, count(*) AS c FROM o GROUP BY q)),
  walk AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS system, false AS left_train, a, b FROM np, nq
    UNION ALL SELECT y.r, y.system, a[p] > 1 AND b[q] > 1, CASE WHEN a[p] > 1 AND b[q] > 1 THEN list_concat(a[:p - 1], [a[p] - 1], a[p + 1:]) ELSE a END, CASE WHEN a[p] > 1 AND b[q] > 1 THEN list_concat(b[:q - 1], [b[q] - 1], b[q + 1:]) ELSE b END
    FROM walk x JOIN o y ON y.r = x.r + 1 WHERE y.r <= round(0.1 * n) + round(0.1 * n)),
  s AS (SELECT o.system, protein, ligand, CASE WHEN left_train AND o.r <= round(0.1 * n) THEN 'test' WHEN left_train THEN 'val' ELSE 'train' END AS fold FROM o LEFT JOIN walk w ON w.system = o.system)"""


@query(f"WITH RECURSIVE {_C1} SELECT system, fold FROM s")
def split_c1(spark, d):
    return L.random_covered(order_context(spark, d), "s0").select("system", "fold")


def _cold(cold, warm):
    return f"WITH RECURSIVE {_CTX}, {_greedy('gp', 'ctx', cold, 's0')}, f AS (SELECT ctx.*, fold FROM ctx JOIN gp ON gp.g = ctx.{cold}::VARCHAR), s AS (SELECT system, protein, ligand, pc, lc, CASE WHEN fold = 'train' OR {warm} IN (SELECT {warm} FROM f WHERE fold = 'train') THEN fold ELSE 'excluded' END AS fold FROM f)"


@query(_cold("pc", "lc") + " SELECT system, fold FROM s")
def split_c2p(spark, d):
    return L.ASSIGNERS["C2p"](context(spark, d), "s0").select("system", "fold")


@query(_cold("lc", "pc") + " SELECT system, fold FROM s")
def split_c2l(spark, d):
    return L.ASSIGNERS["C2l"](context(spark, d), "s0").select("system", "fold")


@query(f"WITH RECURSIVE {_CTX}, {_greedy('gp', 'ctx', 'pc', 's0p', L.axis_fractions())}, {_greedy('gl', 'ctx', 'lc', 's0l', L.axis_fractions())} SELECT system, CASE WHEN gp.fold = gl.fold THEN gp.fold ELSE 'excluded' END AS fold FROM ctx JOIN gp ON gp.g = pc::VARCHAR JOIN gl ON gl.g = lc")
def split_c3_block(spark, d):
    return L.ASSIGNERS["C3"](context(spark, d), "s0").select("system", "fold")


@query(f"""WITH RECURSIVE ctx AS (SELECT p_partkey AS system, 'p' || p_name || '|' || p_partkey % 7 AS a, 'l' || p_size || '|' || p_brand || '|' || p_partkey % 11 AS b FROM part), e AS (SELECT a, b FROM ctx UNION SELECT b, a FROM ctx),
  comp(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a UNION SELECT e.b, min(c.component) FROM comp c JOIN e ON e.a = c.node JOIN recurring.comp r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b),
  y AS (SELECT system, component FROM ctx JOIN comp ON node = a), {_greedy('gc', 'y', 'component', 's0')} SELECT system, component, fold FROM y JOIN gc ON g = component""")
def split_c3_component(spark, d):
    """Parts as systems of two small clusters each; whole components of the graph of clusters go to folds."""
    pc, lc = F.concat_ws("|", "p_name", F.col("p_partkey") % 7), F.concat_ws("|", "p_size", "p_brand", F.col("p_partkey") % 11)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("system"), pc.alias("pc"), lc.alias("lc"))
    return L.component_block(p, "s0").select("system", "component", "fold")


# The sweep: every family over clusterings of suppliers and parts.

THRESHOLDS = ("0.30", "0.40", "0.50")
VARIANTS = ("scaffold", "butina_0.30", "butina_0.40", "butina_0.50", "butina_0.60")
_PC = "unnest([{'t': '0.30', 'c': p}, {'t': '0.40', 'c': p // 2}, {'t': '0.50', 'c': p // 5}])"
_LC = "unnest([{'v': 'scaffold', 'c': b || t}, {'v': 'butina_0.30', 'c': 'k' || l // 3}, {'v': 'butina_0.40', 'c': 'k' || l // 7}, {'v': 'butina_0.50', 'c': b || '|' || s}, {'v': 'butina_0.60', 'c': t}])"


def sweep_inputs(spark, d):
    """Entities, clusterings of suppliers (proteins) at three thresholds, and of parts (ligands) in five variants."""
    part = table(spark, d, "part")
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_partkey").alias("ligand")).distinct()
    e = e.select((F.col("protein") * 1000000 + F.col("ligand")).alias("system"), "protein", "ligand")
    one = lambda name, c: F.struct(F.lit(name).alias("name"), c.cast("string").alias("c"))
    p, k, brand = F.col("s_suppkey"), F.col("p_partkey"), F.col("p_brand")
    pcs = [one(n, c) for n, c in zip(THRESHOLDS, (p, F.floor(p / 2), F.floor(p / 5)), strict=True)]
    lcs = [one(n, c) for n, c in zip(VARIANTS, (F.concat(brand, "p_type"), F.concat(F.lit("k"), F.floor(k / 3)), F.concat(F.lit("k"), F.floor(k / 7)), F.concat(brand, F.lit("|"), "p_size"), F.col("p_type")), strict=True)]
    proteins = table(spark, d, "supplier").select(p.alias("protein"), F.inline(F.array(*pcs))).select(F.col("name").alias("protein_threshold"), "protein", F.col("c").alias("pc"))
    ligands = part.select(k.alias("ligand"), F.inline(F.array(*lcs))).select(F.col("name").alias("ligand_variant"), "ligand", F.col("c").alias("lc"))
    return e, proteins, ligands


def packed(spark, d, families, seeds=(0,)):
    """The cold splits as words of entities, and their tags."""
    wanted = S.tags(spark, families, THRESHOLDS, VARIANTS, seeds)
    return P.packed(P.entities(*sweep_inputs(spark, d), wanted), wanted), wanted


def _tags(families, seeds=(0,)):
    rows = ", ".join(f"('{S.tag_name(f, p, v, s)}', '{f}', '{p}', '{v}', {s})" for p in THRESHOLDS for v in VARIANTS for f in families for s in seeds)
    return f"tags(tag, family, protein_threshold, ligand_variant, seed) AS (VALUES {rows})"


_AUDIT = f"""e AS (SELECT DISTINCT l_suppkey * 1000000 + l_partkey AS system, l_suppkey AS protein, l_partkey AS ligand FROM lineitem),
  pcl AS (SELECT p AS protein, x.t AS protein_threshold, x.c::VARCHAR AS pc FROM (SELECT s_suppkey AS p, {_PC} AS x FROM (SELECT s_suppkey, s_suppkey AS p FROM supplier))),
  lcl AS (SELECT l AS ligand, x.v AS ligand_variant, x.c AS lc FROM (SELECT l, {_LC} AS x FROM (SELECT p_partkey AS l, p_brand AS b, p_type AS t, p_size AS s FROM part))),
  ctx AS (SELECT protein_threshold, ligand_variant, system, protein, ligand, pc, lc FROM e JOIN pcl USING (protein) JOIN lcl USING (ligand))"""


def _greedy_all(name, source, key, suffix, fractions=L.FRACTIONS):
    """_greedy of every tag, side by side."""
    x, y, z = ("({:.17g}::DOUBLE * total)".format(f) for f in fractions)
    first, second = "a >= greatest(a, b, c) - 1e-9", "b >= greatest(a, b, c) - 1e-9"
    return f"""{name}_g AS MATERIALIZED (SELECT tag, {key} AS g, count(*) AS n, row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, md5(tag || '{suffix}|' || {key}), {key}) AS r, sum(count(*)) OVER (PARTITION BY tag) AS total FROM {source} GROUP BY tag, {key}),
  {name}_r AS (SELECT tag, 0::BIGINT AS r, NULL::VARCHAR AS g, 0 AS f, {x} AS a, {y} AS b, {z} AS c FROM (SELECT DISTINCT tag, total FROM {name}_g)
    UNION ALL SELECT y.tag, y.r, y.g::VARCHAR, CASE WHEN {first} THEN 1 WHEN {second} THEN 2 ELSE 3 END, CASE WHEN {first} THEN a - n ELSE a END, CASE WHEN NOT ({first}) AND {second} THEN b - n ELSE b END,
      CASE WHEN NOT ({first}) AND NOT ({second}) THEN c - n ELSE c END FROM {name}_r x JOIN {name}_g y ON y.tag = x.tag AND y.r = x.r + 1),
  {name} AS MATERIALIZED (SELECT tag, g, ['train', 'val', 'test'][f] AS fold FROM {name}_r WHERE r > 0)"""


def _cold_all(name, family, cold, warm):
    return f"""{name}_c AS (SELECT tag, ctx.* FROM ctx JOIN tags USING (protein_threshold, ligand_variant) WHERE family = '{family}'), {_greedy_all(name + "_p", name + "_c", cold, "")},
  {name}_f AS (SELECT c.*, fold FROM {name}_c c JOIN {name}_p p ON p.tag = c.tag AND p.g = c.{cold}), {name}_s AS (SELECT DISTINCT tag, {warm} FROM {name}_f WHERE fold = 'train'),
  {name} AS (SELECT f.tag, system, protein, ligand, f.pc, f.lc, CASE WHEN fold = 'train' OR s.tag IS NOT NULL THEN fold ELSE 'excluded' END AS fold FROM {name}_f f LEFT JOIN {name}_s s ON s.tag = f.tag AND s.{warm} = f.{warm})"""


_BLOCKS = f"""c3_c AS (SELECT tag, ctx.* FROM ctx JOIN tags USING (protein_threshold, ligand_variant) WHERE family = 'C3'), {_greedy_all("c3_p", "c3_c", "pc", "p", L.axis_fractions())}, {_greedy_all("c3_l", "c3_c", "lc", "l", L.axis_fractions())},
  c3 AS (SELECT c.tag, system, protein, ligand, pc, lc, CASE WHEN p.fold = l.fold THEN p.fold ELSE 'excluded' END AS fold FROM c3_c c JOIN c3_p p ON p.tag = c.tag AND p.g = pc JOIN c3_l l ON l.tag = c.tag AND l.g = lc)"""
_COMPONENTS = """link AS (SELECT protein_threshold || '|' || ligand_variant AS k, 'p' || pc AS a, 'l' || lc AS b FROM ctx), sides AS MATERIALIZED (SELECT k || '#' || a AS a, k || '#' || b AS b FROM link UNION SELECT k || '#' || b, k || '#' || a FROM link),
  comp(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM sides GROUP BY a UNION SELECT e.b, min(c.component) FROM comp c JOIN sides e ON e.a = c.node JOIN recurring.comp r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b),
  aud AS (SELECT ctx.*, split_part(component, '#', 2) AS component FROM ctx JOIN comp ON node = protein_threshold || '|' || ligand_variant || '#p' || pc)"""
_WHOLE = f"""cc_c AS (SELECT tag, aud.* FROM aud JOIN tags USING (protein_threshold, ligand_variant) WHERE family = 'C3comp'), {_greedy_all("cc_p", "cc_c", "component", "")},
  cc AS (SELECT c.tag, system, protein, ligand, pc, lc, fold FROM cc_c c JOIN cc_p p ON p.tag = c.tag AND p.g = component)"""
_COLD = ("C2p", "C2l", "C3", "C3comp")
_SWEPT = f"WITH RECURSIVE {_tags(_COLD)}, {_AUDIT}, {_COMPONENTS}, {_cold_all('c2p', 'C2p', 'pc', 'lc')}, {_cold_all('c2l', 'C2l', 'lc', 'pc')}, {_BLOCKS}, {_WHOLE}, s AS (SELECT * FROM c2p UNION ALL SELECT * FROM c2l UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM cc)"


@query(f"{_SWEPT} SELECT tag, fold, count(*) AS n, sum(system)::DOUBLE AS total, bit_xor(system) AS mixed, sum(system * system % 1000003)::BIGINT AS squares FROM s GROUP BY tag, fold")
def split_sweep(spark, d):
    """Sixty splits in one plan: four families over fifteen contexts; each fold as what tells its systems apart from others."""
    own, _ = packed(spark, d, _COLD)
    system, part = F.col("system"), F.col("system") % 1000003
    # The square of the remainder has the remainder of the square, and doesn't overflow.  Sums of both halves are exact.
    rows = own.each_slot(own.folds(), own.bits(F.col("slot")).alias("m"), system, F.shiftright(system, 20).alias("high"), system.bitwiseAND(2**20 - 1).alias("low"), (part * part % 1000003).alias("square"))
    per = rows.groupBy("slot", "m").agg(F.count("*").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.bit_xor("system").alias("mixed"), F.sum("square").alias("squares"))
    total = (F.col("high").cast("decimal(28,0)") * F.lit(2**20).cast("decimal(7,0)") + F.col("low")).cast("double")
    return own.tagged(per).select("tag", P.fold_name(F.col("m")).alias("fold"), "n", total.alias("total"), "mixed", "squares")


_FRACTION = "avg((EXISTS (SELECT 1 FROM s t WHERE t.tag = s.tag AND t.fold = 'train' AND t.{c} = s.{c}))::INT) FILTER (fold = 'test') AS test_frac_exact_{c}_seen"
_INDEX = f"""per AS (SELECT tag, count(*) AS n_systems, count(*) FILTER (fold = 'train') AS n_train, count(*) FILTER (fold = 'val') AS n_val, count(*) FILTER (fold = 'test') AS n_test, count(*) FILTER (fold = 'excluded') AS n_excluded,
    count(DISTINCT pc) FILTER (fold = 'train') AS n_train_protein_clusters, count(DISTINCT pc) FILTER (fold = 'test') AS n_test_protein_clusters, count(DISTINCT lc) FILTER (fold = 'train') AS n_train_ligand_clusters, count(DISTINCT lc) FILTER (fold = 'test') AS n_test_ligand_clusters,
    {_FRACTION.format(c="protein")}, {_FRACTION.format(c="ligand")} FROM s GROUP BY tag),
  comps AS (SELECT protein_threshold, ligand_variant, count(*) AS n_components, max(n) / sum(n) AS largest_component_fraction FROM (SELECT protein_threshold, ligand_variant, component, count(*) AS n FROM aud GROUP BY ALL) GROUP BY ALL),
  idx AS (SELECT tag, family, protein_threshold, ligand_variant, seed, per.* EXCLUDE (tag), n_components, largest_component_fraction FROM tags JOIN per USING (tag) JOIN comps USING (protein_threshold, ligand_variant))"""


@query(f"{_SWEPT}, {_INDEX} SELECT * FROM idx")
def sweep_index(spark, d):
    """The index of the sweep: a row for each tag."""
    return P.split_index(*packed(spark, d, _COLD)).drop("family_desc")


@query(f"{_SWEPT}, {_INDEX} SELECT family, count(*) AS tags, avg(n_test / n_systems) AS mean_test_share, min(n_test / n_systems) AS least_test_share, avg(n_excluded / n_systems) AS mean_excluded_share, count(*) FILTER (n_test / n_systems < 0.05) AS underpowered FROM idx GROUP BY family")
def sweep_summary(spark, d):
    """Figures of the families over their tags: test sizes, excluded systems, underpowered splits."""
    return S.summary(P.split_index(*packed(spark, d, _COLD)))


@query(f"WITH RECURSIVE {_AUDIT}, {_COMPONENTS}, n AS (SELECT protein_threshold, ligand_variant, component, count(*) AS n FROM aud GROUP BY ALL) SELECT protein_threshold, ligand_variant, count(*) AS n_components, max(n) / sum(n) AS largest_component_fraction, count(*) FILTER (n = 1) AS singleton_components, max(n) / sum(n) <= 0.85 AS balanceable FROM n GROUP BY ALL")
def sweep_contexts(spark, d):
    return P.component_stats(P.entities(*sweep_inputs(spark, d)))


@query(f"{_SWEPT}, {_INDEX} SELECT family, ligand_variant, count(*) AS tags, avg(n_train) AS mean_train, avg(n_val) AS mean_val, avg(n_test) AS mean_test, avg(n_excluded) AS mean_excluded, avg(n_test / n_systems) AS test_share, avg(1 - n_excluded / n_systems) AS retained_share FROM idx GROUP BY ALL")
def sweep_pivot(spark, d):
    """Mean sizes of the folds by family and variant."""
    return S.seed_pivot(P.split_index(*packed(spark, d, _COLD)))


_BROKEN = "SELECT tag, '{a} clusters {what}' AS problem FROM (SELECT s.tag, {a}, max((fold = 'train')::INT) AS t, max((fold = 'val')::INT) AS v, max((fold = 'test')::INT) AS e FROM s JOIN tags USING (tag) WHERE fold <> 'excluded' AND family IN {families} GROUP BY s.tag, {a}) GROUP BY tag HAVING count(*) FILTER ({test}) > 0"


def _broken(axis, of, what, test):
    families = tuple(f for f, c in L.CONTRACTS.items() if axis in c[of])
    return _BROKEN.format(a=axis, what=what, families=families, test=test)


@query(f"{_SWEPT} SELECT tag, 'no test fold' AS problem FROM s GROUP BY tag HAVING count(*) FILTER (fold = 'test') = 0 UNION ALL " + " UNION ALL ".join(_broken(a, of, what, test) for a in ("pc", "lc") for of, what, test in ((0, "in several folds", "t + v + e > 1"), (1, "that train lacks", "v + e > 0 AND t = 0"))))
def sweep_breaches(spark, d):
    """Tags whose contract is broken: here those of whole components, since nearly all systems are in one."""
    return P.contract_breaches(packed(spark, d, _COLD)[0])


# Shift between the folds of every tag.  Parts are alike if their keys are close, suppliers too.


def _near(spark, d, name, key, gap):
    k = table(spark, d, name).select(F.col(key).alias("i"))
    return k.select("i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + gap)).alias("j")).join(k.select(F.col("i").alias("j")), "j").select("i", "j", (1 / (1 + F.col("j") - F.col("i"))).alias("sim"))


def _marks(spark, d):
    """Parts as 0/1 vectors of 34: type, a third of the brand, a fifth of the size."""
    part = table(spark, d, "part")
    on = F.array(F.crc32(F.col("p_type").cast("binary")) % 12, 12 + F.crc32(F.col("p_brand").cast("binary")) % 12, 24 + F.floor(F.col("p_size") % 50 / 5))
    return part.select(F.col("p_partkey").alias("ligand"), F.transform(F.sequence(F.lit(0), F.lit(33)), lambda x: F.array_contains(on, x.cast("long")).cast("double")).alias("v"))


_NN = """{name}_seen AS (SELECT tag, {c} AS i, bool_or(fold = 'train') AS train, bool_or(fold = 'test') AS test FROM s WHERE fold IN ('train', 'test') GROUP BY ALL),
  {name}_one AS (SELECT DISTINCT {k} AS i, {k} + g AS j, 1 / (1 + abs(g)) AS sim FROM {t}, range(-{gap}, {gap} + 1) x(g) WHERE g <> 0),
  {name}_best AS (SELECT a.tag, a.i, CASE WHEN a.train THEN 1.0 ELSE max(CASE WHEN b.i IS NOT NULL THEN sim END) END AS near FROM {name}_seen a LEFT JOIN {name}_one p ON p.i = a.i LEFT JOIN {name}_seen b ON b.tag = a.tag AND b.i = p.j AND b.train WHERE a.test GROUP BY a.tag, a.i, a.train),
  {name}_nn AS (SELECT tag, count(*) AS n_test_{name}s, max(coalesce(near, 0)) AS max_{name}_nn, avg(coalesce(near, 0)) AS mean_{name}_nn, avg((coalesce(near, 0) >= {at})::INT) AS "frac_test_{name}s_nn_ge_{at}", count(*) FILTER (near IS NULL) AS n_{name}_nn_below_floor, quantile_cont(coalesce(near, 0), 0.95) AS p95_{name}_nn FROM {name}_best GROUP BY tag),
  {name}_all AS (SELECT n.*, n_train_{name}s FROM {name}_nn n JOIN (SELECT tag, count(*) AS n_train_{name}s FROM {name}_seen WHERE train GROUP BY tag) USING (tag))"""
_LIGAND_NN = _NN.format(name="ligand", c="ligand", k="p_partkey", t="part", gap=3, at=0.4)
_PROTEIN_NN = _NN.format(name="protein", c="protein", k="s_suppkey", t="supplier", gap=2, at=0.3)


@query(f"{_SWEPT}, {_LIGAND_NN}, {_PROTEIN_NN} SELECT * FROM ligand_all JOIN protein_all USING (tag)")
def sweep_neighbours(spark, d):
    """For each tag, how like train its test entities are."""
    own, _ = packed(spark, d, _COLD)
    folds = cut(own.folds())
    one = D.neighbour_figures(*P.nearest(own, folds, _near(spark, d, "part", "p_partkey", 3), "ligand"), "ligand", 0.4)
    return one.join(D.neighbour_figures(*P.nearest(own, folds, _near(spark, d, "supplier", "s_suppkey", 2), "protein"), "protein", 0.3), "tag")


_SIDE = 40
_MMD = f"""side AS (SELECT tag, system, ligand, (fold = 'test')::INT AS y, row_number() OVER (PARTITION BY tag, fold ORDER BY md5(tag || '|shift|' || system), system) AS turn FROM s WHERE fold IN ('train', 'test')),
  m AS (SELECT tag, least(count(*) FILTER (y = 0), count(*) FILTER (y = 1)) AS m FROM side WHERE turn <= {_SIDE} GROUP BY tag),
  x AS (SELECT side.*, m, p_type AS a, p_brand AS b, p_size % 50 // 5 AS c FROM side JOIN m USING (tag) JOIN part ON p_partkey = ligand WHERE turn <= m),
  hashed AS (SELECT * EXCLUDE (a, b), ta AS a, tb AS b FROM x JOIN (SELECT DISTINCT p_type AS a, CRC_A AS ta FROM part) USING (a) JOIN (SELECT DISTINCT p_brand AS b, CRC_B AS tb FROM part) USING (b)),
  k AS (SELECT p.tag, p.m, p.y AS py, q.y AS qy, ((p.a = q.a)::INT + (p.b = q.b)::INT + (p.c = q.c)::INT) AS i FROM hashed p JOIN hashed q ON q.tag = p.tag AND q.system <> p.system)
  SELECT tag, m AS n_per_side, sum(CASE WHEN py = qy THEN i / (6 - i) / (m * (m - 1)) ELSE -i / (6 - i) / (m * m) END) AS mmd2 FROM k GROUP BY tag, m HAVING m > 1"""


def _crc_table(values, parts):
    import zlib

    return "CASE {c} " + " ".join(f"WHEN '{v}' THEN {zlib.crc32(v.encode()) % parts}" for v in values) + " END"


_TYPES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")
_MMD = _MMD.replace("CRC_A", _crc_table(_TYPES, 12).format(c="p_type")).replace("CRC_B", _crc_table([f"Brand#{i}" for i in range(100)], 12).format(c="p_brand"))


@query(f"{_SWEPT}, {_MMD}")
def sweep_mmd(spark, d):
    """For each tag, MMD with the Tanimoto kernel between samples of train and test, from blocks of the kernel."""
    own, _ = packed(spark, d, _COLD)
    sample = P.sampled_sides(own, cut(own.folds()), _SIDE).join(_marks(spark, d), "ligand")
    null = kernel_null(numbered(sample, "y", "v", "system", ("tag",)), tanimoto, ("tag",), 1)
    return null.filter("mmd2 IS NOT NULL").select("tag", F.col("n1").alias("n_per_side"), "mmd2")


@query()
def sweep_shift(spark, d):
    """The shift row of every tag: MMD and its p value, classifier test, neighbours."""
    return D.packed_shift_rows(packed(spark, d, _COLD)[0], _marks(spark, d), _near(spark, d, "part", "p_partkey", 3), {"near": _near(spark, d, "supplier", "s_suppkey", 2)}, most=300, permutations=100)


# The walk of C1, for every seed and clustering of orders at once; one list for each tag holds what each cluster still has in train.
_C1_TAGS = tuple(f"C1__p{p}__{v}__seed{s}" for p in ("1", "2") for v in ("day", "week") for s in range(3))
_C1_ALL = f"""c AS (SELECT o_orderkey AS system, o_custkey // x.p AS pc, epoch(o_orderdate)::BIGINT // 86400 // x.v AS lc, x.tag FROM orders, (SELECT unnest([{", ".join(f"{{'tag': '{t}', 'p': {t[5]}, 'v': {1 if 'day' in t else 7}}}" for t in _C1_TAGS)}]) AS x)),
  o AS MATERIALIZED (SELECT tag, system, dense_rank() OVER (PARTITION BY tag ORDER BY pc) AS p, dense_rank() OVER (PARTITION BY tag ORDER BY lc) AS q, row_number() OVER (PARTITION BY tag ORDER BY md5(tag || '|' || system), system) AS r, count(*) OVER (PARTITION BY tag) AS n FROM c),
  np AS (SELECT tag, list(x ORDER BY p) AS a FROM (SELECT tag, p, count(*) AS x FROM o GROUP BY tag, p) GROUP BY tag), nq AS (SELECT tag, list(x ORDER BY q) AS b FROM (SELECT tag, q, count(*) AS x FROM o GROUP BY tag, q) GROUP BY tag),
  walk AS (SELECT tag, 0::BIGINT AS r, NULL::BIGINT AS system, false AS left_train, a, b FROM np JOIN nq USING (tag)
    UNION ALL SELECT y.tag, y.r, y.system, a[p] > 1 AND b[q] > 1, CASE WHEN a[p] > 1 AND b[q] > 1 THEN list_concat(a[:p - 1], [a[p] - 1], a[p + 1:]) ELSE a END, CASE WHEN a[p] > 1 AND b[q] > 1 THEN list_concat(b[:q - 1], [b[q] - 1], b[q + 1:]) ELSE b END
    FROM walk x JOIN o y ON y.tag = x.tag AND y.r = x.r + 1 WHERE y.r <= round_even(0.1 * n, 0) + round_even(0.1 * n, 0))"""


@query(f"WITH RECURSIVE {_C1_ALL} SELECT o.tag, o.system, CASE WHEN left_train AND o.r <= round_even(0.1 * n, 0) THEN 'test' WHEN left_train THEN 'val' ELSE 'train' END AS fold FROM o LEFT JOIN walk w ON w.tag = o.tag AND w.system = o.system")
def sweep_random_covered(spark, d):
    """C1 of orders (customers, days): two clusterings of each axis, three seeds, walked together."""
    day = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400)
    pc, lc = {f"p{p}": F.floor(F.col("o_custkey") / p) for p in (1, 2)}, {v: F.floor(day / n) for v, n in (("day", 1), ("week", 7))}
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("system"), *[x.alias(c) for c, x in (pc | lc).items()])
    return L.random_covered_tags(o, [(t, f"p{t[5]}", "day" if "day" in t else "week") for t in _C1_TAGS])


_T1 = "t AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.8) AS v, quantile_cont(epoch_us(o_orderdate), 0.9) AS w FROM orders), s AS (SELECT orders.*, CASE WHEN epoch_us(o_orderdate) < v THEN 'train' WHEN epoch_us(o_orderdate) < w THEN 'val' ELSE 'test' END AS fold FROM orders, t)"


@query(f"WITH {_T1} SELECT o_orderkey, fold FROM s")
def split_t1(spark, d):
    return L.temporal(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "fold")


_T1_FIXED = "s AS (SELECT orders.*, CASE WHEN o_orderdate < TIMESTAMP '1998-06-30' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-06-01' THEN 'val' ELSE 'test' END AS fold FROM orders)"


def fixed(spark, d):
    return L.temporal(table(spark, d, "orders"), "o_orderdate", "1998-06-30", "1999-06-01")


@query(f"WITH {_T1_FIXED} SELECT o_orderkey, fold FROM s")
def split_t1_fixed(spark, d):
    return fixed(spark, d).select("o_orderkey", "fold")


@query(f"WITH {_T1_FIXED} " + " UNION ALL ".join(f"SELECT '{c}' AS entity, avg(({c} IN (SELECT {c} FROM s WHERE fold = 'train'))::INT) FILTER (fold = 'test') AS share_in_train FROM s" for c in ("o_custkey", "o_orderpriority", "o_orderdate")))
def temporal_leakage(spark, d):
    return L.shares_in_train(fixed(spark, d), ["o_custkey", "o_orderpriority", "o_orderdate"])


@query(f"""WITH {_T1}, n AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k, (SELECT count(*) FROM orders) AS t FROM s), m AS (SELECT max(o_orderdate) FILTER (fold = 'train') AS a, min(o_orderdate) FILTER (fold = 'val') AS b, max(o_orderdate) FILTER (fold = 'val') AS c, min(o_orderdate) FILTER (fold = 'test') AS e FROM s),
  x AS (SELECT count(*) AS x FROM (SELECT o_custkey FROM s WHERE fold = 'train' INTERSECT SELECT o_custkey FROM s WHERE fold = 'test'))
  SELECT 'schema' AS "check", true AS passed UNION ALL SELECT 'covers_tier', n = t AND k = t FROM n UNION ALL SELECT 'unique', n = k FROM n UNION ALL SELECT 'vocabulary', (SELECT bool_and(fold IN ('train', 'val', 'test')) FROM s)
  UNION ALL SELECT 'disjoint', (SELECT max(f) = 1 FROM (SELECT count(DISTINCT fold) AS f FROM s GROUP BY o_orderkey)) UNION ALL SELECT 'train_before_val', a < b FROM m UNION ALL SELECT 'val_before_test', c < e FROM m UNION ALL SELECT 'entries_in_one_fold', x = 0 FROM x UNION ALL SELECT 'index_sizes', true""")
def temporal_validation(spark, d):
    """The nine checks; customers stand for entries, so that check fails where one ordered early and late."""
    tier = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    s = L.temporal(tier, "o_orderdate").select("o_orderkey", "fold")
    index = s.agg(*[F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in L.FOLDS])
    return L.temporal_checks(s, tier, index, "o_orderkey", "o_orderdate", "o_custkey")


@query(_cold("pc", "lc") + " SELECT count(*) AS n_systems, count(*) FILTER (fold = 'train') AS n_train, count(*) FILTER (fold = 'val') AS n_val, count(*) FILTER (fold = 'test') AS n_test, count(*) FILTER (fold = 'excluded') AS n_excluded, count(DISTINCT pc) AS n_pc, count(DISTINCT lc) AS n_lc FROM s")
def split_audit(spark, d):
    return L.audit(L.ASSIGNERS["C2p"](context(spark, d), "s0"))


_VIO = "SELECT '{a}' AS axis, count(*) AS clusters, count(*) FILTER (t + v + e > 1) AS shared, count(*) FILTER (v + e > 0 AND t = 0) AS uncovered FROM (SELECT {a}, max((fold = 'train')::INT) AS t, max((fold = 'val')::INT) AS v, max((fold = 'test')::INT) AS e FROM s WHERE fold <> 'excluded' GROUP BY {a})"


@query(_cold("pc", "lc") + " " + _VIO.format(a="pc") + " UNION ALL " + _VIO.format(a="lc"))
def leakage_contract(spark, d):
    s = L.require_contract(cut(L.ASSIGNERS["C2p"](context(spark, d), "s0")), "C2p")  # read six times
    return L.violations(s, "pc").unionByName(L.violations(s, "lc"))


@query(f"WITH RECURSIVE {_C1} SELECT 'protein' AS entity, avg((protein IN (SELECT protein FROM s WHERE fold = 'train'))::INT) AS share_in_train FROM s WHERE fold = 'test' UNION ALL SELECT 'ligand', avg((ligand IN (SELECT ligand FROM s WHERE fold = 'train'))::INT) FROM s WHERE fold = 'test'")
def exact_entity_stats(spark, d):
    return L.exact_entities(L.random_covered(order_context(spark, d), "s0"))


@query("SELECT o_orderpriority, count(*) AS n_systems, count(*) FILTER (o_orderstatus = 'P') AS n_test FROM orders GROUP BY 1 HAVING n_test < 0.5 * 0.9 * n_systems")
def underpowered(spark, d):
    index = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n_systems"), F.count_if(F.col("o_orderstatus") == "P").alias("n_test"))
    return L.underpowered(index, 0.9)


# Shift


@query("WITH r AS (SELECT l_tax + l_discount AS x, (l_returnflag = 'R')::INT AS y FROM lineitem), k AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM r) SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 9) AS auc FROM k")
def exact_auc(spark, d):
    r = table(spark, d, "lineitem").select((F.col("l_tax") + F.col("l_discount")).alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return M.auc(r, "x", "y").select(F.round("auc", 9).alias("auc"))


@query("WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 9) AS spearman FROM k")
def spearman(spark, d):
    return M.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("spearman", 9).alias("spearman"))


@query("""WITH n AS (SELECT l_quantity AS x, l_linenumber AS y, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT sum(sign((a.x - b.x) * (a.y - b.y)) * a.n * b.n) AS s FROM n a JOIN n b ON a.x > b.x),
  t AS (SELECT count(*) * (count(*) - 1) / 2 AS t FROM lineitem), tx AS (SELECT sum(c * (c - 1) / 2) AS tx FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)), ty AS (SELECT sum(c * (c - 1) / 2) AS ty FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_linenumber))
  SELECT round(s / sqrt((t - tx) * (t - ty)), 9) AS tau FROM s, t, tx, ty""")
def kendall(spark, d):
    return M.kendall(table(spark, d, "lineitem"), "l_quantity", "l_linenumber").select(F.round("tau", 9).alias("tau"))


@query("""WITH u AS (SELECT label % 2 AS y, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u, vec_id FROM embeddings), k AS (SELECT a.y AS ya, b.y AS yb, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.u, b.u) AS k FROM u a, u b),
  n AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM u) SELECT round(sum(k) FILTER (ya = 0 AND yb = 0 AND i <> j) / any_value(n0 * (n0 - 1)) + sum(k) FILTER (ya = 1 AND yb = 1 AND i <> j) / any_value(n1 * (n1 - 1)) - 2 * sum(k) FILTER (ya = 0 AND yb = 1) / any_value(n0 * n1), 9) AS mmd2 FROM k, n""")
def mmd2(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % 2).alias("y"), "embedding")
    return M.mmd2(e, "y", "embedding").select(F.round("mmd2", 9).alias("mmd2"))


@query()
def mmd_permutation(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), "embedding")
    return M.mmd_permutation(e, "vec_id", "y", "embedding", 50)


@query()
def classifier_two_sample(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), "embedding")
    return M.classifier_test(e, "embedding", "y", "vec_id")


@query()
def classifier_with_baseline(spark, d):
    """The test on unit vectors, and on their first principal component alone."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 3).cast("int").alias("y"), "embedding")
    return M.classifier_with_baseline(e, "embedding", "y", "vec_id")


_TANIMOTO = """feat AS (SELECT DISTINCT id, bit FROM (SELECT doc_id AS id, unnest(list_transform(list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT % 2048)) AS bit FROM documents JOIN labels USING (doc_id))), nb AS (SELECT id, count(*) AS n, any_value(quality) AS y FROM feat JOIN labels ON doc_id = id GROUP BY id),
  c AS (SELECT a.id AS i, b.id AS j, count(*) AS c FROM feat a JOIN feat b ON a.bit = b.bit AND a.id <> b.id GROUP BY ALL), k AS (SELECT x.y AS a, z.y AS b, c / (x.n + z.n - c) AS k FROM c JOIN nb x ON x.id = i JOIN nb z ON z.id = j), n AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM nb)"""


@query(f"WITH {_TANIMOTO} SELECT round(sum(k) FILTER (a = 0 AND b = 0) / any_value(n0 * (n0 - 1)) + sum(k) FILTER (a = 1 AND b = 1) / any_value(n1 * (n1 - 1)) - 2 * sum(k) FILTER (a = 0 AND b = 1) / any_value(n0 * n1), 9) AS mmd2 FROM k, n")
def mmd2_tanimoto(spark, d):
    """Labelled documents of good and bad quality, as sets of words on 2048 bits."""
    w = F.explode(F.filter(F.split("text", "[ \n\t]+"), lambda x: x != ""))
    f = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), w.alias("w"))
    bit = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 7), 16, 10).cast("bigint") % 2048
    return M.mmd2_tanimoto(f.select("id", "y", bit.alias("bit")), "y").select(F.round("mmd2", 9).alias("mmd2"))


@query()
def first_component(spark, d):
    return M.first_component(table(spark, d, "embeddings"), "embedding", "vec_id")


# Calibration


@query(_SCORES + ", r AS (SELECT abs(accuracy - agreement) AS r FROM scores), o AS (SELECT r, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n FROM r) SELECT round(quantile_cont(r, 0.9), 9) AS interpolated, round(max(r) FILTER (k = least(ceil((n + 1) * 0.9), n)), 9) AS order_statistic FROM o")
def conformal_half_widths(spark, d):
    r = scores(spark, d).select(F.abs(F.col("accuracy") - F.col("agreement")).alias("r"))
    return M.half_widths(r, "r").select(F.round("interpolated", 9).alias("interpolated"), F.round("order_statistic", 9).alias("order_statistic"))


@query(_SCORES + """, ff AS (SELECT *, (('0x' || substr(md5('cv|' || system), 1, 7))::BIGINT % 5) AS fold FROM scores), fit AS (SELECT k, avg(accuracy) AS m, regr_slope(accuracy, agreement) AS s, regr_intercept(accuracy, agreement) AS i FROM ff, range(5) t(k) WHERE fold <> k GROUP BY k)
  SELECT round(avg(abs(accuracy - m)), 9) AS mae_constant, round(avg(abs(accuracy - i - s * agreement)), 9) AS mae_line, round(avg(abs(accuracy - agreement)), 9) AS mae_raw FROM ff JOIN fit ON fold = k""")
def cross_validated_baselines(spark, d):
    r = M.baselines(scores(spark, d), "agreement", "accuracy", "system")
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query(_SCORES + " SELECT least(floor(agreement * 10), 9)::INT AS bin, count(*) AS n, round(avg(agreement), 9) AS predicted, round(avg(accuracy), 9) AS observed FROM scores GROUP BY 1 HAVING count(*) > 5")
def calibration_bins(spark, d):
    return M.fixed_bins(scores(spark, d), "agreement", "accuracy", 10, 5).select("bin", "n", F.round("predicted", 9).alias("predicted"), F.round("observed", 9).alias("observed"))


@query("WITH e AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM orders) SELECT greatest(len(list_filter(e, lambda x: x < o_totalprice)), 1)::INT AS bin, count(*) AS n, round(avg(o_totalprice), 4) AS predicted, round(avg(o_custkey), 6) AS observed, round(1.96 * stddev(o_custkey) / sqrt(count(*)), 6) AS half_width, round(abs(avg(o_totalprice) - avg(o_custkey)), 4) AS gap FROM orders, e GROUP BY 1")
def quantile_calibration(spark, d):
    r = M.quantile_bins(table(spark, d, "orders"), "o_totalprice", "o_custkey", 4)
    return r.select("bin", "n", F.round("predicted", 4).alias("predicted"), F.round("observed", 6).alias("observed"), F.round("half_width", 6).alias("half_width"), F.round("gap", 4).alias("gap"))


@query("WITH p AS (SELECT p_size AS x, sum(p_partkey) AS w FROM part GROUP BY 1), r AS (SELECT x, sum(w) OVER (ORDER BY x) AS run FROM p), t AS (SELECT sum(p_partkey) AS a, sum(p_partkey)::DOUBLE * sum(p_partkey) / sum(p_partkey * p_partkey) AS effective FROM part) SELECT round(effective, 6) AS effective, min(x) FILTER (run >= 0.9 * a) AS quantile FROM r, t GROUP BY effective")
def weighted_quantile(spark, d):
    return M.weighted_quantile(table(spark, d, "part"), "p_size", "p_partkey", 0.9).withColumn("effective", F.round("effective", 6))
