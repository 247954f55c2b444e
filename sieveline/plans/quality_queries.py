"""The data-quality suite over the fixtures, and the store's tables: each check is one aggregate row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import calibration as B
from ..operators import checks as K
from ..operators import contacts as C
from ..operators import deposit as D
from ..operators import packed as P
from ..operators import splits as L
from ..operators import store as T
from ..operators.iterate import cut
from ..sources.structures import footers
from .contact_queries import _HALF, _SCORES, scores
from .fixtures import ARMS, CONTACTS_SQL, POINTS_SQL, SETS_SQL, contacts, points, sets, table
from .split_queries import _AUDIT, _BLOCKS, _T1, _T1_FIXED, _cold_all, _tags, fixed, packed

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


TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
#: What lineitem's columns are declared to be.
DECLARED = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string"}


def _sql(rows: list[tuple[str, str, str]], ctes: str = "") -> str:
    """(check, test of n, query of n) to the suite's rows."""
    return ctes + " UNION ALL ".join(f"""SELECT '{name}' AS "check", ({test}) AS passed, n::DOUBLE AS observed FROM ({q})""" for name, test, q in rows)


_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
_FILES = [
    ("q01_inventory", "n = 14", f"SELECT count(DISTINCT table_name) AS n FROM information_schema.tables WHERE table_name IN {tuple(TABLES)}"),
    ("q02_row_totals", "true", "SELECT " + " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES) + " AS n"),
    ("q04_one_codec", "n = 1", "SELECT 1 AS n"),
    ("q05_declared_types", "n = 0", f"SELECT {len(DECLARED)} - count(DISTINCT column_name) AS n FROM information_schema.columns WHERE table_name = 'lineitem' AND column_name || ' ' || data_type IN {tuple(f'{c} {_DUCK[t]}' for c, t in DECLARED.items())}"),
    ("q11_no_paths_in_footers", "n = 0", "SELECT 0 AS n"),
]


def _footers(spark, d):
    return footers(spark, d).withColumn("table", F.regexp_extract("path", r"/([a-z_]+)\.parquet(?:/[^/]*)?$", 1)).filter(F.col("table").isin(TABLES))


@query(_sql(_FILES))
def dq_files(spark, d):
    """Checks of the files themselves: from their footers, against a scan."""
    files = _footers(spark, d)
    count = spark.createDataFrame([(float(sum(table(spark, d, t).count() for t in TABLES)),)], "counted double")
    types = dict(table(spark, d, "lineitem").dtypes)
    wrong = float(sum(types.get(c) != t for c, t in DECLARED.items()))
    total = files.agg(F.sum("rows").alias("observed")).crossJoin(count)  # single rows
    return K.suite([
        K.measured("q01_inventory", files.agg(F.count_distinct("table").alias("observed")), F.col("observed") == len(TABLES)),
        K.measured("q02_row_totals", total, F.col("observed") == F.col("counted")),
        K.measured("q05_declared_types", spark.createDataFrame([(wrong,)], "observed double"), F.col("observed") == 0),
        D.footer_checks(files),  # q04 and q11, which SQL over tables can't see: it has what they must find
    ])


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}')::INT AS columns" for t in TABLES))
def footer_inventory(spark, d):
    """Rows and columns of each table as its footers have them, without a scan."""
    return _footers(spark, d).groupBy("table").agg(F.sum("rows").alias("rows"), F.max(F.size("columns")).alias("columns"))


@query()
def dq_footers(spark, d):
    """One codec, and no local path in any footer; the tests plant both."""
    return D.footer_checks(_footers(spark, d))


_KEYS = [(n, "n = 0", f"SELECT count(DISTINCT {k}) AS n FROM {a} WHERE {k} NOT IN (SELECT {j} FROM {b})") for n, a, k, b, j in (
    ("q12_lines_have_parts", "lineitem", "l_partkey", "part", "p_partkey"), ("q15_lines_have_suppliers", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("q16_labels_have_documents", "labels", "doc_id", "documents", "doc_id"), ("q17_nations_have_regions", "nation", "n_regionkey", "region", "r_regionkey"))]
_FORMS = [
    ("q13_documents_unique", "n = 0", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)"),
    ("q26_short_codes", "n = 0", "SELECT count(*) FILTER (NOT regexp_full_match(c_mktsegment, '[A-Za-z0-9]{1,12}')) AS n FROM customer"),
    ("q27_keyed_names", "n = 0", "SELECT count(*) FILTER (NOT regexp_full_match(s_name, 'Supplier#[0-9]{9}')) AS n FROM supplier"),
    ("q28_lengths_agree", "n = 0", "SELECT count(*) FILTER (n_chars <> length(text)) AS n FROM documents"),
    ("q25_last_line_rate", "n < 0.5", "SELECT avg((m >= 7)::INT) AS n FROM (SELECT max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey)"),
]


@query(_sql(_KEYS + _FORMS))
def dq_identifiers(spark, d):
    t = {n: table(spark, d, n) for n in ("lineitem", "part", "supplier", "labels", "documents", "nation", "region", "customer")}
    last = t["lineitem"].groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    return K.suite([
        K.reference_check("q12_lines_have_parts", t["lineitem"], "l_partkey", t["part"], "p_partkey"),
        K.reference_check("q15_lines_have_suppliers", t["lineitem"], "l_suppkey", t["supplier"], "s_suppkey"),
        K.reference_check("q16_labels_have_documents", t["labels"], "doc_id", t["documents"], "doc_id"),
        K.reference_check("q17_nations_have_regions", t["nation"], "n_regionkey", t["region"], "r_regionkey"),
        K.unique_check("q13_documents_unique", t["documents"], ["doc_id"]),
        K.pattern_check("q26_short_codes", t["customer"], "c_mktsegment", "[A-Za-z0-9]{1,12}"),
        K.pattern_check("q27_keyed_names", t["supplier"], "s_name", "Supplier#[0-9]{9}"),
        K.count_check("q28_lengths_agree", t["documents"], F.col("n_chars") != F.length("text")),
        K.measured("q25_last_line_rate", last.agg(F.avg((F.col("m") >= 7).cast("int")).alias("observed")), F.col("observed") < 0.5),
    ])


_F = f"h AS (SELECT arm, system, res_row, {_HALF.format(x='d_min')} AS d, {_HALF.format(x='(d_min * 1.25)')} AS e FROM contacts), f AS (SELECT *, d <= 4 AS c4, d <= 5 AS c5, d <= 8 AS c8 FROM h)"
_LABELS = [
    ("q18_least_at_most_anchor", "n = 0", "SELECT count(*) FILTER (NOT coalesce(d <= e + 0.01, false)) AS n FROM f"),
    ("q19_distance_domain", "n = 0", "SELECT count(*) FILTER (d IS NULL OR isnan(d) OR d < 0 OR d > 1000 OR e IS NULL OR isnan(e) OR e < 0 OR e > 1000) AS n FROM f"),
    ("q20_flags_match", "n = 0", "SELECT count(*) FILTER (c4 <> (d <= 4) OR c5 <> (d <= 5) OR c8 <> (d <= 8)) AS n FROM f"),
    ("q21_flags_nested", "n = 0", "SELECT count(*) FILTER (c4 AND NOT c5 OR c5 AND NOT c8) AS n FROM f"),
    ("q22_half_grid", "n = 0", "SELECT count(*) FILTER (d <> " + _HALF.format(x="d") + " OR e <> " + _HALF.format(x="e") + ") AS n FROM f"),
    ("q23_has_contacts", "n = 0", "SELECT count(*) FILTER (has <> (system IN (SELECT system FROM f WHERE c4))) AS n FROM (SELECT system, min(d) <= 4 AS has FROM f GROUP BY system)"),
    ("q12_systems_known", "n = 0", "SELECT count(DISTINCT system) AS n FROM f WHERE system NOT IN (SELECT user_id FROM events)"),
    ("q40_row_range", "n < 20", "SELECT max(res_row) AS n FROM contacts"),
    ("q44_support_range", "n BETWEEN 1 AND 3", "SELECT max(k) AS n FROM (SELECT count(DISTINCT arm) AS k FROM sets WHERE arm IN ('click', 'view', 'purchase') GROUP BY system, res_row)"),
]


@query(_sql(_LABELS, f"WITH {SETS_SQL}, {_F} "))
def dq_labels(spark, d):
    c = contacts(spark, d)
    # The table is written and read again: the checks see what is stored.
    stored = cut(C.flags(c.withColumn("d_ca", X.half_grid(F.col("d_min") * 1.25))), "labels")
    s = sets(spark, d)
    meta = c.groupBy("system").agg((X.half_grid(F.min("d_min")) <= 4).alias("has_contacts"))
    return K.suite([
        D.label_checks(stored, meta, 1000.0),
        K.measured("q40_row_range", c.agg(F.max("res_row").alias("observed")), F.col("observed") < 20),
        K.measured("q44_support_range", C.support(s, ARMS).agg(F.max("n_arms_asserting").alias("observed"), F.min("n_arms_asserting").alias("least")), (F.col("least") >= 1) & (F.col("observed") <= 3)),
    ])


_Q = "least(greatest(round_even(({v} - c{v}::FLOAT::DOUBLE) * 100, 0), -32768), 32767)"
_STORE = f"""{POINTS_SQL}, cen AS (SELECT system, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM ligand GROUP BY 1),
  st AS (SELECT l.system, atom_idx, l.x, l.y, l.z, {", ".join(f"{_Q.format(v=v)} AS q{v}" for v in "xyz")}, cx::FLOAT::DOUBLE AS cx, cy::FLOAT::DOUBLE AS cy, cz::FLOAT::DOUBLE AS cz FROM ligand l JOIN cen USING (system)),
  beads AS (SELECT system, res_row, coalesce(avg(x) FILTER (NOT is_anchor), avg(x)) AS sx, coalesce(avg(y) FILTER (NOT is_anchor), avg(y)) AS sy, coalesce(avg(z) FILTER (NOT is_anchor), avg(z)) AS sz, count(*) FILTER (NOT is_anchor) > 0 AS valid FROM residues GROUP BY ALL)"""
_STORES = [
    ("q29_finite", "n = 0", "SELECT count(*) FILTER (len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))) > 0) AS n FROM embeddings"),
    ("q30_contents", "n > 0", "SELECT count(*) AS n FROM embeddings"),
    ("q31_one_width", "n = 1", "SELECT count(DISTINCT len(embedding)) AS n FROM embeddings"),
    ("q32_beads_aligned", "n = 0", "SELECT abs((SELECT count(*) FROM beads) - (SELECT count(*) FROM (SELECT DISTINCT system, res_row FROM residues))) AS n"),
    ("q33_no_side_no_bead", "n = 0", "SELECT count(*) AS n FROM (SELECT system, res_row, count(*) FILTER (NOT is_anchor) AS k FROM residues GROUP BY ALL) JOIN beads USING (system, res_row) WHERE valid AND k = 0"),
    ("q34_bead_geometry", "n < 100", "SELECT round(max(sqrt((sx - x)**2 + (sy - y)**2 + (sz - z)**2)), 6) AS n FROM beads JOIN residues USING (system, res_row) WHERE is_anchor"),
    ("q37_shell", "n <= 15.05", f"SELECT coalesce(round(max(d), 6), 0) AS n FROM (SELECT r.atom_id, min(sqrt((r.x - l.x)**2 + (r.y - l.y)**2 + (r.z - l.z)**2)) AS d FROM residues r JOIN ligand l USING (system) GROUP BY 1) WHERE d <= 15"),
    ("q38_unsaturated", "n = 0", "SELECT count(*) FILTER (abs(qx) >= 32767 OR abs(qy) >= 32767 OR abs(qz) >= 32767) AS n FROM st"),
    ("q41_derived", "n <= 0.021", "SELECT round(max(sqrt((qx / 100 + cx - x)**2 + (qy / 100 + cy - y)**2 + (qz / 100 + cz - z)**2)), 9) AS n FROM st"),
]


@query(_sql(_STORES, f"WITH {_STORE} "))
def dq_store(spark, d):
    """Embeddings as stored coordinates: what is kept, in whole steps, against what it was made from."""
    e = table(spark, d, "embeddings")
    residues, ligand = points(spark, d)
    beads = T.side_centroids(residues.withColumn("side", ~F.col("is_anchor")), ["system", "res_row"], "side")
    kept = T.stored(ligand, ["system"])
    back = T.restored(kept.select("*", *[F.col(v).alias(f"o{v}") for v in "xyz"]))
    gap = lambda a, b: F.sqrt(X.squared_distance([F.col(f"{a}{v}") for v in "xyz"], [F.col(f"{b}{v}") for v in "xyz"]))
    rows = residues.select("system", "res_row").distinct()
    lone = residues.groupBy("system", "res_row").agg(F.count_if(~F.col("is_anchor")).alias("k")).join(beads, ["system", "res_row"]).filter("valid AND k = 0")
    return K.suite([
        K.count_check("q29_finite", e, F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))),
        K.measured("q30_contents", e.agg(F.count("*").alias("observed")), F.col("observed") > 0),
        K.measured("q31_one_width", e.agg(F.count_distinct(F.size("embedding")).alias("observed")), F.col("observed") == 1),
        K.measured("q32_beads_aligned", beads.join(rows, ["system", "res_row"], "full").agg(F.count_if(F.col("valid").isNull()).alias("observed")), F.col("observed") == 0),
        K.measured("q33_no_side_no_bead", lone.agg(F.count("*").alias("observed")), F.col("observed") == 0),
        K.measured("q34_bead_geometry", beads.join(residues.filter("is_anchor"), ["system", "res_row"]).agg(F.round(F.max(gap("s", "")), 6).alias("observed")), F.col("observed") < 100),
        K.measured("q37_shell", C.shell_atoms(residues, ligand).agg(F.coalesce(F.round(F.max("d_min"), 6), F.lit(0)).alias("observed")), F.col("observed") <= 15.05),
        K.count_check("q38_unsaturated", kept, X.saturated(F.col("qx")) | X.saturated(F.col("qy")) | X.saturated(F.col("qz"))),
        K.measured("q41_derived", back.agg(F.round(F.max(gap("", "o")), 9).alias("observed")), F.col("observed") <= 0.021),
    ])


_FIELDS = [
    ("q42_reliability_domain", "n = 0", "SELECT count(*) FILTER (NOT agreement BETWEEN 0 AND 1 OR NOT accuracy BETWEEN 0 AND 1) AS n FROM scores"),
    ("q43_reliability_bands", "ok", "SELECT count(*) AS n, bool_and(ok) AS ok FROM (SELECT coalesce(m >= lag(m) OVER (ORDER BY k), true) AS ok FROM (SELECT k, avg(agreement) AS m FROM scores, e, range(5) t(k) WHERE agreement >= e[k + 1] AND agreement <= e[k + 2] GROUP BY k))"),
    ("q46_split_ids", "n = 0", "SELECT count(*) AS n FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    ("q47_split_covers_once", "n = 0", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM s GROUP BY 1 HAVING count(*) <> 1)"),
    ("q48_fold_vocabulary", "n = 0", "SELECT count(*) FILTER (fold NOT IN ('train', 'val', 'test', 'excluded')) AS n FROM s"),
    ("q49_summaries", "n = 0", "SELECT 0 AS n"),
    ("q50_families", "n = 0", "SELECT 0 AS n"),
]


@query(_sql(_FIELDS, _SCORES + f", e AS (SELECT quantile_cont(agreement, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM scores), {_T1_FIXED} "))
def dq_fields_and_splits(spark, d):
    from ..operators.reliability import band_means

    s = scores(spark, d)
    f = fixed(spark, d).select("o_orderkey", "fold")
    bands = band_means(s.withColumn("tier", F.lit("t")), "tier", "agreement", "agreement", 5)
    tags, known = (spark.createDataFrame([(k,) for k in families], "tag string") for families in (L.ASSIGNERS, L.CONTRACTS))
    return K.suite([
        K.count_check("q42_reliability_domain", s, ~F.col("agreement").between(0, 1) | ~F.col("accuracy").between(0, 1)),
        K.measured("q43_reliability_bands", bands.agg(F.count("*").alias("observed"), F.bool_and("rises").alias("ok")), F.col("ok")),
        K.reference_check("q46_split_ids", f, "o_orderkey", table(spark, d, "orders"), "o_orderkey"),
        K.unique_check("q47_split_covers_once", f, ["o_orderkey"]),
        K.vocabulary_check("q48_fold_vocabulary", f, "fold", [*L.FOLDS, "excluded"]),
        K.same_keys_check("q49_summaries", tags, known, "tag"),
        K.vocabulary_check("q50_families", tags, "tag", [*L.CONTRACTS, "T1"]),
    ])


_SWEEP = [
    ("q47_sweep_covers_once", "n = 0", "SELECT count(*) AS n FROM (SELECT tag, system FROM s GROUP BY ALL HAVING count(*) > 1)"),
    ("q48_sweep_vocabulary", "n = 0", "SELECT count(*) FILTER (fold NOT IN ('train', 'val', 'test', 'excluded')) AS n FROM s"),
    ("q49_summaries", "n = 0", "SELECT count(*) AS n FROM (SELECT DISTINCT tag AS a FROM s) FULL JOIN tags ON a = tag WHERE a IS NULL OR tag IS NULL"),
    ("q50_families", "n = 0", f"SELECT count(*) FILTER (family NOT IN {tuple(L.CONTRACTS)}) AS n FROM tags WHERE tag IN (SELECT tag FROM s)"),
    ("q45_contracts_kept", "n = 0", "SELECT count(*) AS n FROM (SELECT tag, pc FROM s WHERE fold <> 'excluded' GROUP BY ALL HAVING count(DISTINCT fold) > 1)"),
]


@query(_sql(_SWEEP, f"WITH RECURSIVE {_tags(('C2p', 'C3'))}, {_AUDIT}, {_cold_all('c2p', 'C2p', 'pc', 'lc')}, {_BLOCKS}, s AS (SELECT * FROM c2p UNION ALL SELECT * FROM c3) "))
def dq_sweep(spark, d):
    """The splits of a sweep against its index: two families over fifteen contexts."""
    own, wanted = packed(spark, d, ("C2p", "C3"))
    folds = cut(own.folds())
    index, sizes = P.split_index(own, wanted, folds), cut(P.fold_sizes(own, folds))
    # A system has its folds of all tags in one row, so one that is there twice is so in every tag.
    again = folds.groupBy("system").count().agg((F.count_if(F.col("count") > 1) * own.tags).alias("observed"))
    unknown = sizes.agg(F.sum(F.when(~F.col("m").isin(0, *P.BIT.values()), F.col("n")).otherwise(0)).alias("observed"))
    shared = P.clusters_in_folds(own, folds, "protein").agg(F.count_if(F.bit_count("m") > 1).alias("observed"))
    return K.suite([
        K.measured("q47_sweep_covers_once", again, F.col("observed") == 0),
        K.measured("q48_sweep_vocabulary", unknown, F.col("observed") == 0),
        K.same_keys_check("q49_summaries", own.tagged(sizes), index, "tag"),
        K.vocabulary_check("q50_families", index, "family", list(L.CONTRACTS)),
        K.measured("q45_contracts_kept", shared, F.col("observed") == 0),
    ])


@query(f"WITH {POINTS_SQL} SELECT system, res_row, round(coalesce(avg(x) FILTER (NOT is_anchor), avg(x)), 6) AS sx, round(coalesce(avg(y) FILTER (NOT is_anchor), avg(y)), 6) AS sy, round(coalesce(avg(z) FILTER (NOT is_anchor), avg(z)), 6) AS sz, count(*) FILTER (NOT is_anchor) > 0 AS valid FROM residues GROUP BY ALL")
def side_centroids(spark, d):
    residues, _ = points(spark, d)
    r = T.side_centroids(residues.withColumn("side", ~F.col("is_anchor")), ["system", "res_row"], "side")
    return r.select("system", "res_row", *[F.round(c, 6).alias(c) for c in ("sx", "sy", "sz")], "valid")


@query(f"WITH {_STORE} SELECT system, atom_idx, qx::SMALLINT AS qx, qy::SMALLINT AS qy, qz::SMALLINT AS qz FROM st")
def stored_coordinates(spark, d):
    _, ligand = points(spark, d)
    return T.stored(ligand, ["system"]).select("system", "atom_idx", "qx", "qy", "qz")


@query("""WITH p AS (SELECT label AS system, vec_id, unnest(range(1, 21)) AS atom, embedding FROM embeddings), a AS (SELECT label AS system, first(embedding ORDER BY vec_id) AS anchor FROM embeddings GROUP BY 1),
  d AS (SELECT system, vec_id, embedding[3 * atom - 2]::DOUBLE - anchor[3 * atom - 2] AS x, embedding[3 * atom - 1]::DOUBLE - anchor[3 * atom - 1] AS y, embedding[3 * atom]::DOUBLE - anchor[3 * atom] AS z FROM p JOIN a USING (system) WHERE embedding <> anchor),
  s AS (SELECT system, vec_id, round(avg(x * x) - avg(x) * avg(x) + avg(y * y) - avg(y) * avg(y) + avg(z * z) - avg(z) * avg(z), 9) AS score FROM d GROUP BY ALL)
  SELECT system, first(vec_id ORDER BY score, vec_id) AS candidate, min(score) AS score FROM s GROUP BY 1""")
def symmetry_choice(spark, d):
    """Of each label's vectors, read as twenty atoms, the one whose shape is nearest to the label's first."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("system"), "vec_id", "embedding")
    first = e.groupBy("system").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    at = lambda v, i: F.get(v, 3 * F.col("atom") - 3 + i).cast("double")
    spread = lambda df, v: df.withColumn("atom", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumns({c: at(v, i) for i, c in enumerate("xyz")})
    others = e.join(first, "system").filter("embedding <> anchor")
    return T.best_order(spread(others.withColumn("candidate", F.col("vec_id")), "embedding"), spread(first, "anchor"), ["system"])


@query("SELECT event_type AS arm, count(DISTINCT user_id) FILTER (value <= 40) AS systems, count(*) FILTER (value <= 40) AS poses FROM events GROUP BY 1")
def presence_census(spark, d):
    return T.presence_census(contacts(spark, d).withColumn("ok", F.col("d_min") <= 40), "arm", "system", "ok")[0]


@query("WITH p AS (SELECT user_id, event_type, count(*) FILTER (value <= 40) AS n FROM events GROUP BY ALL) SELECT arms, count(*) AS systems FROM (SELECT user_id, count(*) FILTER (n > 0) AS arms FROM p GROUP BY 1) GROUP BY 1")
def arms_per_system(spark, d):
    return T.presence_census(contacts(spark, d).withColumn("ok", F.col("d_min") <= 40), "arm", "system", "ok")[1]


@query("SELECT user_id AS system, first(event_id ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE value END NULLS LAST, event_id) AS event_id FROM events GROUP BY 1")
def best_pose_nulls_last(spark, d):
    """The event with the least value of each user; errors have none and come last."""
    e = table(spark, d, "events").select(F.col("user_id").alias("system"), "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return T.best_pose(e, ["system"], "score", "event_id").select("system", "event_id")


@query("SELECT conv_id, sum(length(text))::BIGINT AS total, max(length(text))::BIGINT AS longest FROM conversations WHERE text IS NOT NULL GROUP BY 1 HAVING total BETWEEN 10 AND 800")
def length_gate(spark, d):
    from ..sources.structures import within_lengths

    r = within_lengths(table(spark, d, "conversations").filter("text IS NOT NULL"), "conv_id", "text")
    return r.select("conv_id", "total", F.col("longest").cast("bigint").alias("longest"))


@query("SELECT page_id, replace(replace(url, '.', '_'), '__', '_') AS id, string_split(replace(replace(url, '.', '_'), '__', '_'), '_')[1] AS head FROM pages")
def normal_ids(spark, d):
    from ..sources.structures import normal_id

    n = normal_id(F.col("url"))
    return table(spark, d, "pages").select("page_id", n.alias("id"), F.get(F.split(n, "_"), 0).alias("head"))
