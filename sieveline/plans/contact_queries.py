"""Contacts, support and agreement over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import agreement as A
from ..operators import contacts as C
from .fixtures import ARMS, CONTACTS_SQL, POINTS_SQL, SETS_SQL, TRUTH, contacts, points, sets, table

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


_HALF = "CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / pow(2, greatest(floor(log2({x})), -14) - 10), 0) * pow(2, greatest(floor(log2({x})), -14) - 10) END"


@query("SELECT event_id, " + _HALF.format(x="value") + " AS half FROM events")
def half_grid(spark, d):
    return table(spark, d, "events").select("event_id", X.half_grid(F.col("value")).alias("half"))


@query("SELECT event_id, q, q / 100.0 + 245 AS back, abs(q) >= 32767 AS clipped FROM (SELECT event_id, least(greatest(round_even((value * 2 - 245) * 100, 0), -32768), 32767)::SMALLINT AS q FROM events)")
def quantise_roundtrip(spark, d):
    q = X.quantise(F.col("value") * 2, F.lit(245))
    rows = table(spark, d, "events").select("event_id", q.alias("q"))
    return rows.select("event_id", "q", X.dequantise(F.col("q"), F.lit(245)).alias("back"), X.saturated(F.col("q")).alias("clipped"))


@query(f"WITH {CONTACTS_SQL}, h AS (SELECT arm, {_HALF.format(x='d_min')} AS d FROM contacts) SELECT arm, count(*) AS n, count(*) FILTER (d <= 4) AS n4, count(*) FILTER (d <= 5) AS n5, count(*) FILTER (d <= 8) AS n8 FROM h GROUP BY arm")
def contact_flags(spark, d):
    rows = C.flags(contacts(spark, d))
    return rows.groupBy("arm").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"contact_{t}")).alias(f"n{t}") for t in (4, 5, 8)])


@query(f"WITH {SETS_SQL} SELECT * FROM sets")
def contact_sets(spark, d):
    return sets(spark, d)


@query(f"WITH {SETS_SQL} SELECT system, res_row, count(DISTINCT arm) AS n_arms_asserting FROM sets WHERE arm IN ('click', 'view', 'purchase') GROUP BY ALL")
def support_counts(spark, d):
    return C.support(sets(spark, d), ARMS)


@query(f"""WITH {SETS_SQL}, cohort AS (SELECT system FROM sets WHERE arm IN ('click', 'view', 'purchase', 'signup') GROUP BY system HAVING count(DISTINCT arm) = 4),
  r AS (SELECT system, res_row, count(DISTINCT CASE WHEN arm IN ('click', 'view', 'purchase') THEN arm END) AS support, max((arm = 'signup')::INT) AS t FROM sets WHERE system IN (SELECT system FROM cohort) GROUP BY ALL),
  tot AS (SELECT sum(t) AS all_true, sum(t) FILTER (support > 0) AS found, count(*) FILTER (support > 0) AS all_rows FROM r)
  SELECT support, count(*) AS n_rows, sum(t) / count(*) AS precision, count(*) / any_value(all_rows) AS row_share, any_value(found) / any_value(all_true) AS union_recall FROM r, tot WHERE support > 0 GROUP BY support""")
def support_gradient(spark, d):
    return C.support_gradient(sets(spark, d), ARMS, TRUTH)


@query(f"WITH {CONTACTS_SQL} SELECT arm, system, res_row, min(d_min) AS d_min FROM contacts GROUP BY ALL")
def residue_minimum(spark, d):
    return C.residue_minimum(contacts(spark, d))


@query(f"WITH {CONTACTS_SQL} SELECT arm, system, res_row, d_min FROM contacts")
def ragged_roundtrip(spark, d):
    return C.unpacked(C.packed(contacts(spark, d)))


_DIST = f"""WITH {POINTS_SQL}, p AS (SELECT r.system, res_row, atom_idx, is_anchor, sqrt((r.x - l.x) * (r.x - l.x) + (r.y - l.y) * (r.y - l.y) + (r.z - l.z) * (r.z - l.z)) AS d FROM residues r JOIN ligand l USING (system))
  SELECT system, res_row, atom_idx, round(min(d), 6) AS d_min, round(min(d) FILTER (is_anchor), 6) AS d_anchor FROM p GROUP BY ALL HAVING min(d) <= 3"""


def _rounded(df):
    return df.select("system", "res_row", "atom_idx", F.round("d_min", 6).alias("d_min"), F.round("d_anchor", 6).alias("d_anchor"))


@query(_DIST)
def distance_join(spark, d):
    return _rounded(C.distance_join(*points(spark, d), cutoff=3.0))


@query(_DIST)
def distance_join_grid(spark, d):
    return _rounded(C.distance_join_grid(*points(spark, d), cutoff=3.0))


@query(f"""WITH {POINTS_SQL}, c AS (SELECT system, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ligand GROUP BY system),
  a AS (SELECT r.system, res_row, sqrt((r.x - c.x) * (r.x - c.x) + (r.y - c.y) * (r.y - c.y) + (r.z - c.z) * (r.z - c.z)) AS d FROM residues r JOIN c USING (system) WHERE is_anchor),
  rad AS (SELECT system, max(d) AS radius FROM a WHERE res_row % 10 = 0 GROUP BY system)
  SELECT system, res_row, round(d, 6) AS d FROM a JOIN rad USING (system) WHERE d <= 1.5 * radius""")
def pocket_extension(spark, d):
    residues, ligand = points(spark, d)
    anchors = residues.filter("is_anchor")
    centre = ligand.groupBy("system").agg(*[F.avg(c).alias(c) for c in "xyz"])
    pocket = anchors.filter("res_row % 10 = 0").select("system", "res_row")
    return C.pocket_extension(anchors, pocket, centre).withColumn("d", F.round("d", 6))


@query(f"""WITH {POINTS_SQL} SELECT r.system, atom_id, round(min(sqrt((r.x - l.x) * (r.x - l.x) + (r.y - l.y) * (r.y - l.y) + (r.z - l.z) * (r.z - l.z))), 6) AS d_min
  FROM residues r JOIN ligand l USING (system) GROUP BY ALL HAVING d_min <= 2""")
def shell_atoms(spark, d):
    residues, ligand = points(spark, d)
    return C.shell_atoms(residues, ligand, 2.0).withColumn("d_min", F.round("d_min", 6))


_FLAT = f"""WITH {SETS_SQL}, f AS (SELECT system, res_row, max((arm = 'click')::INT) AS c, max((arm = 'purchase')::INT) AS p, max((arm = 'view')::INT) AS v, max((arm = 'signup')::INT) AS t FROM sets GROUP BY ALL)"""


@query(_FLAT + " SELECT system, round(sum(c * p) / nullif(sum(greatest(c, p)), 0), 9) AS j_click_purchase, round(sum(c * v) / nullif(sum(greatest(c, v)), 0), 9) AS j_click_view, round(sum(p * v) / nullif(sum(greatest(p, v)), 0), 9) AS j_purchase_view FROM f GROUP BY system")
def jaccard_pairwise(spark, d):
    rows = A.jaccard_pairs(sets(spark, d), ARMS)
    return rows.select("system", *[F.round(c, 9).alias(c) for c in rows.columns[1:]])


@query(f"WITH {CONTACTS_SQL}, f AS (SELECT system, res_row, max((arm = 'click')::INT) AS c, max((arm = 'view')::INT) AS v FROM contacts WHERE d_min <= 8 GROUP BY ALL) SELECT system, round(sum(c * v) / nullif(sum(greatest(c, v)), 0), 9) AS j_null, round(coalesce(sum(c * v) / nullif(sum(greatest(c, v)), 0), 0), 9) AS j_zero FROM f GROUP BY system")
def jaccard_variants(spark, d):
    few = C.asserted(contacts(spark, d), 8.0)
    name = "j_click_view"
    a, b = (A.jaccard_pairs(few, ["click", "view"], e).withColumnRenamed(name, n) for e, n in ((None, "j_null"), (0.0, "j_zero")))
    return a.join(b, "system").select("system", F.round("j_null", 9).alias("j_null"), F.round("j_zero", 9).alias("j_zero"))


_SCORES = _FLAT + """, scores AS (SELECT system, (sum(c * p) / sum(greatest(c, p)) + sum(c * v) / sum(greatest(c, v)) + sum(p * v) / sum(greatest(p, v))) / 3 AS agreement,
  (sum(c * t) / sum(greatest(c, t)) + sum(p * t) / sum(greatest(p, t)) + sum(v * t) / sum(greatest(v, t))) / 3 AS accuracy FROM f GROUP BY system HAVING max(c) = 1 AND max(p) = 1 AND max(v) = 1 AND max(t) = 1)"""


def scores(spark, d):
    return A.agreement_accuracy(sets(spark, d), ARMS, TRUTH)


@query(_SCORES + " SELECT system, round(agreement, 9) AS agreement, round(accuracy, 9) AS accuracy FROM scores")
def agreement_accuracy(spark, d):
    return scores(spark, d).select("system", F.round("agreement", 9).alias("agreement"), F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {SETS_SQL}, m AS (SELECT system, max((arm = 'click')::INT) + 2 * max((arm = 'purchase')::INT) + 4 * max((arm = 'view')::INT) AS mask FROM sets WHERE arm IN ('click', 'view', 'purchase') GROUP BY system) SELECT mask, count(*) AS n_systems FROM m GROUP BY mask")
def coverage_sets(spark, d):
    return A.coverage(sets(spark, d), ARMS)


@query(f"WITH {SETS_SQL} SELECT system FROM sets WHERE arm = 'click' INTERSECT SELECT system FROM sets WHERE arm = 'view' INTERSECT SELECT system FROM sets WHERE arm = 'purchase'")
def covered_by_all(spark, d):
    return A.covered_by_all(sets(spark, d), ARMS)


@query(f"""WITH {SETS_SQL}, p AS (SELECT system, count(DISTINCT arm) FILTER (arm IN ('click', 'view', 'purchase')) AS n, max((arm = 'signup')::INT) AS t FROM sets GROUP BY system)
  SELECT count(*) AS any_arm, count(*) FILTER (n = 3) AS core, count(*) FILTER (t = 1) AS annotated, count(*) FILTER (n = 3 AND t = 1) AS core_annotated, count(*) FILTER (n < 3 AND t = 1) AS annotated_only FROM p""")
def cohort_chain(spark, d):
    return A.cohort_chain(sets(spark, d), ARMS, TRUTH)


@query(_SCORES + " SELECT t.threshold, count(*) FILTER (agreement >= threshold) AS n_kept, round(avg(accuracy) FILTER (agreement >= threshold), 9) AS mean_accuracy, round(count(*) FILTER (agreement >= threshold) / count(*) * 100, 6) AS percent_kept FROM scores, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS threshold) t GROUP BY t.threshold")
def filter_table(spark, d):
    rows = A.filter_table(scores(spark, d), [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5])
    return rows.select("threshold", "n_kept", F.round("mean_accuracy", 9).alias("mean_accuracy"), F.round("percent_kept", 6).alias("percent_kept"))


@query(_SCORES + ", r AS (SELECT *, row_number() OVER (ORDER BY agreement DESC, system) AS r, count(*) OVER () AS n FROM scores) SELECT fraction, count(*) FILTER (r <= greatest(floor(fraction * n), 1)) AS n_top, round(avg(accuracy) FILTER (r <= greatest(floor(fraction * n), 1)) / avg(accuracy), 6) AS enrichment FROM r, (SELECT unnest([0.05, 0.1, 0.2, 0.5])::DOUBLE AS fraction) GROUP BY fraction")
def enrichment(spark, d):
    return A.enrichment(scores(spark, d), [0.05, 0.1, 0.2, 0.5]).withColumn("enrichment", F.round("enrichment", 6))


@query("SELECT CASE WHEN value < 1 THEN 0 WHEN value < 2 THEN 1 WHEN value < 5 THEN 2 ELSE 3 END AS band, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def offset_bands(spark, d):
    return A.offset_bands(table(spark, d, "events"), "value", [0, 1, 2, 5]).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {CONTACTS_SQL}, f AS (SELECT system, res_row, min(d_min) FILTER (arm = 'click') AS a, min(d_min) FILTER (arm = 'signup') AS b FROM contacts WHERE arm IN ('click', 'signup') AND d_min <= 150 GROUP BY ALL)
  SELECT system, round(avg((a IS NOT NULL AND b IS NOT NULL)::INT), 9) AS j_wide, round(coalesce(count(*) FILTER (a <= 50 AND b <= 50) / nullif(count(*) FILTER (coalesce(a <= 50, false) OR coalesce(b <= 50, false)), 0), 0), 9) AS j_narrow, round(avg(abs(a - b)), 9) AS mean_gap FROM f GROUP BY system""")
def contact_similarity(spark, d):
    r = A.contact_similarity(contacts(spark, d), "click", TRUTH, 150, 50)
    return r.select("system", *[F.round(c, 9).alias(c) for c in ("j_wide", "j_narrow", "mean_gap")])
