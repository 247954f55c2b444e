"""Out-of-fold calibration, intervals and transfer over the fixtures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.exprs import stable_fold
from ..operators import calibration as B
from ..operators import shift as M
from .contact_queries import _SCORES, scores
from .fixtures import ARMS, SETS_SQL, contacts, sets, table

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


def isotonic_sql(train: str, x: str, y: str, by: str) -> str:
    """CTEs: fit(by, x, p), the isotonic means of y at each x of train, by the formula of largest least means."""
    return f"""g0 AS (SELECT {by} AS by_, {x} AS x, count(*) AS w, sum({y}) AS s FROM {train} GROUP BY ALL),
  g1 AS (SELECT by_, x, row_number() OVER (PARTITION BY by_ ORDER BY x) AS r, sum(w) OVER (PARTITION BY by_ ORDER BY x) AS w1, sum(s) OVER (PARTITION BY by_ ORDER BY x) AS s1, w, s FROM g0),
  g2 AS (SELECT a.by_, a.r AS i, b.r AS j, (b.s1 - a.s1 + a.s) / (b.w1 - a.w1 + a.w) AS m FROM g1 a JOIN g1 b ON a.by_ = b.by_ AND a.r <= b.r),
  g3 AS (SELECT by_, i, j, min(m) OVER (PARTITION BY by_, i ORDER BY j DESC) AS m FROM g2),
  fit AS (SELECT g3.by_, x, max(m) AS p FROM g3 JOIN g1 ON g1.by_ = g3.by_ AND g1.r = g3.j GROUP BY g3.by_, x)"""


def applied_sql(rows: str, x: str, by: str) -> str:
    """CTE scored: rows with predicted, linear between the points of fit and flat outside."""
    return f"""scored AS (SELECT t.*, CASE WHEN lo.x IS NULL THEN hi.p WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.p ELSE lo.p + (hi.p - lo.p) * (t.{x} - lo.x) / (hi.x - lo.x) END AS predicted FROM {rows} t
    LEFT JOIN LATERAL (SELECT x, p FROM fit WHERE by_ = t.{by} AND fit.x <= t.{x} ORDER BY x DESC LIMIT 1) lo ON true LEFT JOIN LATERAL (SELECT x, p FROM fit WHERE by_ = t.{by} AND fit.x >= t.{x} ORDER BY x LIMIT 1) hi ON true)"""


_FOLDS = "n AS (SELECT system % 40 AS protein, count(*) AS n FROM scores GROUP BY 1), o AS (SELECT protein, n, row_number() OVER (ORDER BY n DESC, protein) AS r FROM n), " + """deal AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS protein, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
    UNION ALL SELECT o.r, o.protein, list_position(load, list_min(load)) - 1, list_transform(load, lambda v, i: CASE WHEN i = list_position(load, list_min(load)) THEN v + o.n ELSE v END) FROM deal JOIN o ON o.r = deal.r + 1),
  ff AS (SELECT scores.*, system % 40 AS protein, fold::INT AS fold FROM scores JOIN (SELECT protein, fold FROM deal WHERE r > 0) d ON d.protein = system % 40)"""
_OOF = f"{_SCORES}, {_FOLDS}, train AS (SELECT k AS k, agreement, accuracy FROM ff, range(5) t(k) WHERE fold <> k), {isotonic_sql('train', 'agreement', 'accuracy', 'k')}, {applied_sql('ff', 'agreement', 'fold')}, c AS (SELECT k, avg(accuracy) AS constant FROM train GROUP BY k)".replace("WITH ", "WITH RECURSIVE ", 1)


def grouped(spark, d):
    """Scores with the fold of their protein, of which there are forty."""
    s = scores(spark, d).withColumn("protein", F.col("system") % 40)
    return s.join(B.balanced_folds(s, "protein", 5), "protein")


@query(_OOF + " SELECT DISTINCT protein, fold FROM ff")
def grouped_folds(spark, d):
    return grouped(spark, d).select("protein", "fold").distinct()


@query(_OOF + " SELECT system, fold, round(predicted, 8) AS predicted, round(constant, 8) AS constant FROM scored JOIN c ON c.k = fold")
def out_of_fold_isotonic(spark, d):
    r = B.out_of_fold(grouped(spark, d), "agreement", "accuracy")
    return r.select("system", "fold", F.round("predicted", 8).alias("predicted"), F.round("constant", 8).alias("constant"))


@query(_OOF + ", m AS (SELECT count(*) AS n, avg(abs(accuracy - predicted)) AS a, avg(abs(accuracy - constant)) AS b FROM scored JOIN c ON c.k = fold) SELECT n, round(a, 8) AS mae, round(b, 8) AS mae_constant, round(1 - a / b, 8) AS skill FROM m")
def calibration_skill(spark, d):
    r = B.skill(B.out_of_fold(grouped(spark, d), "agreement", "accuracy"), "accuracy")
    return r.select("n", *[F.round(c, 8).alias(c) for c in ("mae", "mae_constant", "skill")])


@query("SELECT o_orderpriority AS name, round((30000.0 - v) / (30000.0 - 20000.0), 9) AS retained, CASE WHEN low >= 0.8 THEN 'robust' WHEN (30000.0 - v) / (30000.0 - 20000.0) >= 0.5 THEN 'partial' ELSE 'weak' END AS verdict FROM (SELECT o_orderpriority, avg(o_totalprice) / 6 AS v, min(o_totalprice) / 1200 AS low FROM orders GROUP BY 1)")
def retained_skill(spark, d):
    """What a variant keeps of the full map's gain: 20,000 stands for the full map's error, 30,000 for the constant's."""
    r = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.avg("o_totalprice") / 6).alias("v"), (F.min("o_totalprice") / 1200).alias("low"))
    share = B.retained(F.lit(20000.0), F.lit(30000.0), F.col("v"))
    return r.select("name", F.round(share, 9).alias("retained"), B.verdict(share, F.col("low")).alias("verdict"))


@query(_SCORES.replace("WITH ", "WITH RECURSIVE ", 1) + f", rows_ AS (SELECT *, system % 3 <> 0 AS before, 1 AS one FROM scores), train AS (SELECT 1 AS k, agreement, accuracy FROM rows_ WHERE before), {isotonic_sql('train', 'agreement', 'accuracy', 'k')}, {applied_sql('rows_', 'agreement', 'one')} SELECT CASE WHEN before THEN 'before' ELSE 'after' END AS era, count(*) AS n, round(avg(abs(accuracy - predicted)), 8) AS mae, round(avg(abs(accuracy - (SELECT avg(accuracy) FROM train))), 8) AS mae_constant FROM scored GROUP BY 1")
def era_transfer(spark, d):
    r = B.transfer(scores(spark, d), "agreement", "accuracy", F.col("system") % 3 != 0)
    return r.select("era", "n", F.round("mae", 8).alias("mae"), F.round("mae_constant", 8).alias("mae_constant"))


@query(_SCORES.replace("WITH ", "WITH RECURSIVE ", 1) + f", rows_ AS (SELECT *, ('0x' || substr(md5('half|' || system), 1, 7))::BIGINT % 2 AS half, 1 AS one FROM scores), train AS (SELECT 1 AS k, agreement, accuracy FROM rows_ WHERE half = 0), {isotonic_sql('train', 'agreement', 'accuracy', 'k')}, {applied_sql('rows_', 'agreement', 'one')} SELECT system, half::INT AS half, round(predicted, 8) AS predicted FROM scored")
def isotonic_fit(spark, d):
    """Learned on one half of the systems, applied to all."""
    s = scores(spark, d).withColumn("half", stable_fold(F.col("system"), "half", 2))
    return B.isotonic_predictions(s.filter("half = 0"), s, "agreement", "accuracy").select("system", "half", F.round("predicted", 8).alias("predicted"))


def _weights() -> str:
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += term
        steps.append(f"(u >= {total!r}::DOUBLE)::INT")
        term /= k + 1
    return " + ".join(steps)


_B = f"boot AS (SELECT b, system, {_weights()} AS w FROM (SELECT b, system, ('0x' || substr(md5(b || '|' || system), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM range(1, 201) t(b), (SELECT DISTINCT system FROM keys)))"


@query(_SCORES + f", keys AS (SELECT system FROM scores), {_B}, m AS (SELECT b, sum(w * accuracy) / sum(w) AS m FROM boot JOIN scores USING (system) GROUP BY b) SELECT round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m")
def bootstrap_interval(spark, d):
    return M.bootstrap_mean(scores(spark, d), "accuracy", "system").select(F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query(_SCORES + f""", keys AS (SELECT system FROM scores), {_B}, m AS (SELECT b, sum(w * accuracy) FILTER (system % 2 = 1) / nullif(sum(w) FILTER (system % 2 = 1), 0) - sum(w * accuracy) FILTER (system % 2 = 0) / nullif(sum(w) FILTER (system % 2 = 0), 0) AS r FROM boot JOIN scores USING (system) GROUP BY b), i AS (SELECT quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM m)
  SELECT round(avg(accuracy) FILTER (system % 2 = 1) - avg(accuracy) FILTER (system % 2 = 0), 8) AS difference, round(any_value(low), 8) AS low, round(any_value(high), 8) AS high, any_value(low) > 0 OR any_value(high) < 0 AS excludes_zero FROM scores, i""")
def bootstrap_difference(spark, d):
    r = B.bootstrap_difference(scores(spark, d).withColumn("odd", F.col("system") % 2), "system", "accuracy", "odd")
    return r.select(*[F.round(c, 8).alias(c) for c in ("difference", "low", "high")], "excludes_zero")


_LEVELS = f"""{SETS_SQL}, cohort AS (SELECT system FROM sets WHERE arm IN ('click', 'view', 'purchase', 'signup') GROUP BY system HAVING count(DISTINCT arm) = 4),
  r AS (SELECT system, res_row, count(DISTINCT CASE WHEN arm IN ('click', 'view', 'purchase') THEN arm END) AS support, max((arm = 'signup')::INT) AS t FROM sets WHERE system IN (SELECT system FROM cohort) GROUP BY ALL),
  per AS (SELECT system, support, sum(t) AS n, count(*) AS d FROM r WHERE support > 0 GROUP BY ALL), keys AS (SELECT system FROM per)"""


@query(f"WITH {_LEVELS}, {_B}, m AS (SELECT b, support, sum(w * n) / nullif(sum(w * d), 0) AS r FROM boot JOIN per USING (system) GROUP BY ALL), i AS (SELECT support, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM m GROUP BY 1), s AS (SELECT support, sum(n) / sum(d) AS ratio FROM per GROUP BY 1) SELECT support, round(ratio, 8) AS precision, round(low, 8) AS low, round(high, 8) AS high FROM s JOIN i USING (support)")
def support_intervals(spark, d):
    """Precision by level of support with intervals from resampled systems."""
    all_ = sets(spark, d).filter(F.col("arm").isin([*ARMS, "signup"]))
    cohort = all_.groupBy("system").agg(F.count_distinct("arm").alias("n")).filter("n = 4").select("system")
    rows = sets(spark, d).join(cohort, "system", "left_semi").groupBy("system", "res_row").agg(F.count_distinct(F.when(F.col("arm").isin(ARMS), F.col("arm"))).alias("support"), F.max((F.col("arm") == "signup").cast("int")).alias("t"))
    r = B.bootstrap_ratio(rows.filter("support > 0").withColumn("one", F.lit(1)), "system", "t", "one", ["support"])
    return r.select("support", F.round("ratio", 8).alias("precision"), F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query(f"WITH {SETS_SQL}, per AS (SELECT system, count(*) AS d, sum((t AND near)::INT) AS n FROM (SELECT system, res_row, bool_or(arm = 'signup' AND d_min <= 40) AS t, bool_or(d_min <= 150) AS near FROM contacts GROUP BY ALL) WHERE near GROUP BY 1), keys AS (SELECT system FROM per), {_B}, m AS (SELECT b, sum(w * n) / sum(w * d) AS r FROM boot JOIN per USING (system) GROUP BY b) SELECT round((SELECT sum(n) / sum(d) FROM per), 8) AS base_rate, round(quantile_cont(r, 0.025), 8) AS low, round(quantile_cont(r, 0.975), 8) AS high FROM m")
def base_rate(spark, d):
    """Of the residues near the ligand by any arm, the share that the truth asserts."""
    near = contacts(spark, d).groupBy("system", "res_row").agg(F.bool_or((F.col("arm") == "signup") & (F.col("d_min") <= 40)).cast("int").alias("t"), F.bool_or(F.col("d_min") <= 150).alias("near"))
    r = B.bootstrap_ratio(near.filter("near").withColumn("one", F.lit(1)), "system", "t", "one", [])
    return r.select(F.round("ratio", 8).alias("base_rate"), F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query(_SCORES + ', e AS (SELECT quantile_cont(agreement, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM scores), h AS (SELECT quantile_cont(abs(accuracy - agreement), 0.9) AS h FROM scores) SELECT len(list_filter(e, lambda x: x < agreement))::INT AS "group", count(*) AS n, round(avg((abs(accuracy - agreement) <= h)::INT), 8) AS covered FROM scores, e, h GROUP BY 1')
def coverage_by_decile(spark, d):
    r = scores(spark, d).withColumn("residual", F.abs(F.col("accuracy") - F.col("agreement")))
    h = r.agg(F.percentile("residual", 0.9).alias("h"))
    return B.coverage_by_group(r, "agreement", "residual", h).withColumn("covered", F.round("covered", 8))


@query()
def density_ratio(spark, d):
    """How much likelier open orders' prices are than filled ones', and what sample size is left."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    w = B.density_ratio(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_totalprice")
    return w.agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean"), F.round(F.sum("weight") ** 2 / F.sum(F.col("weight") ** 2), 2).alias("effective"))
