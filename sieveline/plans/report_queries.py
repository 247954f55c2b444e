"""Quality checks, summaries, the work log and text parsing over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import checks as K
from ..operators import summary as S
from ..operators import worklog as W
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


@query("""SELECT 'events_unique' AS "check", n = 0 AS passed, n::DOUBLE AS observed FROM (SELECT count(*) AS n FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'lines_unique', n = 0, n::DOUBLE FROM (SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  UNION ALL SELECT 'orders_have_customers', n = 0, n::DOUBLE FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
  UNION ALL SELECT 'lines_have_orders', n = 0, n::DOUBLE FROM (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'value_domain', n = 0, n::DOUBLE FROM (SELECT count(*) FILTER (value IS NULL OR isnan(value) OR value < 0 OR value > 500) AS n FROM events)
  UNION ALL SELECT 'event_vocabulary', n = 0, n::DOUBLE FROM (SELECT count(*) FILTER (event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')) AS n FROM events)
  UNION ALL SELECT 'one_region_name', n = 1, n::DOUBLE FROM (SELECT count(DISTINCT r_name) AS n FROM region WHERE r_regionkey = 1)
  UNION ALL SELECT 'flags_disjoint', n = 0, n::DOUBLE FROM (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'))
  UNION ALL SELECT 'no_local_paths', n = 0, n::DOUBLE FROM (SELECT count(*) FILTER (regexp_matches(url, '/(home|Users)/')) AS n FROM pages)
  UNION ALL SELECT 'same_schema', true, 1.0""")
def dq_suite(spark, d):
    t = {n: table(spark, d, n) for n in ("events", "lineitem", "orders", "customer", "region", "pages")}
    lines = t["lineitem"]
    return K.suite([
        K.unique_check("events_unique", t["events"], ["event_id"]),
        K.unique_check("lines_unique", lines, ["l_orderkey", "l_linenumber"]),
        K.reference_check("orders_have_customers", t["orders"], "o_custkey", t["customer"], "c_custkey"),
        K.reference_check("lines_have_orders", lines, "l_orderkey", t["orders"], "o_orderkey"),
        K.count_check("value_domain", t["events"], F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0) | (F.col("value") > 500)),
        K.vocabulary_check("event_vocabulary", t["events"], "event_type", ["click", "error", "purchase", "signup", "view"]),
        K.constant_check("one_region_name", t["region"].filter("r_regionkey = 1"), "r_name"),
        K.disjoint_check("flags_disjoint", lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"), "l_orderkey"),
        K.count_check("no_local_paths", t["pages"], F.col("url").rlike("/(home|Users)/")),
        K.schema_check("same_schema", t["orders"].filter("o_orderkey < 10"), t["orders"]),
    ])


CLAIMS = [K.Claim("sizes", "regions", 5), K.Claim("sizes", "nations", 25), K.Claim("values", "mean_quantity", 25, 2), K.Claim("values", "mean_tax", 1.0, 0.1), K.Claim("manual", "wall_clock", 80)]


@query("""WITH f AS (SELECT 'regions' AS name, count(*)::DOUBLE AS value FROM region UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'mean_quantity', avg(l_quantity) FROM lineitem UNION ALL SELECT 'mean_tax', avg(l_tax) FROM lineitem),
  c AS (SELECT * FROM (VALUES ('sizes', 'regions', 5.0, 0.0), ('sizes', 'nations', 25.0, 0.0), ('values', 'mean_quantity', 25.0, 2.0), ('values', 'mean_tax', 1.0, 0.1), ('manual', 'wall_clock', 80.0, 0.0)) v(section, name, quoted, tolerance))
  SELECT section, name, quoted::DOUBLE AS quoted, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'manual' WHEN abs(value - quoted) <= tolerance THEN 'pass' ELSE 'fail' END AS status FROM c LEFT JOIN f USING (name)""")
def claims_report(spark, d):
    one = lambda t, name, c: table(spark, d, t).agg(c.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    figures = one("region", "regions", F.count("*")).unionByName(one("nation", "nations", F.count("*"))).unionByName(one("lineitem", "mean_quantity", F.avg("l_quantity"))).unionByName(one("lineitem", "mean_tax", F.avg("l_tax")))
    return K.claims_report(figures, CLAIMS).withColumn("value", F.round("value", 6))


@query("SELECT 'doc_id' AS \"column\", count(doc_id) AS populated, count(*) AS total FROM t UNION ALL SELECT 'quality', count(quality), count(*) FROM t UNION ALL SELECT 'toxic', count(toxic), count(*) FROM t".replace("FROM t", "FROM (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"))
def null_accounting(spark, d):
    return K.null_census(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS median, avg((o_totalprice < 100000)::INT) AS share_below FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def stratified_summary(spark, d):
    return S.stratified(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", 100000)


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.95), 6) AS p95, max(c_acctbal) AS largest FROM customer GROUP BY 1")
def spread_by_group(spark, d):
    r = S.spread(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    return r.select("c_mktsegment", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "largest")


@query("SELECT DISTINCT p_size, cume_dist() OVER (ORDER BY p_size) AS at_most, cume_dist() OVER (ORDER BY p_size DESC) AS at_least FROM part")
def ecdf(spark, d):
    return S.ecdf(table(spark, d, "part"), "p_size")


@query("SELECT floor(value / 25)::BIGINT AS bin, count(*) AS n, count(*) / (SELECT count(*) FROM events) / 25 AS density FROM events GROUP BY 1")
def histogram(spark, d):
    return S.histogram(table(spark, d, "events"), "value", 25.0)


@query("SELECT bin, round(pow(10, bin / 4), 6) AS low, n, round(n / total / (pow(10, (bin + 1) / 4) - pow(10, bin / 4)), 9) AS density FROM (SELECT floor(round(log10(value) * 4, 9))::BIGINT AS bin, count(*) AS n FROM events WHERE value > 0 GROUP BY 1), (SELECT count(*) FILTER (value > 0) AS total FROM events)")
def log_histogram(spark, d):
    r = S.log_histogram(table(spark, d, "events"), "value", 4)
    return r.select("bin", F.round("low", 6).alias("low"), "n", F.round("density", 9).alias("density"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def smallest_values(spark, d):
    """The five least; a report of so many rows."""
    return S.smallest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 5)


@query("SELECT event_id, x FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events) WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)")
def finite_rows(spark, d):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return S.finite(table(spark, d, "events").select("event_id", x.alias("x")), ["x"])


@query("SELECT event_type AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def failure_reasons(spark, d):
    return W.reasons(log(spark, d), "status").withColumn("share", F.round("share", 9))


@query("SELECT count(*) AS jobs, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(max(s), 6) AS longest FROM (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events GROUP BY user_id)")
def wall_times(spark, d):
    r = W.wall_times(log(spark, d), "user_id", "ts")
    return r.select("jobs", *[F.round(c, 6).alias(c) for c in ("mean", "median", "longest")])


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last, count(*) AS attempts FROM events GROUP BY 1)
  SELECT user_id, status, attempts FROM l WHERE status IN ('error', 'signup') AND attempts < 70 AND epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last) >= least(86400.0, 60.0 * pow(1.2, attempts - 1)) * 1000000""")
def retry_after_backoff(spark, d):
    r = W.due(W.latest(log(spark, d), "user_id", "ts", "event_id"), "2024-02-01", 60, 1.2, 86400, 70, ("error", "signup"))
    return r.select("user_id", "status", "attempts")


@query("SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY 1")
def value_shares(spark, d):
    return S.shares(table(spark, d, "documents"), "lang")


@query("SELECT count(*) FILTER (l_discount::FLOAT = 0.04::FLOAT) AS \"at_0.04\", count(*) FILTER (l_discount::FLOAT = 0.05::FLOAT) AS \"at_0.05\" FROM lineitem")
def exact_value_counts(spark, d):
    return S.exact_values(table(spark, d, "lineitem"), "l_discount", [0.04, 0.05])


@query("SELECT seed, n_nationkey % 3 AS variant, avg(n) AS mean_n FROM (SELECT n_nationkey, c_custkey % 5 AS seed, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY ALL")
def seed_average(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 5).alias("seed")).agg(F.count("*").alias("m"))
    return c.groupBy("seed", (F.col("n") % 3).alias("variant")).agg(F.avg("m").alias("mean_n"))


# Work log


def log(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", "value", F.col("event_type").alias("status"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at, count(*) AS attempts FROM events GROUP BY 1")
def status_latest(spark, d):
    return W.latest(log(spark, d), "user_id", "ts", "event_id")


@query("SELECT * FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at, count(*) AS attempts FROM events GROUP BY 1) WHERE status IN ('error', 'signup') AND attempts < 70")
def retry_selection(spark, d):
    return W.to_retry(W.latest(log(spark, d), "user_id", "ts", "event_id"), 70, ("error", "signup"))


@query("SELECT event_id, user_id, recent, recent >= 2 AS tripped FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error')")
def refusal_breaker(spark, d):
    return W.breaker(log(spark, d), "user_id", "ts", "error", 86400, 2).select("event_id", "user_id", "recent", "tripped")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(spent) AS spent FROM (SELECT *, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM events) WHERE spent > 3000 GROUP BY 1")
def throttle_budget(spark, d):
    return W.budget(log(spark, d), "user_id", "ts", "event_id", "value", 3000)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_not_done(spark, d):
    return W.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


# Text


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def html_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a "), 0)).cast("bigint").alias("links"))


@query("SELECT p_partkey, chr((65 + (p_partkey // 676) % 26)::INT) || chr((65 + (p_partkey // 26) % 26)::INT) || chr((65 + p_partkey % 26)::INT) AS id FROM part")
def base26_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", X.base26(F.col("p_partkey"), 3).alias("id"))


@query("SELECT l_orderkey, string_agg(f || n, '' ORDER BY n DESC, f) AS formula FROM (SELECT l_orderkey, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def stoichiometry(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "f")))
    return n.groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["f"], (-x["m"]).cast("string"))), "").alias("formula"))


@query("SELECT p_partkey, list_reduce(list_prepend('', string_split(p_type || '.' || p_name, '.')), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS longest FROM part")
def longest_fragment(spark, d):
    return table(spark, d, "part").select("p_partkey", X.longest_fragment(F.concat_ws(".", "p_type", "p_name")).alias("longest"))
