"""Selection, entity resolution, similarity graphs and clusters over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import selection as S
from ..operators import similarity as G
from ..operators.iterate import connected_components as components
from ..operators.iterate import leader_clusters, spread, tasks_for
from .fixtures import CONTACTS_SQL, SYSTEMS_SQL, contacts, systems, table

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


@query("SELECT * FROM (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3 AND c_mktsegment <> '') WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 8)")
def qualification_filter(spark, d):
    rows = S.qualified(table(spark, d, "customer"), [F.col("c_acctbal") > 0, F.col("c_nationkey") != 3, F.col("c_mktsegment") != ""])
    eight = table(spark, d, "orders").groupBy("o_custkey").count().filter("count = 8").select(F.col("o_custkey").alias("c_custkey"))
    return rows.join(eight, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)")
def single_row_keys(spark, d):
    return S.single_row_keys(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 400) THEN 'A' ELSE 'B' END AS tier FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase' AND value > 400) OR bool_or(event_type = 'signup' AND value > 300)")
def tier_case(spark, d):
    e = table(spark, d, "events")
    users = e.select("user_id").distinct()
    return S.tiered(users, "user_id", [("A", e.filter("event_type = 'purchase' AND value > 400")), ("B", e.filter("event_type = 'signup' AND value > 300"))])


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 5 THEN 'small' WHEN (json_extract_string(props, '$.k'))::INT > 90 THEN 'late' END AS reason FROM events""")
def skip_reasons(spark, d):
    from ..functions.exprs import first_reason

    k = F.get_json_object("props", "$.k").cast("int")
    rules = [("error", F.col("event_type") == "error"), ("small", F.col("value") < 5), ("late", k > 90)]
    return table(spark, d, "events").select("event_id", first_reason(rules).alias("reason"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, l_suppkey % 2 AS tier, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS depth FROM s)
  SELECT l_suppkey, l_partkey, n, tier, depth FROM r ORDER BY tier, depth, l_suppkey LIMIT 500""")
def round_robin_select(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).withColumn("tier", F.col("l_suppkey") % 2)
    return S.round_robin(s, "l_suppkey", [F.desc("n"), F.col("l_partkey")], 500, "tier")


@query("""WITH g AS (SELECT p_brand, count(*) AS w FROM part GROUP BY 1), s AS (SELECT p_brand, floor(w * 101 / sum(w) OVER ()) AS f, round(w * 101 / sum(w) OVER () - floor(w * 101 / sum(w) OVER ()), 9) AS r FROM g)
  SELECT p_brand, (f + (row_number() OVER (ORDER BY r DESC, p_brand) <= 101 - sum(f) OVER ())::INT)::BIGINT AS n FROM s""")
def largest_remainder(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("w"))
    return S.largest_remainder(g, "w", "p_brand", 101)


@query("SELECT c_custkey FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 200")
def stable_sample(spark, d):
    return S.stable_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 200, "7")


@query("SELECT user_id, event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 5")
def topn_pool(spark, d):
    rows = S.top_per_group(table(spark, d, "events"), ["user_id", "event_type"], [F.col("value").asc_nulls_last(), F.col("event_id")], 5)
    return rows.select("user_id", "event_type", "event_id", "rank")


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY user_id")
def best_pose(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.min("value").alias("value"))


_WINS = "WITH p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS pr, (json_extract_string(props, '$.k'))::INT AS k FROM events) SELECT user_id, k, event_id FROM (SELECT *, {} AS r FROM p) WHERE r = 1"


def _prioritised(spark, d):
    order = F.array(*[F.lit(x) for x in ("purchase", "signup", "click", "view", "error")])
    e = table(spark, d, "events")
    return e.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id", (F.array_position(order, F.col("event_type"))).alias("pr"))


@query(_WINS.format("row_number() OVER (PARTITION BY user_id, k ORDER BY pr, event_id)"))
def first_source_strict(spark, d):
    return S.first_source_wins(_prioritised(spark, d), ["user_id", "k"], "pr", True, "event_id").drop("pr")


@query(_WINS.format("dense_rank() OVER (PARTITION BY user_id, k ORDER BY pr)"))
def first_source_legacy(spark, d):
    return S.first_source_wins(_prioritised(spark, d), ["user_id", "k"], "pr", False).drop("pr")


@query("SELECT p_name, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY p_name")
def appearance_codes(spark, d):
    return S.appearance_codes(table(spark, d, "part"), "p_name", "p_partkey")


@query("SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents")
def cumulative_offsets(spark, d):
    return S.offsets(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars").drop("n_chars")


@query("SELECT o_custkey, arg_max(m, (n, -m)) AS m, max(n) AS n FROM (SELECT o_custkey, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def top_member(spark, d):
    return S.top_member(table(spark, d, "orders").select("o_custkey", F.month("o_orderdate").alias("m")), "o_custkey", "m")


@query("""WITH l AS (SELECT DISTINCT l_orderkey FROM lineitem) SELECT count(*) AS n, avg((c_nationkey % 5 = n_regionkey)::INT) AS region_agrees, avg((o_custkey IS NOT DISTINCT FROM c_custkey)::INT) AS customer_agrees
  FROM orders JOIN l ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def entity_map_agreement(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")
    j = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return E.agreement_report(j.withColumn("r", F.col("c_nationkey") % 5), [("region_agrees", "r", "n_regionkey"), ("customer_agrees", "o_custkey", "c_custkey")])


@query("WITH n AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey) SELECT count(*) AS n_keys, count(*) FILTER (n = 1) AS singletons, avg((n = 1)::INT) AS singleton_share, max(n) AS largest, quantile_cont(n, 0.5) AS median, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS recurring_rows FROM n")
def multiplicity_stats(spark, d):
    return E.multiplicity(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_returnflag) AS n_l_returnflag FROM lineitem GROUP BY 1 HAVING n_l_suppkey > 1 OR n_l_returnflag > 1")
def group_consistency(spark, d):
    return E.inconsistent(table(spark, d, "lineitem"), "l_orderkey", ["l_suppkey", "l_returnflag"])


@query("SELECT c_custkey, c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def one_to_one_join(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return E.one_to_one(table(spark, d, "customer").select("c_custkey", "c_name"), per, "c_custkey")


@query("SELECT doc_id, coalesce('q' || quality, 'l' || lang) AS tag FROM documents LEFT JOIN labels USING (doc_id)")
def fallback_lookup(spark, d):
    docs = table(spark, d, "documents")
    known = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("q"))
    return E.fallback(docs.select("doc_id"), "doc_id", [(known, "q"), (docs.select("doc_id", F.concat(F.lit("l"), "lang").alias("l")), "l")], "tag")


@query("SELECT doc_id AS k, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def symmetric_difference(spark, d):
    return E.symmetric_difference(*(table(spark, d, t).select(F.col("doc_id").alias("k")) for t in ("documents", "labels")), "k")


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem) SELECT l_orderkey, count(*) AS n FROM (SELECT * FROM s EXCEPT SELECT l_orderkey, l_linenumber, 1.0 FROM s) GROUP BY 1")
def set_difference(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return E.difference(s, s.withColumn("l_quantity", F.lit(1.0)), "l_orderkey", tasks_for(spark, 2 * s.count())).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("WITH spans AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w - l_quantity AS o, l_quantity AS size FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, o_custkey % 60 AS p FROM orders) JOIN spans ON o_orderkey = l_orderkey AND p >= o AND p < o + size")
def interval_join(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("size"))
    spans = S.offsets(lines, "l_orderkey", "l_linenumber", "size").withColumnRenamed("l_orderkey", "o_orderkey")
    points = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("p"))
    return E.in_interval(points, spans, "o_orderkey", "p").select("o_orderkey", "l_linenumber")


@query("""WITH dep AS (SELECT DISTINCT l_orderkey AS system, l_linenumber AS chain FROM lineitem), o AS (SELECT system, chain, 2 * (row_number() OVER (PARTITION BY system ORDER BY chain) - 1) AS o FROM dep),
  p AS (SELECT system, o + pos AS r FROM o, (SELECT unnest([0, 1]) AS pos) WHERE NOT (chain = 7 AND pos = 1)), n AS (SELECT system, 2 * count(*) AS n FROM dep GROUP BY 1)
  SELECT system, count(r) AS rows, count(r) = any_value(n) AND count(DISTINCT r) = any_value(n) AND min(r) = 0 AND max(r) = any_value(n) - 1 AS is_permutation FROM p JOIN n USING (system) GROUP BY 1""")
def chain_remap(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("system"), F.col("l_linenumber").alias("chain"))
    tasks = tasks_for(spark, 2 * lines.count())  # two rows for each line
    dep = lines.repartition(tasks, "system").distinct().withColumn("size", F.lit(2))
    dep = S.offsets(dep, "system", "chain", "size")
    pred = dep.select("system", "chain", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).filter("NOT (chain = 7 AND pos = 1)")
    return E.remapped(pred, dep, tasks)


# Similarity graph of customers by the parts they bought.

#: Two sets below this similarity are no neighbours: the lowest cut-off that clusters are formed at.
FLOOR = 0.3
_BITS = 2**20


def _shingle_sql(name, source, key):
    return f"""{name} AS (SELECT DISTINCT id, ('0x' || substr(md5(w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]), 1, 7))::BIGINT % {_BITS} AS bit
    FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM (SELECT {key} AS id, list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> '') AS w FROM {source} WHERE text IS NOT NULL)))"""


_FEATURES = _shingle_sql("feat", "documents", "doc_id") + ", nb AS (SELECT id, count(*) AS n FROM feat GROUP BY id)"
_PAIRS = _FEATURES + ", c AS (SELECT a.id AS i, b.id AS j, count(*) AS c FROM feat a JOIN feat b ON a.bit = b.bit AND a.id < b.id GROUP BY ALL), pairs AS (SELECT i, j, (c / (x.n + y.n - c))::FLOAT AS sim FROM c JOIN nb x ON x.id = i JOIN nb y ON y.id = j WHERE (c / (x.n + y.n - c))::FLOAT >= 0.3::FLOAT)"


def shingles(df, key):
    """(id, feature) for each three words of a text that stand in a row."""
    words = F.filter(F.split("text", "[ \n\t]+"), lambda x: x != "")
    rows = spread(df.select(key, "text")).select(F.col(key).alias("id"), words.alias("w")).filter(F.size("w") > 2)
    at = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda k: F.concat_ws(" ", F.get("w", k), F.get("w", k + 1), F.get("w", k + 2)))
    number = F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 7), 16, 10).cast("bigint")
    return rows.select("id", F.explode(at).alias("s")).select("id", number.alias("feature"))


def _features(spark, d):
    return shingles(table(spark, d, "documents"), "doc_id")


def _pairs(spark, d):
    return G.pairs_above(_features(spark, d), FLOOR, _BITS)


_PRINTS = "feat AS (SELECT DISTINCT o_custkey AS id, l_partkey % 2048 AS bit FROM orders JOIN lineitem ON o_orderkey = l_orderkey), nb AS (SELECT id, count(*) AS n FROM feat GROUP BY id)"


@query(f"WITH {_PRINTS} SELECT id, n AS n_bits, min_bit, max_bit FROM nb JOIN (SELECT id, min(bit)::INT AS min_bit, max(bit)::INT AS max_bit FROM feat GROUP BY id) USING (id)")
def fingerprint_bits(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    fp = G.fingerprints(o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("feature")), "o_orderkey"))
    on = fp.select("id", "n_bits", F.posexplode("words").alias("w", "v")).filter("v <> 0")
    set_ = F.expr("filter(sequence(0, 63), b -> shiftrightunsigned(v, b) & 1 = 1)")
    first, last = (F.col("w") * 64 + f(set_) for f in (F.array_min, F.array_max))
    return on.groupBy("id").agg(F.first("n_bits").alias("n_bits"), F.min(first).alias("min_bit"), F.max(last).alias("max_bit"))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def tanimoto_pairs(spark, d):
    return _pairs(spark, d)


@query(f"WITH {_PAIRS}, b AS (SELECT i, j, sim FROM pairs UNION ALL SELECT j, i, sim FROM pairs) SELECT * FROM (SELECT i, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank, j, sim FROM b) WHERE rank <= 3")
def topk_neighbours(spark, d):
    return G.top_neighbours(_pairs(spark, d), 3)


_FOLDS = "folds AS (SELECT doc_id AS node, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS fold FROM documents)"


def folds(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("fold"))


@query(f"WITH {_PAIRS}, {_FOLDS}, b AS (SELECT i, j, sim FROM pairs UNION ALL SELECT j, i, sim FROM pairs), m AS (SELECT i, max(sim) AS sim FROM b WHERE j IN (SELECT node FROM folds WHERE fold = 'train') GROUP BY i) SELECT node, coalesce(sim, 0)::FLOAT AS nearest FROM folds LEFT JOIN m ON i = node WHERE fold = 'test'")
def nearest_train(spark, d):
    return G.nearest_train(_pairs(spark, d), folds(spark, d))


_ALL = "c AS (SELECT a.id AS i, b.id AS j, count(*) AS c FROM feat a JOIN feat b ON a.bit = b.bit AND a.id <> b.id GROUP BY ALL), every AS (SELECT i, j, (c / (x.n + y.n - c))::FLOAT AS sim FROM c JOIN nb x ON x.id = i JOIN nb y ON y.id = j)"


@query(f"""WITH {_FEATURES}, {_FOLDS}, {_ALL}, m AS (SELECT i, max(sim) AS sim FROM every WHERE j IN (SELECT node FROM folds WHERE fold = 'train') GROUP BY i),
  top AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM every WHERE sim >= 0.3::FLOAT) WHERE r <= 3), found AS (SELECT DISTINCT i FROM top WHERE j IN (SELECT node FROM folds WHERE fold = 'train'))
  SELECT node, coalesce(sim, 0)::FLOAT AS nearest, node NOT IN (SELECT i FROM found) AS fell_back FROM folds LEFT JOIN m ON m.i = node WHERE fold = 'test'""")
def nearest_train_exact(spark, d):
    """The three nearest neighbours decide; a test document without one in train is compared with all of train."""
    return G.nearest_train_exact(_features(spark, d), folds(spark, d), G.top_neighbours(_pairs(spark, d), 3), _BITS)


_BENCH = _shingle_sql("item", "benchmark", "item_id") + ", " + _FEATURES


@query(f"""WITH {_BENCH}, nq AS (SELECT id, count(*) AS n FROM item GROUP BY id), s AS (SELECT a.id AS id, b.id AS j, count(*) AS c FROM item a JOIN feat b USING (bit) GROUP BY ALL), t AS (SELECT s.id, j, (c / (nq.n + nb.n - c))::FLOAT AS sim FROM s JOIN nq ON nq.id = s.id JOIN nb ON nb.id = j)
  SELECT nq.id, coalesce(first(j ORDER BY sim DESC, j), -1) AS j, coalesce(max(sim), 0)::FLOAT AS sim FROM nq LEFT JOIN t ON t.id = nq.id GROUP BY nq.id""")
def cross_similarity(spark, d):
    """Each benchmark item and the document most like it, or -1."""
    near = G.cross_nearest(shingles(table(spark, d, "benchmark"), "item_id"), _features(spark, d), _BITS)
    return near.select("id", F.coalesce("j", F.lit(-1)).alias("j"), "sim")


_HITS = "hits AS (SELECT l_suppkey AS query, l_partkey % 100 + 1 AS target, (1 - l_discount) AS fident, l_quantity AS alnlen, 40 + l_suppkey % 20 AS qlen, 40 + (l_partkey % 100 + 1) % 20 AS tlen FROM lineitem)"


@query(f"WITH {_HITS} SELECT least(query, target) AS a, greatest(query, target) AS b, round(max(fident * alnlen / least(qlen, tlen)), 9) AS global, max(CASE WHEN least(alnlen / qlen, alnlen / tlen) >= 0.8 THEN fident ELSE 0 END) AS cov80, max(fident) AS local FROM hits WHERE query <> target GROUP BY ALL")
def identity_definitions(spark, d):
    return G.identity_definitions(hits(spark, d)).withColumn("global", F.round("global", 9))


def hits(spark, d):
    t = F.col("l_partkey") % 100 + 1
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query"), t.alias("target"), (1 - F.col("l_discount")).alias("fident"), F.col("l_quantity").alias("alnlen"), (40 + F.col("l_suppkey") % 20).alias("qlen"), (40 + t % 20).alias("tlen"))


@query(f"""WITH {_HITS}, f AS (SELECT s_suppkey AS protein, CASE WHEN s_suppkey % 5 = 0 THEN 'test' ELSE 'train' END AS fold FROM supplier), x AS (SELECT query, target, fident * alnlen / least(qlen, tlen) AS g, CASE WHEN least(alnlen / qlen, alnlen / tlen) >= 0.8 THEN fident ELSE 0 END AS c, fident AS l FROM hits WHERE query <> target),
  y AS (SELECT query AS a, target AS b, g, c, l FROM x UNION ALL SELECT target, query, g, c, l FROM x), m AS (SELECT a, max(g) AS g, max(c) AS c, max(l) AS l FROM y WHERE b IN (SELECT protein FROM f WHERE fold = 'train') GROUP BY a)
  SELECT protein, round(coalesce(g, 0), 9) AS global, coalesce(c, 0) AS cov80, coalesce(l, 0) AS local FROM f LEFT JOIN m ON a = protein WHERE fold = 'test'""")
def identity_to_train(spark, d):
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("protein"), F.when(F.col("s_suppkey") % 5 == 0, "test").otherwise("train").alias("fold"))
    return G.identity_to_train(G.identity_definitions(hits(spark, d)), f).withColumn("global", F.round("global", 9))


@query(f"""WITH RECURSIVE {_PAIRS}, b AS (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs), deg AS (SELECT id AS node, count(j) AS d FROM nb LEFT JOIN b ON i = id GROUP BY id),
  turn AS (SELECT node, row_number() OVER (ORDER BY d DESC, node DESC) AS t FROM deg), nei AS (SELECT x.t AS t, list(y.t) AS ns FROM turn x LEFT JOIN b ON b.i = x.node LEFT JOIN turn y ON y.node = b.j GROUP BY x.t),
  first AS (SELECT list_transform(range((SELECT count(*) FROM turn)), lambda x: 0::BIGINT) AS lab),
  run AS (SELECT 0::BIGINT AS k, lab FROM first
    UNION ALL SELECT k + 1, CASE WHEN lab[k + 1] <> 0 THEN lab ELSE list_transform(lab, lambda v, p: CASE WHEN v = 0 AND (p = k + 1 OR list_contains(ns, p)) THEN k + 1 ELSE v END) END FROM run JOIN nei ON nei.t = k + 1),
  fin AS (SELECT unnest(lab) AS lead, generate_subscripts(lab, 1) AS t FROM run WHERE k = len(lab))
  SELECT a.node, l.node AS leader, dense_rank() OVER (ORDER BY fin.lead) - 1 AS cluster FROM fin JOIN turn a ON a.t = fin.t JOIN turn l ON l.t = fin.lead""")
def butina(spark, d):
    words = F.filter(F.split("text", "[ \n\t]+"), lambda x: x != "")
    nodes = table(spark, d, "documents").filter(F.size(words) > 2).select(F.col("doc_id").alias("node")).distinct()  # texts that have a shingle
    return leader_clusters(nodes, _pairs(spark, d))


_EDGES = "edges AS (SELECT DISTINCT o_custkey AS a, l_partkey + 1000000 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_PART_EDGES = "edges AS (SELECT 'p' || p_name || '|' || p_partkey % 7 AS a, 'l' || p_size || '|' || p_brand || '|' || p_partkey % 11 AS b FROM part)"
_COMP = """e AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  comp(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a UNION SELECT e.b, min(c.component) FROM comp c JOIN e ON e.a = c.node JOIN recurring.comp r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b)"""


def edges(spark, d):
    """Customers and the parts they ordered, all of them."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("a"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") + 1000000).alias("b"))  # noqa: E741
    return o.join(l, "o_orderkey").select("a", "b").distinct()


def part_edges(spark, d):
    """A graph of many components: parts link a cluster by name with one by size and brand."""
    a, b = F.concat(F.lit("p"), F.concat_ws("|", "p_name", F.col("p_partkey") % 7)), F.concat(F.lit("l"), F.concat_ws("|", "p_size", "p_brand", F.col("p_partkey") % 11))
    return table(spark, d, "part").select(a.alias("a"), b.alias("b"))


@query(f"WITH RECURSIVE {_EDGES}, {_COMP} SELECT * FROM comp")
def connected_components(spark, d):
    return components(edges(spark, d))


@query(f"WITH RECURSIVE {_PART_EDGES}, {_COMP} SELECT * FROM comp")
def part_components(spark, d):
    return components(part_edges(spark, d))


@query(f"""WITH RECURSIVE {_PART_EDGES}, {_COMP}, s AS (SELECT count(*) AS n FROM comp GROUP BY component), r AS (SELECT n, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC) AS r FROM s)
  SELECT count(*) AS n_components, max(n) AS largest, max(n) / any_value(total) AS largest_share, (sum(n) FILTER (r <= 5))::BIGINT AS top5, count(*) FILTER (n = 1) AS singletons, quantile_cont(n, 0.5) AS median, count(*) FILTER (cum < 0.9 * total) + 1 AS to_cover_90, max(n) / any_value(total) <= 0.85 AS balanceable FROM r""")
def component_stats(spark, d):
    from ..operators.summary import group_sizes

    return group_sizes(components(part_edges(spark, d)), "component")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY k) - 1 AS cluster FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '~' || p_partkey ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) END AS k FROM part)")
def scaffold_cluster(spark, d):
    from ..operators.summary import scaffold_clusters

    key = F.when(F.col("p_size") % 7 != 0, F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " ")))
    return scaffold_clusters(table(spark, d, "part").select("p_partkey", key.alias("key")), "p_partkey")


@query(f"WITH {SYSTEMS_SQL}, s AS (SELECT protein, count(*) AS n FROM systems GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, protein) AS r, sum(n) OVER () AS t FROM s) SELECT count(*) AS n_clusters, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, (sum(n) FILTER (r <= 10))::BIGINT AS top10, (sum(n) FILTER (r <= 10)) / any_value(t) AS top10_share, quantile_cont(n, 0.5) AS median, avg(n) AS mean FROM r")
def cluster_stats(spark, d):
    from ..operators.summary import cluster_summary

    return cluster_summary(systems(spark, d), "protein")


@query(f"WITH {CONTACTS_SQL} SELECT arm, avg(d_min <= 40)::DOUBLE AS share FROM (SELECT arm, (d_min <= 40)::INT AS h, d_min FROM contacts) GROUP BY arm".replace("avg(d_min <= 40)::DOUBLE", "avg(h)"))
def assertion_share(spark, d):
    return contacts(spark, d).groupBy("arm").agg(F.avg((F.col("d_min") <= 40).cast("int")).alias("share"))
