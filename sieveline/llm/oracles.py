"""SQL for the results that DuckDB can express; columns are those of the queries."""

from __future__ import annotations

from . import secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: component(node, component) of edges(a, b), both directions.
_COMPONENTS = """reach(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM edges GROUP BY a
    UNION SELECT e.b, min(c.component) FROM reach c JOIN edges e ON e.a = c.node JOIN recurring.reach r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b)"""

SUBSTRING_DEDUP = f"""
  WITH texts AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
  places AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts)),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS r FROM places) WHERE r > 1),
  gone AS (SELECT doc_id, list(DISTINCT i + k) AS cover FROM later, range(20) t(k) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(cover), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN cover IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(cover, j)) END, ' ')) AS kept_sha256
  FROM texts LEFT JOIN gone USING (doc_id)"""

NEAR_DEDUP = f"""
  WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM texts),
  flat AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
  edges AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  {_COMPONENTS}
  SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM sets LEFT JOIN reach ON node = doc_id"""

VECTORS = f"""
  WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= 0.95),
  n AS (SELECT a, count(*) AS n FROM edges GROUP BY a),
  {_COMPONENTS}
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
  FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN reach ON node = vec_id"""

RANKED = f"""
  WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
  n AS (SELECT doc_id, count(*)::BIGINT AS n FROM terms GROUP BY ALL),
  total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM n),
  w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
  asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
  m AS (SELECT doc_id, 10 + (90 * n * docs) // len AS m FROM n, total),
  scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
  SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""

SUFFIXES = """
  WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  places AS (SELECT doc_id, i, substr(x, 2 * i - 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 48)) AS i FROM texts)),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM places) WHERE least < doc_id),
  gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(50) t(k)),
  spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (i > before + 1 OR before IS NULL) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
  kept AS (SELECT doc_id, string_agg(b, '' ORDER BY i) AS x FROM (SELECT doc_id, i, substr(x, 2 * i - 1, 2) AS b FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 + 1)) AS i FROM texts SEMI JOIN spans USING (doc_id))) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
  SELECT doc_id, (len(t.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN t.x ELSE coalesce(k.x, '') END)) AS kept_sha256
  FROM texts t LEFT JOIN spans USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

ORACLES = {
    "op1_secret_scan": secrets.oracle_sql(),
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op6_embedding_near_dedup": VECTORS,
    "op8_minhash_near_dedup": NEAR_DEDUP,
    "op11_ranked_search": RANKED,
    "op12_suffix_dedup": SUFFIXES,
}
