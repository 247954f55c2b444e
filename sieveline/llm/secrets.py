"""Secret scans: an incremental blob ledger, in DataFrame operations only.

Texts are content-addressed: the sha256 of a version's text is its blob, and
however many paths and versions share it, a blob is scanned once.  The ledger
remembers which rules, by name and version, were run on which blob and what
they found.  A scan

1. hashes every version of the documents;
2. keeps the blobs some current rule has not seen (an anti-join on blob and
   rule version), one copy of each, combined before the shuffle;
3. runs only the missing rules on them and appends to the ledger;
4. joins the findings back to all paths that hold the blob.

A rule is a regular expression that Java's engine and RE2 read alike.  Where
its matches are follows from two built-in functions: splitting a text at its
matches gives the pieces between them, and extracting gives the matches
themselves; their lengths add up to code-point offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_dir


def any_case(word: str) -> str:
    """A pattern for an ASCII word in either case, without Unicode's case folding."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; those whose group is shorter than ``least`` are dropped."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


_KEYS = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),  # a run of [0-9a-f]+ matches whole, so the bound may stand in the pattern
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")

#: Matches of a text that are gathered in one go.
BLOCK = 256

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(rule: Rule, order: int) -> str:
    """SQL for the spans of a rule in the column text."""
    p = "r'" + rule.pattern.replace("'", r"\x27") + "'"
    found = f"regexp_extract_all(text, {p}, 0)"
    kept = f"length(x.v) >= {rule.least}" if rule.group == 0 else f"length(x.g) >= {rule.least}"
    group = f"regexp_extract_all(text, {p}, {rule.group})" if rule.group else "m"
    # One pass that carries the offset: each match begins after the pieces and matches before it.
    # Blocks of BLOCK matches are gathered apart and flattened, so that no array grows match by match.
    empty = "CAST(array() AS array<struct<start:int,v:string,g:string>>)"
    step = "struct(acc.at + x.before + length(x.v) AS at, concat(acc.out, array(struct(acc.at + x.before AS start, x.v AS v, x.g AS g))) AS out)"
    block = f"aggregate(slice(all, b * {BLOCK} + 1, {BLOCK}), struct(part.at AS at, {empty} AS out), (acc, x) -> {step})"
    one = f"""
      transform(array({found}), m -> filter(
        transform(array(
          zip_with(zip_with(slice(split(text, {p}, -1), 1, size(m)), m, (s, v) -> struct(length(s) AS before, v AS v)), {group}, (a, g) -> struct(a.before AS before, a.v AS v, g AS g))),
          all -> aggregate(sequence(0, CAST(greatest(size(all) - 1, 0) / {BLOCK} AS int)),
            struct(0 AS at, CAST(array() AS array<array<struct<start:int,v:string,g:string>>>) AS out),
            (part, b) -> transform(array({block}), done -> struct(done.at AS at, concat(part.out, array(done.out)) AS out))[0],
            part -> flatten(part.out)))[0],
        x -> {kept}))[0]"""
    return f"""CASE WHEN array_contains(todo, '{rule.tag}') AND text RLIKE {p}
      THEN transform({one}, x -> struct(x.start AS start, {order} AS kind, x.start + length(x.v) AS end))
      ELSE CAST(array() AS {_SPANS}) END"""


def versions(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, text and blob of every version; a null text is an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).cast("bigint").alias("path"), text.alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(f"blob binary, tags array<string>, spans {_SPANS}").parquet(path) if fs.exists(hadoop) else None


def update_ledger(documents: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` hasn't seen and append it; returns the whole ledger.

    A rule's place in ``rules`` is its kind in the ledger, so add new ones at the end.
    """
    spark = documents.sparkSession
    tags = F.array(*[F.lit(r.tag) for r in rules])
    blobs = versions(documents).select("blob", "text")
    old = _ledger(spark, path)
    if old is None:
        todo = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", tags)
    else:
        seen = old.select("blob", F.explode("tags").alias("tag")).groupBy("blob").agg(F.collect_set("tag").alias("seen"))
        new = blobs.join(seen.filter(F.size(F.array_except(tags, "seen")) == 0).select("blob"), "blob", "left_anti")
        new = new.groupBy("blob").agg(F.first("text").alias("text"))
        todo = new.join(seen, "blob", "left").withColumn("todo", F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>"))))
    spans = ", ".join(_spans(r, i) for i, r in enumerate(rules))
    scanned = todo.selectExpr("blob", "todo AS tags", f"array_sort(concat({spans})) AS spans")
    scanned.write.mode("append").parquet(path)
    return _ledger(spark, path)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): what the current versions of the rules found; an older version of a rule gives way."""
    current = F.array(*[F.lit(r.tag) for r in rules])
    mine = F.filter("spans", lambda s: F.array_contains(F.col("tags"), F.element_at(current, s["kind"] + 1)))
    rows = ledger.filter(F.size("spans") > 0).select("blob", mine.alias("spans"))
    return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def find_secrets(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, spans) for every version: the spans all rules found in its text, by start and kind.

    Takes columns doc_id and text, whatever else there is; a row for each row.
    A null or empty text has no spans.  ``ledger`` is the folder of the ledger;
    by default a fresh one in the shared folder.
    """
    path = ledger or fresh_dir(documents.sparkSession, "ledger")
    found = findings(update_ledger(documents, path, rules), rules)
    out = versions(documents).select("path", "blob").join(found, "blob", "left")
    return out.select("path", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and all spans as text.

    A row for each row of the documents, whatever other columns they have.  A
    null or empty text has no spans: counts of 0, the digest of nothing and an
    empty text; rows that share a doc_id, null ones too, each have their own.
    """
    found = find_secrets(documents, ledger, rules)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{BASE[kind]}")

    return found.select(
        F.col("path").alias("doc_id"), *map(count, range(len(BASE))),
        F.sha2(_joined(base, rules).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"),
    )


def redacted(documents: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """doc_id and the text with every found span replaced by ``mark``; overlapping spans are one."""
    path = ledger or fresh_dir(documents.sparkSession, "ledger")
    found = findings(update_ledger(documents, path))
    return versions(documents).join(found, "blob", "left").select(F.col("path").alias("doc_id"), redact(F.col("text"), F.col("spans"), mark).alias("text"))


def redact(text: Column, spans: Column, mark: str) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        inside = s["start"] < acc["at"]
        gap = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2147483647))))
    return F.when(spans.isNull() | (F.size(spans) == 0), text).otherwise(done)


def oracle_sql() -> str:
    """The digests in DuckDB's SQL: RE2 gives the same leftmost matches."""
    parts = []
    for i, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        test = f"length(regexp_extract_all(t, {p}, {r.group})[j]) >= {r.least}"
        parts.append(f"""
          SELECT doc_id, {i} AS kind, '{r.name}' AS name, s AS start, s + length(m) AS stop FROM (
            SELECT doc_id, t, j, regexp_extract_all(t, {p})[j] AS m,
              (list_sum(list_transform(string_split_regex(t, {p})[1:j], lambda x: length(x)))
               + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:j - 1], lambda x: length(x))), 0))::BIGINT AS s,
              {test} AS ok
            FROM (SELECT doc_id, t, unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS j FROM texts WHERE regexp_matches(t, {p}))) WHERE ok""")
    spans = " UNION ALL ".join(parts)
    counts = ", ".join(f"(count(*) FILTER (WHERE kind = {i}))::BIGINT AS n_{k}" for i, k in enumerate(BASE))
    zero = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)
    label = "name || ':' || start || ':' || stop"
    return f"""
      WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      spans AS ({spans}),
      per AS (SELECT doc_id, {counts},
        string_agg({label}, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(BASE)}) AS base,
        string_agg({label}, ',' ORDER BY start, kind) AS every FROM spans GROUP BY doc_id)
      SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
      FROM documents d LEFT JOIN per USING (doc_id)"""
