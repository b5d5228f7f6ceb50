"""Secret scans with multipart credential linking, in built-in expressions only.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are reported wherever they stand.  Weak
candidates (account names, mixed-case tokens, endpoints) are common in clean text and say nothing alone; they are
reported where the parts of a credential meet: within ``SCOPE`` code points of each other, an identifier needs a secret,
a secret needs an identifier or an endpoint, and an endpoint needs both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.llm.common import shielded

SCOPE = 300

# Kinds in the order of the report, their patterns (valid for Java and RE2), and the group that must
# have the length.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
NAME = (r"([Cc]lient_?[Ii][Dd]|[Aa]ccess_?[Kk]ey_?[Ii][Dd]|[Aa]ccount|[Uu]ser(?:name)?|[Ll]ogin)"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)")
MIXED = r"[A-Za-z0-9+/]+"
ENDPOINT = (r"(?:https?|ftp|ssh|amqps?|redis|mysql|mongodb|postgres(?:ql)?|jdbc:[a-z]{1,20})://"
            r"[^\x20\x09-\x0D\"'<>]+")
KINDS = ("assign", "access", "hex", "name", "mixed", "endpoint")
STRONG = KINDS[:3]
PART_OF = {"assign": "secret", "access": "identifier", "hex": "secret", "name": "identifier", "mixed": "secret",
           "endpoint": "endpoint"}
# (kind, pattern, group whose length counts, least length, pattern that must be found for a match to pass at all)
RULES = (
    ("assign", ASSIGN, 2, 6, ASSIGN), ("access", ACCESS, 0, 20, r"AKIA[A-Z0-9]{16}"), ("hex", HEX, 0, 24, r"[0-9a-f]{24}"),
    ("name", NAME, 2, 3, NAME), ("mixed", MIXED, 0, 32, r"[A-Za-z0-9+/]{32}"), ("endpoint", ENDPOINT, 0, 8, ENDPOINT),
)


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, needs: str) -> Column:
    """Of all matches: length of the text before each since the last one, its own length, and whether it passes.

    A run pattern is narrowed to runs of the least length, which changes no maximal run that passes.
    """
    narrow = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "mixed": r"[A-Za-z0-9+/]{32,}"}
    pattern = narrow.get(kind, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    passes = F.transform(whole, lambda x: F.length(x) >= least)
    if group:
        passes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)
    elif kind == "mixed":
        passes = F.transform(whole, lambda x: x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]"))
    found = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
                         F.transform(whole, F.length).alias("size"), passes.alias("passes"))
    return F.when(text.rlike(needs), F.struct(F.lit(kind).alias("kind"), found.alias("found")))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, print, kind, begin, end): reported spans, offsets in code points, the end exclusive.

    ``print`` is a hash of the text: repeated rows have one set of spans, rows with equal keys and other texts their
    own.  Only match positions are shuffled, never texts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("print"), F.array_compact(F.array(
        *[_matches(body, *rule) for rule in RULES])).alias("kinds")).filter(F.size("kinds") > 0)
    one = rows.select("key", "print", F.explode("kinds").alias("k")).select(
        "key", "print", "k.kind", F.posexplode("k.found").alias("i", "m")).select(
        "key", "print", "kind", "i", "m.*").dropDuplicates(["key", "print", "kind", "i"])
    so_far = Window.partitionBy("key", "print", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far)).filter(
        "passes").select("key", "print", "kind", (F.col("end") - F.col("size")).alias("begin"), "end")
    strong = F.col("kind").isin(*STRONG)
    by_place = Window.partitionBy("key", "print").orderBy("begin")
    before = F.max(F.when(strong, F.col("end"))).over(by_place.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(strong, F.col("begin"))).over(by_place.rangeBetween(0, Window.unboundedFollowing))
    free = placed.withColumn("_b", before).withColumn("_a", after).filter(
        strong | ~(F.coalesce(F.col("_b") > F.col("begin"), F.lit(False))
                   | F.coalesce(F.col("_a") < F.col("end"), F.lit(False)))).drop("_a", "_b")
    near = by_place.rangeBetween(-scope, scope)
    part = F.create_map(*[F.lit(x) for pair in PART_OF.items() for x in pair])[F.col("kind")]
    seen = {p: F.max(F.col("part") == p).over(near) for p in ("identifier", "secret", "endpoint")}
    linked = free.withColumn("part", part).select(
        "*", *[c.alias(f"near_{p}") for p, c in seen.items()])
    ok = (F.when(F.col("part") == "identifier", F.col("near_secret"))
          .when(F.col("part") == "secret", F.col("near_identifier") | F.col("near_endpoint"))
          .otherwise(F.col("near_identifier") & F.col("near_secret")))
    return linked.filter(strong | ok).select(F.col("key").alias(key), "print", "kind", "begin", "end")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs``: counts of the strong kinds, digest of their spans, all spans as text.

    Null and empty texts have no spans (empty string, digest of the empty string).  Repeated rows and rows without
    a key are reported like any other.  An empty table gives no rows.  Only key and text are read.
    """
    entry = F.struct("begin", _rank(F.col("kind")).alias("rank"), "end", "kind")
    strong = F.col("kind").isin(*STRONG)
    own = spans(docs, key, text, scope).groupBy(F.col(key).alias("_key"), F.col("print").alias("_print")).agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in STRONG],
        F.collect_list(F.when(strong, entry)).alias("_strong"), F.collect_list(entry).alias("_all"))
    rows = docs.select(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"))
    joined = rows.join(own, F.col(key).eqNullSafe(F.col("_key")) & (F.col("print") == F.col("_print")), "left")
    return joined.select(
        key, *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in STRONG],
        F.sha2(F.coalesce(_joined(F.col("_strong")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("_all")), F.lit("")).alias("spans"))


@shielded
def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]",
           scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping spans become one mark.

    Rows without secrets are left as they are, null texts stay null, and every column is kept.
    """
    by_place = Window.partitionBy("_key", "_print").orderBy("begin", "end")
    own = spans(docs, key, text, scope).withColumnsRenamed({key: "_key", "print": "_print"})
    reach = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    fresh = own.withColumn("_new", (F.coalesce(reach, F.lit(0)) <= F.col("begin")).cast("int"))
    merged = fresh.withColumn("_run", F.sum("_new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "_key", "_print", "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    cuts = merged.groupBy("_key", "_print").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_cuts"))
    body = F.col(text)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda s: s["end"]))
    begins = F.concat(F.transform("_cuts", lambda s: s["begin"]), F.array(F.length(body).cast("long")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")),
                       lambda s: F.substring(body, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))
    print_of = F.xxhash64(F.coalesce(body, F.lit("")))
    joined = docs.join(cuts, F.col(key).eqNullSafe(F.col("_key")) & (print_of == F.col("_print")), "left")
    return joined.select(*[F.when(F.col("_cuts").isNull(), body).otherwise(F.array_join(kept, mark)).alias(text)
                           if c == text else F.col(c) for c in docs.columns])


def sql() -> str:
    """The report as DuckDB SQL over the table ``documents``."""
    quoted = {k: p.replace("'", "''") for k, p, *_ in RULES}
    branches = []
    for kind, _, group, least, _ in RULES:
        passes = {"mixed": "length(w) >= 32 AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND "
                           "regexp_matches(w, '[0-9]')"}.get(kind, f"length(g) >= {least}")
        branches.append(f"""SELECT rid, '{kind}' AS kind, i, gap, size, passes FROM (
  SELECT rid, unnest(range(1, len(hits) + 1)) AS i, unnest(list_transform(gaps[:len(hits)], lambda x: length(x))) AS gap,
    unnest(list_transform(hits, lambda x: length(x))) AS size,
    unnest(list_transform(list_zip(hits, parts), lambda z: {passes.replace("(w", "(z[1]").replace("(g)", "(z[2])")})) AS passes
  FROM (SELECT rid, regexp_extract_all(body, '{quoted[kind]}') AS hits,
    regexp_extract_all(body, '{quoted[kind]}', {group}) AS parts, string_split_regex(body, '{quoted[kind]}') AS gaps
    FROM docs))""")
    order = " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(KINDS))
    parts = " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in PART_OF.items())
    strong = "kind IN (" + ", ".join(f"'{k}'" for k in STRONG) + ")"
    near = f"OVER (PARTITION BY rid ORDER BY begin_at RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)"
    text = "concat(kind, ':', begin_at, ':', end_at)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
raw AS ({" UNION ALL ".join(branches)}),
placed AS (SELECT rid, kind, end_at - size AS begin_at, end_at FROM (
  SELECT *, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY i) AS end_at FROM raw) WHERE passes),
shaded AS (SELECT *, CASE kind {parts} END AS part, {strong} AS strong,
  max(CASE WHEN {strong} THEN end_at END) OVER (PARTITION BY rid ORDER BY begin_at RANGE UNBOUNDED PRECEDING) AS b,
  min(CASE WHEN {strong} THEN begin_at END) OVER (PARTITION BY rid ORDER BY begin_at
    RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM placed),
free AS (SELECT * FROM shaded WHERE strong OR NOT (coalesce(b > begin_at, FALSE) OR coalesce(a < end_at, FALSE))),
seen AS (SELECT *, max(CAST(part = 'identifier' AS INT)) {near} AS ni, max(CAST(part = 'secret' AS INT)) {near} AS ns,
  max(CAST(part = 'endpoint' AS INT)) {near} AS ne FROM free),
kept AS (SELECT *, CASE kind {order} END AS rank FROM seen WHERE strong
  OR CASE part WHEN 'identifier' THEN ns = 1 WHEN 'secret' THEN ni = 1 OR ne = 1 ELSE ni = 1 AND ns = 1 END),
own AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({text}, ',' ORDER BY begin_at, rank, end_at) FILTER (strong) AS base,
  string_agg({text}, ',' ORDER BY begin_at, rank, end_at) AS spans FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN own USING (rid)"""
