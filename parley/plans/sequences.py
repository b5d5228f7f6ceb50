"""Window and sequence queries."""

from pyspark.sql import functions as F

from parley import adapters as ad
from parley.adapters import EVM_SQL, LONG_SQL, MSG_SQL
from parley.operators import filters as f
from parley.operators import windows as w
from parley.plans.registry import query

HOURS6 = 6 * 3600

_RUNS_SQL = """kept AS (SELECT * FROM msg WHERE NOT private AND NOT skip),
flagged AS (SELECT *, CASE WHEN lag(idx) OVER o IS NOT NULL AND lag(user_id) OVER o IS NOT DISTINCT FROM user_id
    AND lag(origin) OVER o IS NOT DISTINCT FROM origin AND {now} < lag({now}) OVER o + {limit} THEN 0 ELSE 1 END AS brk
  FROM kept WINDOW o AS (PARTITION BY conv_id ORDER BY idx)),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY idx) AS run FROM flagged)"""
_MERGED_SQL = """SELECT conv_id, CAST(run AS BIGINT) AS run, min(idx) AS idx, min_by(msg_id, idx) AS msg_id,
  min_by(t, idx) AS t, string_agg(content, chr(10) ORDER BY idx) AS content,
  string_agg(msg_id, ',' ORDER BY idx) AS message_ids, string_agg(idx, ',' ORDER BY idx) AS message_idxs,
  CAST(sum(votes) AS BIGINT) AS votes FROM runs GROUP BY conv_id, run"""


def _merged(msg, timeout_s):
    merged = w.merge_consecutive(msg, timeout_s)
    return merged.select(
        "conv_id", "run", "idx", "msg_id", F.unix_millis("time").alias("t"), "content",
        F.array_join("message_ids", ",").alias("message_ids"),
        F.array_join(F.transform("message_idxs", lambda i: i.cast("string")), ",").alias("message_idxs"), "votes")


@query(f"WITH {EVM_SQL}, {_RUNS_SQL.format(now='us', limit=HOURS6 * 1000000)} {_MERGED_SQL}")
def merge_consecutive(spark, sf):
    return _merged(ad.stored(ad.event_messages(spark, sf)), HOURS6)


@query(f"WITH {MSG_SQL}, {_RUNS_SQL.format(now='t', limit=30000)} {_MERGED_SQL}")
def merge_consecutive_chat(spark, sf):
    return _merged(ad.messages(spark, sf), 30)


# Two conversations of several position buckets, with runs over bucket edges, at the default bucket and at a small one.
LONG_GAP = 5000
_LONG_RUNS_SQL = f"WITH {LONG_SQL}, {_RUNS_SQL.format(now='us', limit=LONG_GAP * 1000000)} {_MERGED_SQL}"


def _long(spark, sf):
    return ad.stored(ad.long_messages(spark, sf))


def _long_merged(spark, sf, rows):
    merged = w.merge_consecutive(_long(spark, sf), LONG_GAP, rows)
    return merged.select(
        "conv_id", "run", "idx", "msg_id", F.unix_millis("time").alias("t"), "content",
        F.array_join("message_ids", ",").alias("message_ids"),
        F.array_join(F.transform("message_idxs", lambda i: i.cast("string")), ",").alias("message_idxs"), "votes")


@query(_LONG_RUNS_SQL)
def merge_consecutive_long(spark, sf):
    return _long_merged(spark, sf, w.BUCKET_ROWS)


@query(_LONG_RUNS_SQL)
def merge_consecutive_long_small_buckets(spark, sf):
    return _long_merged(spark, sf, 64)


@query(f"""WITH {LONG_SQL} SELECT conv_id, md5(string_agg(content, chr(10) ORDER BY idx)) AS content, count(*) AS n
FROM msg WHERE NOT private AND NOT skip GROUP BY conv_id""")
def conversation_texts_long(spark, sf):
    return f.conversation_texts(_long(spark, sf), 64).select(
        "conv_id", F.md5(F.array_join("messages", "\n")).alias("content"), F.size("messages").cast("long").alias("n"))


@query(f"""WITH {LONG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS r FROM msg)
SELECT conv_id, idx, msg_id FROM n WHERE r <= 1500""")
def keep_last_long(spark, sf):
    return w.keep_last(_long(spark, sf), 1500, 64).select("conv_id", "idx", "msg_id")


@query(f"""WITH {LONG_SQL}, n AS (SELECT *, idx - row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS g FROM msg
  WHERE votes % 7 <> 0) SELECT conv_id, min(idx) AS start, max(idx) + 1 AS "end", min_by(votes, idx) AS score FROM n
GROUP BY conv_id, g""")
def hit_runs_long(spark, sf):
    hits = _long(spark, sf).filter("votes % 7 <> 0").select("conv_id", "idx", F.col("votes").alias("score"))
    return w.hit_runs(hits, 64)


@query(f"""WITH {EVM_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS r FROM msg)
SELECT conv_id, idx, msg_id FROM n WHERE r <= 50""")
def keep_last(spark, sf):
    return w.keep_last(ad.event_messages(spark, sf), 50).select("conv_id", "idx", "msg_id")


_WINDOW_SQL = """, c AS (SELECT conv_id, count(*) AS n FROM msg GROUP BY conv_id),
x AS (SELECT m.*, CAST(greatest(0, n - {n}) AS INTEGER) AS start, CAST(n AS INTEGER) AS "end"
  FROM msg m JOIN c USING (conv_id) WHERE idx >= n - {n})
SELECT conv_id, idx, start, "end", CAST(count(*) FILTER (skip) OVER (PARTITION BY conv_id) AS INTEGER) AS skipped
FROM x"""


@query(f"WITH {EVM_SQL}{_WINDOW_SQL.format(n=10)}")
def analysis_window(spark, sf):
    return w.analysis_window(ad.event_messages(spark, sf)).select("conv_id", "idx", "start", "end", "skipped")


_START_SQL = """, k AS (SELECT conv_id, idx, t,
    coalesce(sum(length(content)) OVER l, 0) AS chars, count(*) OVER l AS n,
    first_value(t) OVER (PARTITION BY conv_id ORDER BY idx DESC) AS anchor
  FROM msg WHERE NOT skip
  WINDOW l AS (PARTITION BY conv_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT conv_id, max(idx) AS stop FROM k
  WHERE NOT (chars < 100 OR n < 2 OR t >= anchor - 180000)
    AND NOT (chars < 300 AND n < 10 AND t >= anchor - 86400000) GROUP BY conv_id),
starts AS (SELECT conv_id, CAST(coalesce(stop + 1, 0) AS INTEGER) AS start
  FROM (SELECT DISTINCT conv_id FROM msg) LEFT JOIN s USING (conv_id))"""


@query(f"WITH {EVM_SQL}{_START_SQL} SELECT * FROM starts")
def context_start(spark, sf):
    return w.context_start(ad.stored(ad.event_messages(spark, sf)))


@query(f"WITH {LONG_SQL}{_START_SQL} SELECT * FROM starts")
def context_start_long(spark, sf):
    return w.context_start(_long(spark, sf), rows=64)


@query(f"WITH {LONG_SQL}{_WINDOW_SQL.format(n=1000)}")
def analysis_window_long(spark, sf):
    return w.analysis_window(_long(spark, sf), 1000, 64).select("conv_id", "idx", "start", "end", "skipped")


@query(f"WITH {MSG_SQL}{_START_SQL} SELECT * FROM starts")
def context_start_chat(spark, sf):
    return w.context_start(ad.messages(spark, sf))


@query(f"WITH {MSG_SQL} SELECT DISTINCT conv_id, CAST(0 AS INTEGER) AS start FROM msg")
def context_start_compat(spark, sf):
    return w.context_start(ad.messages(spark, sf), compat=True)


def _context_sql(base, unit):
    """Step-by-step two-sided walk as a recursive query (the operator ranks and folds instead)."""
    return f"""WITH RECURSIVE {base},
sized AS (SELECT conv_id, idx, {unit} AS t, length(content) AS chars, count(*) OVER (PARTITION BY conv_id) AS n
  FROM msg),
walk AS (
  SELECT conv_id, idx, n, t AS t0, idx AS f, idx - 1 AS p, 0 AS chars, 0 AS taken, idx AS low, idx AS high,
    false AS done FROM sized WHERE n > 2 AND idx < n - 1
  UNION ALL
  SELECT conv_id, idx, n, t0, CASE WHEN fwd THEN f + 1 ELSE f END, CASE WHEN fwd THEN p ELSE p - 1 END,
    CASE WHEN forced THEN chars + mchars ELSE chars END, CASE WHEN ok THEN taken + 1 ELSE taken END,
    CASE WHEN ok THEN least(low, midx) ELSE low END, CASE WHEN ok THEN greatest(high, midx) ELSE high END,
    NOT ok OR (f >= n - 1 AND p <= 0)
  FROM (SELECT *, forced OR (chars < 300 AND taken < 10 AND delta <= 86400 * CAST({{k}} AS BIGINT)) AS ok FROM (
    SELECT *, chars < 100 OR taken < 2 OR delta <= 180 * CAST({{k}} AS BIGINT) AS forced FROM (
      SELECT w.*, coalesce(ft.t - t0, 9e18) <= coalesce(t0 - pt.t, 9e18) AS fwd,
        least(coalesce(ft.t - t0, 9e18), coalesce(t0 - pt.t, 9e18)) AS delta,
        CASE WHEN coalesce(ft.t - t0, 9e18) <= coalesce(t0 - pt.t, 9e18) THEN f ELSE p END AS midx,
        CASE WHEN coalesce(ft.t - t0, 9e18) <= coalesce(t0 - pt.t, 9e18) THEN ft.chars ELSE pt.chars END AS mchars
      FROM walk w LEFT JOIN sized ft ON ft.conv_id = w.conv_id AND ft.idx = w.f
        LEFT JOIN sized pt ON pt.conv_id = w.conv_id AND pt.idx = w.p
      WHERE NOT w.done) a) b) c),
ends AS (SELECT conv_id, idx, n, min(low) AS low, max(high) AS high FROM walk GROUP BY conv_id, idx, n)
SELECT conv_id, idx, CAST(least(low, greatest(0, idx - 1)) AS INTEGER) AS start,
  CAST(greatest(high, least(n - 1, idx + 1)) AS INTEGER) AS "end" FROM ends
UNION ALL SELECT conv_id, idx, 0, CAST(n AS INTEGER) FROM sized WHERE n <= 2 OR idx = n - 1"""


@query(_context_sql(EVM_SQL, "us").format(k=1000000))
def message_context(spark, sf):
    return w.message_context(ad.stored(ad.event_messages(spark, sf))).select("conv_id", "idx", "start", "end")


@query(_context_sql(MSG_SQL, "t").format(k=1000))
def message_context_chat(spark, sf):
    return w.message_context(ad.messages(spark, sf)).select("conv_id", "idx", "start", "end")


_HITS_SQL = ", hits AS (SELECT conv_id, idx, votes AS score FROM msg WHERE user_id IN ('click', 'view', 'error'))"
_HIT_RUNS_SQL = f"""{_HITS_SQL}, islands AS (SELECT *, idx - row_number() OVER (PARTITION BY conv_id ORDER BY idx)
  AS g FROM hits),
runs AS (SELECT conv_id, min(idx) AS start, max(idx) + 1 AS "end", min_by(score, idx) AS score
  FROM islands GROUP BY conv_id, g)"""


def _runs(msg):
    hits = msg.filter(F.col("user_id").isin("click", "view", "error"))
    return w.hit_runs(hits.select("conv_id", "idx", F.col("votes").alias("score")))


@query(f"WITH {EVM_SQL}{_HIT_RUNS_SQL} SELECT * FROM runs")
def hit_runs(spark, sf):
    return _runs(ad.stored(ad.event_messages(spark, sf)))


@query(f"""WITH {EVM_SQL}{_HIT_RUNS_SQL}
SELECT r.conv_id, start, m.idx, msg_id, CASE WHEN m.idx < start THEN 'before' ELSE 'after' END AS side
FROM runs r JOIN msg m ON m.conv_id = r.conv_id
  AND ((m.idx >= start - 1 AND m.idx < start) OR (m.idx >= "end" AND m.idx < "end" + 2))""")
def with_neighbours(spark, sf):
    msg = ad.stored(ad.event_messages(spark, sf))
    return w.with_neighbours(_runs(msg), msg).select("conv_id", "start", "idx", "msg_id", "side")


@query(f"""WITH {EVM_SQL} SELECT conv_id, idx,
round(votes / CAST(max(votes) OVER (PARTITION BY conv_id) AS DOUBLE), 6) AS share FROM msg WHERE votes > 0""")
def normalise_by_max(spark, sf):
    msg = ad.stored(ad.event_messages(spark, sf)).filter("votes > 0")
    return w.normalise_by_max(msg, "votes", ["conv_id"], "share").select(
        "conv_id", "idx", F.round("share", 6).alias("share"))
