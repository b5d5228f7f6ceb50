"""Sequence operators over the messages of a conversation.

All of them work on position buckets (see ``parley.scan``), so one very long conversation is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.scan import BUCKET_ROWS, after, before, bucket_of, carry, ordinal, whole
from parley.session import cut_lineage


def skips(metadata: str = "metadata") -> Column:
    """True for messages excluded from analysis."""
    return F.coalesce(F.lower(F.try_element_at(F.col(metadata), F.lit("skipAnalysis"))) == "true", F.lit(False))


def indexable_messages(msg: DataFrame) -> DataFrame:
    return msg.filter(~F.coalesce(F.col("private"), F.lit(False)) & ~skips())


def _continues(previous: Column, current: Column, timeout_s: int) -> Column:
    same = (previous["user_id"].eqNullSafe(current["user_id"])
            & previous["origin"].eqNullSafe(current["origin"]))
    in_time = current["time"] < previous["time"] + F.expr(f"interval {timeout_s} seconds")
    return F.coalesce(same & in_time, F.lit(False))


def number_runs(msg: DataFrame, timeout_s: int = 30, rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``run``: consecutive indexable messages of one user and origin, each within ``timeout_s`` of the one
    before it.  Private and skipped messages are dropped first and do not break a run."""
    here = F.struct("user_id", "origin", "time")
    local = Window.partitionBy("conv_id", "_bucket").orderBy("idx")
    kept = (indexable_messages(msg).withColumn("_bucket", bucket_of("idx", rows))
            .withColumn("_here", here).withColumn("_previous", F.lag("_here").over(local)))
    breaks = F.col("_previous").isNotNull() & ~_continues(F.col("_previous"), F.col("_here"), timeout_s)
    kept = kept.withColumn("_break", breaks.cast("int"))

    def derive(totals: DataFrame) -> DataFrame:
        last = F.last("_last").over(before(["conv_id"], "_bucket"))
        opens = last.isNull() | ~_continues(last, F.col("_first"), timeout_s)
        flagged = totals.withColumn("_opens", opens.cast("int"))
        earlier = F.sum(F.col("_inner") + F.col("_opens")).over(before(["conv_id"], "_bucket"))
        return flagged.select("conv_id", "_bucket", (F.coalesce(earlier, F.lit(0)) + F.col("_opens")).alias("_base"))

    numbered = carry(kept, ["conv_id"], "_bucket", [
        F.min_by("_here", "idx").alias("_first"), F.max_by("_here", "idx").alias("_last"),
        F.sum("_break").alias("_inner")], derive)
    return (numbered.withColumn("run", F.col("_base") + F.sum("_break").over(local))
            .drop("_here", "_previous", "_break", "_base"))


def merge_consecutive(msg: DataFrame, timeout_s: int = 30, rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per run: contents joined by a newline, ids and positions as lists, votes summed, the other fields of
    the first message.  The messages of a run are gathered by position bucket first, then the buckets of a run."""
    runs = number_runs(msg, timeout_s, rows)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "msg_id", "content")))
    first = F.min_by(F.struct("msg_id", "time", "origin", "user_id", "user_name"), "idx")
    parts = runs.groupBy("conv_id", "run", "_bucket").agg(
        F.min("idx").alias("idx"), first.alias("_first"), ordered.alias("_messages"), F.sum("votes").alias("votes"))
    whole_run = F.array_sort(F.collect_list(F.struct("_bucket", "_messages")))
    return (parts.groupBy("conv_id", "run")
            .agg(F.min_by("_first", "idx").alias("_first"), F.min("idx").alias("idx"),
                 F.flatten(F.transform(whole_run, lambda p: p["_messages"])).alias("_messages"),
                 F.sum("votes").cast("long").alias("votes"))
            .select("conv_id", "run", "idx", "_first.*",
                    F.array_join(F.transform("_messages", lambda m: m["content"]), "\n").alias("content"),
                    F.transform("_messages", lambda m: m["msg_id"]).alias("message_ids"),
                    F.transform("_messages", lambda m: m["idx"]).alias("message_idxs"), "votes"))


def keep_last(msg: DataFrame, n: int, rows: int = BUCKET_ROWS) -> DataFrame:
    """The last ``n`` messages of each conversation in list order."""
    placed = ordinal(msg.withColumn("_bucket", bucket_of("idx", rows)), ["conv_id"], [F.col("idx")], "_bucket",
                     "_position", "_total")
    return placed.filter(F.col("_position") > F.col("_total") - n).drop("_bucket", "_position", "_total")


def effective_window(n: int | None) -> int:
    """Configured size of the analysis window: 0 to 2 become 3, a negative value or none means all messages."""
    if n is None or n < 0:
        return 0
    return max(n, 3)


def analysis_window(msg: DataFrame, n: int = 10, rows: int = BUCKET_ROWS) -> DataFrame:
    """Messages of the analysis window with its ``start`` (inclusive), ``end`` (exclusive) and ``skipped`` count.

    ``n`` <= 0 takes all messages.  ``idx`` is the dense list position.
    """
    first_kept = (F.greatest(F.lit(0), F.col("end") - n) if n > 0 else F.lit(0))
    staged = msg.withColumn("_bucket", bucket_of("idx", rows))

    def derive(totals: DataFrame) -> DataFrame:
        return totals.select("conv_id", "_bucket", F.max("_end").over(whole(["conv_id"])).alias("end"))

    placed = carry(staged, ["conv_id"], "_bucket", [(F.max("idx") + 1).alias("_end")], derive)
    window = placed.withColumn("start", first_kept.cast("int")).filter(F.col("idx") >= F.col("start"))

    def count_skipped(totals: DataFrame) -> DataFrame:
        return totals.select("conv_id", "_bucket",
                             F.sum("_skipped").over(whole(["conv_id"])).cast("int").alias("skipped"))

    counted = carry(window, ["conv_id"], "_bucket", [F.count_if(skips()).alias("_skipped")], count_skipped)
    return counted.drop("_bucket")


def context_start(msg: DataFrame, min_len: int = 100, length: int = 300, min_msgs: int = 2, max_msgs: int = 10,
                  min_age_s: int = 180, max_age_s: int = 86400, compat: bool = False,
                  rows: int = BUCKET_ROWS) -> DataFrame:
    """Position where the context of the last message starts, one row per conversation.

    Walking back from the end a message belongs to the context while the characters after it are fewer than
    ``min_len``, the messages after it fewer than ``min_msgs``, or it is at most ``min_age_s`` old; further ones while
    under ``length``, ``max_msgs`` and ``max_age_s``.  Everything after the last message that fails both is included,
    so the walk is a suffix sum and a maximum.  ``compat`` repeats the historic behaviour, where messages were never
    counted and the first excluded position was returned.
    """
    staged = msg.withColumn("_bucket", bucket_of("idx", rows)).filter(~skips())
    staged = staged.withColumn("_chars", F.coalesce(F.length("content"), F.lit(0)).cast("long"))
    local = (Window.partitionBy("conv_id", "_bucket").orderBy(F.desc("idx"))
             .rowsBetween(Window.unboundedPreceding, -1))

    def derive(totals: DataFrame) -> DataFrame:
        later, everything = after(["conv_id"], "_bucket"), whole(["conv_id"])
        return totals.select(
            "conv_id", "_bucket",
            F.coalesce(F.sum("_sum").over(later), F.lit(0)).alias("_sum_after"),
            F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_n_after"),
            F.max_by("_newest", "_bucket").over(everything).alias("_anchor"))

    placed = carry(staged, ["conv_id"], "_bucket", [
        F.sum("_chars").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max_by("time", "idx").alias("_newest")],
        derive)
    chars = F.col("_sum_after") + F.coalesce(F.sum("_chars").over(local), F.lit(0))
    count = F.lit(0) if compat else F.col("_n_after") + F.count(F.lit(1)).over(local)
    measured = placed.select("conv_id", "idx", "time", "_anchor", chars.alias("_sum"), count.alias("_count"))

    def young(seconds: int) -> Column:
        return F.col("time") >= F.col("_anchor") - F.expr(f"interval {seconds} seconds")

    forced = (F.col("_sum") < min_len) | (F.col("_count") < min_msgs) | young(min_age_s)
    allowed = (F.col("_sum") < length) & (F.col("_count") < max_msgs) & young(max_age_s)
    stop = F.max(F.when(~(forced | allowed), F.col("idx")))
    starts = measured.groupBy("conv_id").agg(stop.alias("_stop"))
    first = F.coalesce(F.col("_stop") if compat else F.col("_stop") + 1, F.lit(0)).cast("int").alias("start")
    # conversations without a message left still have a context that starts at 0
    everyone = msg.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_all"))
    return everyone.join(starts, "conv_id", "left").select("conv_id", first)


def _gather_some(msg: DataFrame, wanted: DataFrame, halo: int) -> DataFrame:
    """The ``wanted`` (conv_id, idx) of ``msg`` with up to ``halo`` neighbours on either side, nearest first.

    Only wanted messages get neighbours: the messages of a bucket of ``halo`` positions are one array, and the buckets
    before, at and after a message hold all it can need.
    """
    entry = F.struct("idx", F.unix_micros("time").alias("_t"), F.coalesce(F.length("content"), F.lit(0)).alias("_chars"))
    asked = msg.join(wanted, ["conv_id", "idx"], "left_semi").select(
        "conv_id", "idx", "_size", F.unix_micros("time").alias("_t"))
    near = asked.select("*", F.explode(F.array(*[bucket_of("idx", halo) + d for d in (-1, 0, 1)])).alias("_bucket"))
    needed = near.select("conv_id", "_bucket").distinct()
    arrays = (msg.withColumn("_bucket", bucket_of("idx", halo)).join(needed, ["conv_id", "_bucket"], "left_semi")
              .groupBy("conv_id", "_bucket").agg(F.array_sort(F.collect_list(entry)).alias("_around")))
    found = near.join(arrays, ["conv_id", "_bucket"]).groupBy("conv_id", "idx", "_size", "_t").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_around"))), lambda b: b["_around"])).alias(
            "_near"))
    here = F.col("idx")
    return found.select(
        "conv_id", "idx", "_size", "_t",
        F.reverse(F.filter("_near", lambda e: (e["idx"] < here) & (e["idx"] >= here - halo))).alias("_back"),
        F.filter("_near", lambda e: (e["idx"] >= here) & (e["idx"] <= here + halo)).alias("_forth"))


def _gather_all(msg: DataFrame, halo: int, rows: int) -> DataFrame:
    """Every message with up to ``halo`` neighbours on either side, nearest first."""
    staged = msg.withColumn("_home", bucket_of("idx", rows))
    offset = F.col("idx") - F.col("_home") * rows
    homes = F.array_compact(F.array(
        F.col("_home"),
        F.when((offset < halo) & (F.col("_home") > 0), F.col("_home") - 1),
        F.when(offset >= rows - halo, F.col("_home") + 1)))
    spread = staged.select(
        "conv_id", "idx", "_home", "_size", F.unix_micros("time").alias("_t"),
        F.coalesce(F.length("content"), F.lit(0)).alias("_chars"), F.explode(homes).alias("_bucket"))
    frame = Window.partitionBy("conv_id", "_bucket").orderBy("idx")
    around = F.struct("idx", "_t", "_chars")
    return spread.withColumn(
        "_back", F.reverse(F.collect_list(around).over(frame.rowsBetween(-halo, -1)))).withColumn(
        "_forth", F.collect_list(around).over(frame.rowsBetween(0, halo))).filter(F.col("_home") == F.col("_bucket"))


def _expand(gathered: DataFrame, halo: int, min_len: int, length: int, min_msgs: int, max_msgs: int, before_min: int,
            after_min: int, min_age_s: int, max_age_s: int) -> DataFrame:
    """Message contexts from the neighbours gathered; ``_open`` where they were not enough."""
    gathered = gathered.filter((F.col("_size") > min_msgs) & (F.col("idx") < F.col("_size") - 1))
    n_forth, n_back = F.size("_forth"), F.size("_back")
    begin = F.struct(*[F.lit(0).alias(c) for c in ("forth", "back", "chars", "n", "last")],
                     F.col("idx").alias("low"), F.col("idx").alias("high"), F.lit(False).alias("done"))

    def grow(acc: Column, _: Column) -> Column:
        ahead, behind = F.get(F.col("_forth"), acc["forth"]), F.get(F.col("_back"), acc["back"])
        ahead_age, behind_age = ahead["_t"] - F.col("_t"), F.col("_t") - behind["_t"]
        forward = behind_age.isNull() | F.coalesce(ahead_age <= behind_age, F.lit(False))
        chosen, age = F.when(forward, ahead).otherwise(behind), F.when(forward, ahead_age).otherwise(behind_age)
        # the neighbour passed over last time was already looked at; with nothing new to look at the walk ends
        waiting = (F.when((acc["last"] == -1) & (acc["forth"] < n_forth), 1).otherwise(0)
                   + F.when((acc["last"] == 1) & (acc["back"] < n_back), 1).otherwise(0))
        fresh = n_forth - acc["forth"] + n_back - acc["back"] - waiting
        forced = (acc["chars"] < min_len) | (acc["n"] < min_msgs) | (age <= min_age_s * 1_000_000)
        allowed = (acc["chars"] < length) & (acc["n"] < max_msgs) & (age <= max_age_s * 1_000_000)
        grown = F.struct(
            (acc["forth"] + F.when(forward, 1).otherwise(0)).alias("forth"),
            (acc["back"] + F.when(forward, 0).otherwise(1)).alias("back"),
            (acc["chars"] + F.when(forced, chosen["_chars"]).otherwise(0)).alias("chars"),
            (acc["n"] + 1).alias("n"),
            F.when(forward, 1).otherwise(-1).alias("last"),
            F.least(acc["low"], chosen["idx"]).alias("low"),
            F.greatest(acc["high"], chosen["idx"]).alias("high"),
            F.lit(False).alias("done"))
        end = F.struct(*[acc[c].alias(c) for c in ("forth", "back", "chars", "n", "last", "low", "high")],
                       F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when((fresh > 0) & (forced | allowed), grown).otherwise(end)

    # the generator keeps the fold from being evaluated once per column taken from it
    walk = F.aggregate(F.sequence(F.lit(1), n_forth + n_back), begin, grow)
    walked = gathered.select("conv_id", "idx", "_size", F.inline(F.array(walk)))
    # where the conversation goes on beyond the halo, the walk must not have looked at the last message in it
    cut_back = (F.col("idx") > halo) & (F.col("back") >= halo - 1)
    cut_forth = (F.col("_size") - 1 - F.col("idx") > halo) & (F.col("forth") >= halo)
    return walked.select(
        "conv_id", "idx",
        F.least("low", F.greatest(F.lit(0), F.col("idx") - before_min)).cast("int").alias("start"),
        F.greatest("high", F.least(F.col("_size") - 1, F.col("idx") + after_min)).cast("int").alias("end"),
        (cut_back | cut_forth).alias("_open"))


def message_context(msg: DataFrame, min_len: int = 100, length: int = 300, min_msgs: int = 2, max_msgs: int = 10,
                    before_min: int = 1, after_min: int = 1, min_age_s: int = 180, max_age_s: int = 86400,
                    inclusive_end: bool = False, compat: bool = True, halo: int = 16,
                    rows: int = BUCKET_ROWS) -> DataFrame:
    """Context (``start``, ``end``) of every message: grown towards whichever neighbour is nearer in time.

    ``end`` follows the historic convention (the last position, used as an exclusive end) unless ``inclusive_end``,
    which adds one so that the last neighbour belongs to the slice.  Short conversations and last messages end at the
    size either way.  Neighbours are gathered ``halo`` at a time; messages whose walk reaches the edge of the halo are
    done again with a wider one until none is left, so no message sees a truncated neighbourhood.
    """
    staged = msg.withColumn("_bucket", bucket_of("idx", rows))

    def derive(totals: DataFrame) -> DataFrame:
        return totals.select("conv_id", "_bucket", F.max("_top").over(whole(["conv_id"])).alias("_top"))

    sized = (carry(staged, ["conv_id"], "_bucket", [F.max("idx").alias("_top")], derive)
             .withColumn("_size", F.col("_top") + 1).drop("_bucket", "_top"))
    last_start = context_start(msg, min_len, length, min_msgs, max_msgs, min_age_s, max_age_s, compat, rows)
    short = sized.filter(F.col("_size") <= min_msgs).select(
        "conv_id", "idx", F.lit(0).alias("start"), F.col("_size").cast("int").alias("end"))
    final = (sized.filter((F.col("_size") > min_msgs) & (F.col("idx") == F.col("_size") - 1))
             .join(last_start, "conv_id")
             .select("conv_id", "idx", "start", F.col("_size").cast("int").alias("end")))
    done = short.unionByName(final)
    pending, width = None, halo
    while True:
        gathered = (_gather_all(sized, width, max(rows, 2 * width)) if pending is None
                    else _gather_some(sized, pending, width))
        grown = _expand(gathered, width, min_len, length, min_msgs, max_msgs, before_min, after_min, min_age_s, max_age_s)
        if inclusive_end:
            grown = grown.withColumn("end", F.col("end") + 1)
        grown = cut_lineage(grown)
        done = done.unionByName(grown.filter(~F.col("_open")).drop("_open"))
        pending = grown.filter("_open").select("conv_id", "idx")
        if pending.isEmpty():
            return done
        width *= 8


def hit_runs(hits: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """Adjacent hit messages as one result: ``start`` (inclusive), ``end`` (exclusive), score of the first one.

    ``hits``: grouping columns, ``conv_id``, ``idx``, ``score``.
    """
    keys = [c for c in hits.columns if c not in ("idx", "score")]
    placed = ordinal(hits.withColumn("_bucket", bucket_of("idx", rows)), keys, [F.col("idx")], "_bucket", "_n")
    return (placed.groupBy(*keys, (F.col("idx") - F.col("_n")).alias("_island"))
            .agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"),
                 F.min_by("score", "idx").alias("score"))
            .drop("_island"))


def with_neighbours(runs: DataFrame, msg: DataFrame, n_before: int = 1, n_after: int = 2) -> DataFrame:
    """Messages around each run, ``side`` before or after.  The ranges become single positions, so this is an equality
    join on (conversation, position)."""

    def side(name: str, first: Column, last: Column) -> DataFrame:
        return (runs.filter(last >= first)
                .withColumn("idx", F.explode(F.sequence(first, last))).withColumn("side", F.lit(name)))

    wanted = []
    if n_before > 0:
        wanted.append(side("before", F.greatest(F.lit(0), F.col("start") - n_before), F.col("start") - 1))
    if n_after > 0:
        wanted.append(side("after", F.col("end"), F.col("end") + n_after - 1))
    if not wanted:
        return runs.withColumn("idx", F.lit(None).cast("int")).withColumn("side", F.lit("")).limit(0)
    positions = wanted[0] if len(wanted) == 1 else wanted[0].unionByName(wanted[1])
    return positions.join(msg.select("conv_id", "idx", "msg_id", "content"), ["conv_id", "idx"])


def runs_with_neighbours(runs: DataFrame, msg: DataFrame, n_before: int = 1, n_after: int = 2) -> DataFrame:
    """Each run with the list positions of the messages ``before`` and ``after`` it, as arrays in order.

    Like ``with_neighbours``, but the runs are read once: their positions travel with them through one left join.
    """
    cell = lambda side, first, last: F.when(last >= first, F.transform(
        F.sequence(first, last), lambda i: F.struct(F.lit(side).alias("side"), i.cast("int").alias("idx"))))
    none = F.array().cast("array<struct<side:string,idx:int>>")
    cells = F.concat(
        F.coalesce(cell("before", F.greatest(F.lit(0), F.col("start") - n_before), F.col("start") - 1), none),
        F.coalesce(cell("after", F.col("end"), F.col("end") + (n_after - 1)), none))
    placed = runs.select("*", F.explode_outer(cells).alias("_cell")).select(
        *runs.columns, F.col("_cell.side").alias("_side"), F.col("_cell.idx").alias("_idx"))
    there = msg.select("conv_id", F.col("idx").alias("_idx"), F.lit(True).alias("_there"))
    listed = lambda side: F.array_sort(F.collect_list(
        F.when(F.col("_there") & (F.col("_side") == side), F.col("_idx")))).alias(side)
    return placed.join(there, ["conv_id", "_idx"], "left").groupBy(*runs.columns).agg(listed("before"), listed("after"))


def normalise_by_max(df: DataFrame, value: str, keys: list[str], name: str | None = None) -> DataFrame:
    """Divide by the largest value of the group, the best becomes 1.0."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return df.join(top, keys).withColumn(name or value, F.try_divide(F.col(value), F.col("_top"))).drop("_top")
