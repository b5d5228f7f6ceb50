"""Predicates, look-ups and document projections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.functions.text import is_blank, strip_code_blocks
from parley.operators.windows import indexable_messages, merge_consecutive, message_context, skips
from parley.scan import BUCKET_ROWS, before, bucket_of, carry, spread_join

INDEX_VERSION = 7
NOT_INDEXED = ("token",)
INTERNAL_COLUMNS = ("owner", "client", "deleted")
INTERNAL_PREFIXES = ("_", "sync_", "index_")
MIN_TOKEN_CONFIDENCE = 0.1
# Adjectives that give no token.
IGNORED_ADJECTIVES = ["komisch", "komische", "nächste", "nächsten", "kommende", "kommenden", "übernächste",
                      "übernächsten", "zufällig", "zufälligen"]


def not_deleted(conv: DataFrame) -> DataFrame:
    return conv.filter(F.col("deleted").isNull())


def owned_by(df: DataFrame, owners: Iterable[str] | DataFrame | None) -> DataFrame:
    """Rows of the given tenants; None means all, an empty set none."""
    if owners is None:
        return df
    if isinstance(owners, DataFrame):
        return df.join(owners.select("owner").distinct(), "owner", "left_semi")
    owners = list(owners)
    return df.filter(F.col("owner").isin(owners)) if owners else df.filter(F.lit(False))


def accessible_owners(requested: DataFrame, allowed: DataFrame) -> DataFrame:
    return requested.join(allowed, "owner", "left_semi")


def ids_by_user(conv: DataFrame, user_id: str) -> DataFrame:
    return not_deleted(conv).filter(F.col("user.id") == user_id).select("conv_id")


def current_by_channel(conv: DataFrame) -> DataFrame:
    """Per channel the conversation modified last that is neither complete nor deleted."""
    open_ones = not_deleted(conv).filter(F.col("status") != "Complete")
    return (open_ones.select(F.explode(F.try_element_at("properties", F.lit("channel_id"))).alias("channel_id"),
                             "conv_id", "last_modified")
            .groupBy("channel_id").agg(F.max_by("conv_id", F.struct("last_modified", "conv_id")).alias("conv_id")))


def find_by_channel(conv: DataFrame, owner: str, context_type: str, channel: str) -> DataFrame:
    return not_deleted(conv).filter(
        (F.col("owner") == owner) & (F.col("context.contextType") == context_type)
        & F.array_contains(F.try_element_at("properties", F.lit("channel_id")), channel))


def completed_only(docs: DataFrame) -> DataFrame:
    return docs.filter("completed")


def exclude_conversation(docs: DataFrame, current: DataFrame | str | int) -> DataFrame:
    if isinstance(current, DataFrame):
        return docs.join(current.select("conv_id").distinct(), "conv_id", "left_anti")
    return docs.filter(F.col("conv_id") != current)


def property_matches(doc: Column, asked: Column) -> Column:
    """Any common value; without a value that is not blank the document must not have the field."""
    values = F.filter(F.coalesce(asked, F.array().cast("array<string>")), lambda v: ~is_blank(v))
    return F.when(F.size(values) == 0, doc.isNull()).otherwise(
        F.coalesce(F.arrays_overlap(doc, values), F.lit(False)))


def property_filter(docs: DataFrame, asked: Mapping[str, Sequence[str]], keys: Sequence[str] = ("support_area",)
                    ) -> DataFrame:
    """Documents whose properties match the conversation's, for each of ``keys``."""
    for key in keys:
        values = F.array(*[F.lit(v) for v in asked.get(key, [])]).cast("array<string>")
        docs = docs.filter(property_matches(F.try_element_at("properties", F.lit(key)), values))
    return docs


def matching_pairs(pairs: DataFrame, asked: DataFrame, docs: DataFrame, keys: Sequence[str] = ("support_area",),
                   completed: bool = False) -> DataFrame:
    """Candidate pairs (query_id, conv_id, ...) whose properties match, for all asking conversations in one job.

    ``asked``: conv_id, properties of the asking conversations; ``docs``: conv_id, properties, completed.  Each key is
    matched like in ``property_filter``; with ``completed`` only completed conversations are found.
    """
    theirs = asked.select(F.col("conv_id").alias("query_id"), F.col("properties").alias("_asked"))
    found = docs.select("conv_id", F.col("properties").alias("_found"), F.col("completed").alias("_completed"))
    joined = pairs.join(theirs, "query_id").join(found, "conv_id")
    for key in keys:
        joined = joined.filter(property_matches(*[F.try_element_at(c, F.lit(key)) for c in ("_found", "_asked")]))
    return (joined.filter("_completed") if completed else joined).select(*pairs.columns)


def apply_named_filters(df: DataFrame, filters: Sequence[Mapping], enabled: Mapping[str, bool] | None = None
                        ) -> DataFrame:
    """Filters are ``name``, ``condition``, ``optional`` and ``enabled``; only optional ones can be switched off."""
    switches = enabled or {}
    for spec in filters:
        if not spec.get("optional") or switches.get(spec["name"], spec.get("enabled", False)):
            df = df.filter(spec["condition"])
    return df


def analysable_messages(msg: DataFrame) -> DataFrame:
    """Messages that are not skipped and still have text without code blocks, in ``analysed``."""
    return (msg.filter(~skips()).withColumn("analysed", strip_code_blocks(F.col("content")))
            .filter(~is_blank(F.col("analysed"))))


def build_sections(msg: DataFrame) -> DataFrame:
    """Text sections of the analysis; offsets stay relative to the message."""
    return analysable_messages(msg).select("conv_id", F.col("idx").alias("msg_idx"), "origin",
                                           F.col("analysed").alias("text"))


def section_offsets(sections: DataFrame, separator: str = "\n", rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``offset``: where each section begins in the conversation's sections joined by ``separator``."""
    size = F.length("text") + len(separator)
    local = Window.partitionBy("conv_id", "_bucket").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)

    def derive(totals: DataFrame) -> DataFrame:
        earlier = F.sum("_sum").over(before(["conv_id"], "_bucket"))
        return totals.select("conv_id", "_bucket", F.coalesce(earlier, F.lit(0)).alias("_before"))

    placed = carry(sections.withColumn("_bucket", bucket_of("msg_idx", rows)), ["conv_id"], "_bucket",
                   [F.sum(size).alias("_sum")], derive)
    return placed.withColumn("offset", (F.col("_before") + F.coalesce(F.sum(size).over(local), F.lit(0))).cast(
        "long")).drop("_before", "_bucket")


def section_content(sections: DataFrame, separator: str = "\n", rows: int = BUCKET_ROWS) -> DataFrame:
    """(conv_id, content): all sections of a conversation joined by ``separator``."""
    parts = sections.groupBy("conv_id", bucket_of("msg_idx", rows).alias("_bucket")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("msg_idx", "text"))), lambda e: e["text"]).alias("_texts"))
    whole = F.array_sort(F.collect_list(F.struct("_bucket", "_texts")))
    return parts.groupBy("conv_id").agg(F.array_join(F.flatten(F.transform(whole, lambda p: p["_texts"])), separator)
                                        .alias("content"))


def flatten_properties(conv: DataFrame, blocked: Sequence[str] = NOT_INDEXED) -> DataFrame:
    """One map ``fields`` with ``env_`` and ``meta_`` entries; blank keys, empty values and blocked keys dropped."""

    def prefixed(entries: Column, prefix: str) -> Column:
        kept = F.map_filter(F.coalesce(entries, F.expr("cast(map() as map<string,array<string>>)")),
                            lambda k, v: ~is_blank(k) & v.isNotNull() & (F.size(v) > 0) & ~k.isin(*blocked))
        return F.transform_keys(kept, lambda k, v: F.concat(F.lit(prefix), k))

    return conv.withColumn("fields", F.map_concat(prefixed(F.col("context.environment"), "env_"),
                                                  prefixed(F.col("properties"), "meta_")))


def conversation_rollup(msg: DataFrame) -> DataFrame:
    """Message count and the times of the first and last message in list order."""
    return msg.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.min_by("time", "idx").alias("start_time"),
        F.max_by("time", "idx").alias("end_time"))


def conversation_texts(msg: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """Indexable contents of a conversation in list order, gathered by position bucket first."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "content")))
    parts = indexable_messages(msg).groupBy("conv_id", bucket_of("idx", rows).alias("_bucket")).agg(
        F.transform(ordered, lambda m: m["content"]).alias("_messages"))
    whole = F.array_sort(F.collect_list(F.struct("_bucket", "_messages")))
    return parts.groupBy("conv_id").agg(F.flatten(F.transform(whole, lambda p: p["_messages"])).alias("messages"))


def conversation_docs(conv: DataFrame, msg: DataFrame) -> DataFrame:
    """Conversation-level search documents, one row each."""
    base = flatten_properties(conv).select(
        "conv_id", "owner", F.lit("conversation").alias("type"), F.lit(INDEX_VERSION).alias("version"),
        (F.col("status") == "Complete").alias("completed"), F.col("last_modified").alias("modified"),
        "context.contextType", "context.environmentType", "context.domain", "fields")
    return (base.join(conversation_rollup(msg), "conv_id", "left")
            .join(conversation_texts(msg), "conv_id", "left")
            .withColumn("message_count", F.coalesce("message_count", F.lit(0))))


def message_docs(conv: DataFrame, msg: DataFrame, timeout_s: int = 30) -> DataFrame:
    """Message-level search documents: merged runs with the conversation's fields and the context range."""
    base = flatten_properties(conv).select(
        "conv_id", "owner", (F.col("status") == "Complete").alias("completed"), "fields")
    contexts = message_context(msg).select("conv_id", "idx", F.col("start").alias("context_start"),
                                           F.col("end").alias("context_end"))
    runs = merge_consecutive(msg, timeout_s).join(contexts, ["conv_id", "idx"])
    docs = spread_join(runs.withColumn("_bucket", bucket_of("idx")), base, ["conv_id"], "_bucket").drop("_bucket")
    name = F.when(is_blank(F.col("msg_id")), F.col("idx").cast("string")).otherwise(F.col("msg_id"))
    return docs.withColumn("id", F.concat_ws("_", "conv_id", name)).withColumn(
        "type", F.lit("message")).withColumn("version", F.lit(INDEX_VERSION)).drop("run")


def context_texts(docs: DataFrame, msg: DataFrame) -> DataFrame:
    """Contents of the context of each document without private messages (join on single positions)."""
    positions = docs.filter("context_end > context_start").select(
        "conv_id", F.col("idx").alias("doc_idx"),
        F.explode(F.sequence("context_start", F.col("context_end") - 1)).alias("idx"))
    visible = msg.filter(~F.coalesce(F.col("private"), F.lit(False))).select("conv_id", "idx", "content")
    ordered = F.array_sort(F.collect_list(F.struct("idx", "content")))
    return (positions.join(visible, ["conv_id", "idx"]).groupBy("conv_id", "doc_idx")
            .agg(F.transform(ordered, lambda m: m["content"]).alias("context")))


def public_view(df: DataFrame) -> DataFrame:
    hidden = [c for c in df.columns if c in INTERNAL_COLUMNS or c.startswith(INTERNAL_PREFIXES)]
    return df.drop(*hidden)


def map_results(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename result columns; links take the first of several values, types their last dotted part, dates become epoch
    milliseconds, and rows without a title are dropped."""
    kinds = dict(df.dtypes)

    def value(target: str, source: str) -> Column:
        column = F.col(source)
        if target == "link" and kinds[source].startswith("array"):
            return F.get(column, F.lit(0))
        if target == "type":
            return F.when(F.coalesce(column, F.lit("")) == "", "unknown").otherwise(
                F.substring_index(column, ".", -1))
        if target == "date":
            return F.unix_millis(column)
        return column

    out = df.select(*[value(target, source).alias(target) for target, source in mapping.items() if source])
    return out.filter(F.coalesce(F.col("title"), F.lit("")) != "")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page (numbered from 0); the top-k plan never sorts the whole table."""
    return df.orderBy(*order).offset(number * size).limit(size)


def prefix_search(users: DataFrame, text: str, columns: Sequence[str] = ("login", "email")) -> DataFrame:
    condition = F.lit(False)
    for column in columns:
        condition = condition | F.startswith(F.col(column), F.lit(text))
    return users.filter(condition)


def find_message(conv: DataFrame, msg: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages with the (conv_id, msg_id) pairs of ``wanted`` in conversations that are not deleted."""
    live = not_deleted(conv).select("conv_id")
    return msg.join(wanted, ["conv_id", "msg_id"], "left_semi").join(live, "conv_id", "left_semi")


def exists_message(conv: DataFrame, msg: DataFrame, wanted: DataFrame) -> DataFrame:
    known = find_message(conv, msg, wanted).select("conv_id", "msg_id", F.lit(True).alias("found")).distinct()
    return wanted.join(known, ["conv_id", "msg_id"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def exists_conversation(conv: DataFrame, wanted: DataFrame) -> DataFrame:
    known = not_deleted(conv).select("conv_id", F.lit(True).alias("found"))
    return wanted.join(known, "conv_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def live_ids(conv: DataFrame) -> DataFrame:
    return not_deleted(conv).select("conv_id")


def in_context(msg: DataFrame, starts: DataFrame) -> DataFrame:
    """Messages at or after the context start of their conversation.

    The start is first brought to the position buckets of the conversation, so that no join is on the conversation
    alone when it has very many messages.
    """
    staged = msg.withColumn("_bucket", bucket_of("idx"))
    placed = spread_join(staged, starts.select("conv_id", F.col("start").alias("_start")), ["conv_id"], "_bucket")
    return placed.filter(F.col("idx") >= F.col("_start")).drop("_bucket", "_start")


def context_users(msg: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct users of the context, one row each."""
    return (in_context(msg, starts).filter(F.col("user_id").isNotNull())
            .select("conv_id", "user_id").distinct())


def context_message_ids(msg: DataFrame, starts: DataFrame) -> DataFrame:
    return in_context(msg, starts).select("conv_id", "idx", "msg_id")


def accept_tokens(slots: DataFrame, tokens: DataFrame, min_confidence: float = MIN_TOKEN_CONFIDENCE) -> DataFrame:
    """Slots with their token; the token must exist, have a value and the confidence."""
    usable = tokens.filter(F.col("value").isNotNull() & (F.col("confidence") >= min_confidence))
    return slots.filter(F.col("token_idx") >= 0).join(usable, ["conv_id", "token_idx"])


def user_origin_only(df: DataFrame, msg: DataFrame) -> DataFrame:
    """Rows (conv_id, msg_idx, ...) of messages written by users."""
    return df.join(msg.filter(F.col("origin") == "User").select("conv_id", F.col("idx").alias("msg_idx")),
                   ["conv_id", "msg_idx"], "left_semi")


def adjective_tokens(words: DataFrame, ignored: Sequence[str] = tuple(IGNORED_ADJECTIVES)) -> DataFrame:
    """Attribute tokens: alphabetic adjectives that are neither stop words nor ignored."""
    kept = words.filter(
        (F.col("kind") == "word") & F.col("pos").isin("ADJ", "ADJA", "ADJD") & ~F.coalesce("stopword", F.lit(False))
        & F.col("text").rlike(r"^[\p{L}_-]+$") & ~F.lower("text").isin(*ignored))
    return kept.select("conv_id", F.col("msg_idx").alias("message_idx"), "start", "end",
                       F.col("text").alias("value"), F.lit("Attribute").alias("type"),
                       F.array().cast("array<string>").alias("hints"),
                       F.coalesce("prob", F.lit(0.0)).alias("confidence"))


def list_messages(msg: DataFrame, wanted: DataFrame) -> DataFrame:
    return msg.join(wanted.select("conv_id"), "conv_id", "left_semi").orderBy("conv_id", "idx")


def template_at(templates: DataFrame, index: int) -> DataFrame:
    return templates.filter(F.col("template_idx") == index)


def select_settings(settings: DataFrame, category: str, kind: str | None = None, name: str | None = None,
                    only_enabled: bool = True) -> DataFrame:
    """Components of ``settings`` (client, config map category -> array of struct), enabled ones by default."""
    found = settings.select("client", F.explode(F.try_element_at("config", F.lit(category))).alias("_c"))
    if kind is not None:
        found = found.filter(F.col("_c.type") == kind)
    if name is not None:
        found = found.filter(F.col("_c.name") == name)
    if only_enabled:
        found = found.filter("_c.enabled")
    return found.select("client", "_c.*")


def client_settings(clients: DataFrame, settings: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Settings (client, key, value) per tenant: the tenant's own value, else the default."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("_default")) for k, v in defaults.items()])
    known = clients.select("client").distinct()
    keyed = known.select("client", F.inline(entries))
    own = settings.select("client", "key", F.col("value").alias("_own")).join(known, "client", "left_semi")
    return keyed.join(own, ["client", "key"], "full_outer").select(
        "client", "key", F.coalesce("_own", "_default").alias("value"))


def tag_counts(conv: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Number of conversations per tag, most frequent first."""
    counts = (not_deleted(conv).select(F.explode(F.try_element_at("properties", F.lit("tags"))).alias("tag"))
              .groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag"))
    counts = counts.offset(offset) if offset else counts
    return counts if limit is None else counts.limit(limit)


def tags_matching(conv: DataFrame, pattern: str, limit: int) -> DataFrame:
    tags = not_deleted(conv).select(F.explode(F.try_element_at("properties", F.lit("tags"))).alias("tag")).distinct()
    return tags.filter(F.col("tag").rlike(pattern)).orderBy("tag").limit(limit)


def updated_since(df: DataFrame, since: Column | None, limit: int, key: str = "conv_id",
                  modified: str = "last_modified") -> DataFrame:
    """Oldest ``limit`` rows modified at or after ``since``; None takes all."""
    changed = df if since is None else df.filter(F.col(modified) >= since)
    return changed.select(key, modified).orderBy(modified, key).limit(limit)


def next_cursor(batch: DataFrame, since: Column | None, modified: str = "last_modified") -> DataFrame:
    """The latest time of a batch; one millisecond later when nothing is newer than ``since``."""
    latest = F.max(modified)
    if since is None:
        return batch.agg(latest.alias("cursor"))
    return batch.agg(F.when(latest == since, latest + F.expr("interval 1 millisecond"))
                     .otherwise(F.coalesce(latest, since)).alias("cursor"))


def outdated_count(docs: DataFrame, version: int = INDEX_VERSION) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("version") != version).alias("outdated"))


def last_sync(docs: DataFrame) -> DataFrame:
    return docs.agg(F.max("sync_date").alias("last_sync"))


def sync_counters(changes: DataFrame) -> DataFrame:
    """Numbers of updates and removals of a batch and the share of updates in percent."""
    removed, total = F.count_if(F.col("deleted").isNotNull()), F.count(F.lit(1))
    return changes.agg(total.alias("processed"), removed.alias("removed"), (total - removed).alias("updated"),
                       F.round(F.try_divide(F.lit(100.0) * (total - removed), total), 4).alias("updated_percent"))


def split_changes(changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return changed.filter(F.col("deleted").isNull()), changed.filter(F.col("deleted").isNotNull())


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; the limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)
