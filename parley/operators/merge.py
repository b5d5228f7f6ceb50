"""Changes to stored tables.  Each operator maps the current table and a table of changes to the new table.

Changes are usually few: rows they replace are removed by an anti join, which adaptive execution turns into a broadcast
when the changes are small, so the stored table is not shuffled.  Changes that cannot be applied come back as a second
table with a ``reason``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.functions.text import is_blank, to_slug
from parley.functions.values import coerce_message_field
from parley.lookup import lookup_join
from parley.operators.filters import not_deleted
from parley.scan import BUCKET_ROWS, before, bucket_of, carry, ordinal
from parley.schema import STATUSES

MESSAGE_CAP = 5000
# Fixed value: what a client name may look like.
CLIENT_NAME = r"^[a-z0-9-_\.:]+$"


def newest(changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last change per key."""
    rest = [c for c in changes.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), order).alias("_row")
    return changes.groupBy(*keys).agg(latest).select(*keys, "_row.*")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Replace rows with the same key and add new ones; the last change by ``order`` wins."""
    latest = newest(changes, keys, order) if order else changes
    return current.join(latest.select(*keys), list(keys), "left_anti").unionByName(
        latest.select(*current.columns))


def renumber(msg: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """Dense list positions again, in the order of the present ones."""
    placed = ordinal(msg.withColumn("_bucket", bucket_of("idx", rows)), ["conv_id"], [F.col("idx")], "_bucket",
                     "_position")
    return placed.withColumn("idx", (F.col("_position") - 1).cast("int")).drop("_bucket", "_position")


def append_messages(conv: DataFrame, msg: DataFrame, new: DataFrame, now: Column, cap: int = MESSAGE_CAP,
                    rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Add messages at the end of their conversation, or replace the one with the same id.

    ``new``: message columns without ``idx`` and an arrival number ``seq``.  A blank id gets one derived from the
    content, a missing time becomes ``now``.  Messages of unknown or deleted conversations are rejected.
    """
    known = not_deleted(conv).select("conv_id")
    rejected = new.join(known, "conv_id", "left_anti").withColumn("reason", F.lit("no such conversation"))
    generated = F.substring(F.sha2(F.concat_ws("\x1f", "conv_id", "seq", "content"), 256), 1, 24)
    arrived = (new.join(known, "conv_id", "left_semi")
               .withColumn("msg_id", F.when(is_blank(F.col("msg_id")), generated).otherwise(F.col("msg_id")))
               .withColumn("time", F.coalesce("time", now)))
    first_seen = arrived.groupBy("conv_id", "msg_id").agg(F.min("seq").alias("_first"))
    latest = newest(arrived, ["conv_id", "msg_id"], "seq").join(first_seen, ["conv_id", "msg_id"])
    stored = msg.select("conv_id", "msg_id", F.col("idx").alias("_stored")).join(
        latest.select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_semi")
    placed = latest.join(stored, ["conv_id", "msg_id"], "left")
    replaced = placed.filter(F.col("_stored").isNotNull()).withColumn("idx", F.col("_stored"))
    added = placed.filter(F.col("_stored").isNull()).withColumn("_bucket", bucket_of("_first", rows))
    ends = msg.join(added.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(
        (F.max("idx") + 1).alias("_end"))
    local = Window.partitionBy("conv_id", "_bucket").orderBy("_first")

    def derive(totals: DataFrame) -> DataFrame:
        earlier = totals.select("conv_id", "_bucket", F.coalesce(
            F.sum("_rows").over(before(["conv_id"], "_bucket")), F.lit(0)).alias("_earlier"))
        return earlier.join(ends, "conv_id", "left").select(
            "conv_id", "_bucket", (F.col("_earlier") + F.coalesce("_end", F.lit(0))).alias("_base"))

    added = carry(added, ["conv_id"], "_bucket", [F.count(F.lit(1)).alias("_rows")], derive).withColumn(
        "idx", (F.col("_base") + F.row_number().over(local) - 1).cast("int"))
    kept = msg.join(replaced.select("conv_id", "idx"), ["conv_id", "idx"], "left_anti")
    merged = kept.unionByName(replaced.select(*msg.columns)).unionByName(added.select(*msg.columns))
    # positions are dense, so only conversations that grew beyond the cap shift, all by the same number
    overflow = added.groupBy("conv_id").agg((F.max("idx") + 1 - cap).alias("_drop")).filter("_drop > 0")
    shifted = merged.join(overflow, "conv_id", "left").withColumn(
        "idx", (F.col("idx") - F.coalesce("_drop", F.lit(0))).cast("int"))
    return shifted.filter("idx >= 0").select(*msg.columns), rejected


def update_message(msg: DataFrame, changes: DataFrame, order: str | Column = "time") -> tuple[DataFrame, DataFrame]:
    """Replace messages by id (``changes``: message columns without ``idx``).

    Of several changes of one message the last by ``order`` counts, of equal ones the one with the largest hash.  Changes
    of no stored message and those that a later one overtakes come back with a reason.
    """
    key = ["conv_id", "msg_id"]
    place = Window.partitionBy(*key).orderBy(F.desc(order), F.desc(F.xxhash64("content", "time", "user_id", "votes")))
    ranked = changes.withColumn("_place", F.row_number().over(place))
    last = ranked.filter("_place = 1").drop("_place")
    stored = msg.select(*key, "idx").join(last.select(*key), key, "left_semi")
    matched = last.join(stored, key)
    kept = msg.join(stored.select("conv_id", "idx"), ["conv_id", "idx"], "left_anti")
    unmatched = last.join(stored.select(*key), key, "left_anti").withColumn("reason", F.lit("no such message"))
    overtaken = ranked.filter("_place > 1").drop("_place").withColumn("reason", F.lit("a later change of the message"))
    return kept.unionByName(matched.select(*msg.columns)), unmatched.unionByName(overtaken)


def delete_message(msg: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove messages by id and close the gaps in the list positions of the conversations they were in."""
    touched = ids.select("conv_id").distinct()
    remaining = msg.join(touched, "conv_id", "left_semi").join(
        ids.select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_anti")
    return msg.join(touched, "conv_id", "left_anti").unionByName(renumber(remaining).select(*msg.columns))


def adjust_votes(msg: DataFrame, deltas: DataFrame) -> DataFrame:
    """votes += delta; deltas of one message are summed first."""
    totals = deltas.groupBy("conv_id", "msg_id").agg(F.sum("delta").alias("_delta")).filter("_delta <> 0")
    return msg.join(totals, ["conv_id", "msg_id"], "left").withColumn(
        "votes", (F.coalesce("votes", F.lit(0)) + F.coalesce("_delta", F.lit(0))).cast("int")).drop("_delta").select(
        *msg.columns)


def field_path(path: Column) -> Column:
    """Stored path of a given field name, null for one that cannot be set."""
    full = F.when(F.contains(path, F.lit(".")), path).otherwise(F.concat(F.lit("meta."), path))
    return (F.when(is_blank(path), F.lit(None))
            .when(full.rlike(r"^context\.(contextType|domain|environment\..*)$"), full)
            .when(full == "meta.status", full)
            .when(F.startswith(full, F.lit("meta.")), F.concat(F.lit("meta.properties."), F.substring(full, F.lit(6), F.length(full))))
            .when(F.startswith(full, F.lit("environment.")), F.concat(F.lit("context."), full)))


def _path_changes(conv: DataFrame, changes: DataFrame, allow: Column) -> tuple[DataFrame, DataFrame]:
    """Last valid change per (conversation, path) as one row per conversation, and the rejected changes."""
    live = not_deleted(conv).select("conv_id", F.lit(True).alias("_live"))
    checked = changes.withColumn("_path", field_path(F.col("path"))).join(live, "conv_id", "left")
    valid = F.coalesce(F.col("_live") & F.col("_path").isNotNull() & allow, F.lit(False))
    rejected = checked.filter(~valid).withColumn("reason", F.when(F.col("_live").isNull(), "no such conversation")
                                                 .otherwise("field or value not supported")).drop("_path", "_live")
    latest = newest(checked.filter(valid).drop("_live", "path"), ["conv_id", "_path"], "seq")

    def entries(prefix: str) -> Column:
        hit = F.startswith(F.col("_path"), F.lit(prefix))
        return F.map_from_entries(F.collect_list(F.when(hit, F.struct(
            F.substring(F.col("_path"), F.lit(len(prefix) + 1), F.length("_path")).alias("key"), F.array("value").alias("value")))))

    def single(path: str) -> Column:
        return F.max(F.when(F.col("_path") == path, F.struct(F.col("value"))))

    per_conversation = latest.groupBy("conv_id").agg(
        single("meta.status").alias("_status"), single("context.contextType").alias("_type"),
        single("context.domain").alias("_domain"), entries("meta.properties.").alias("_properties"),
        entries("context.environment.").alias("_environment"))
    return per_conversation, rejected


def _overlay(base: Column, top: Column) -> Column:
    """``top`` over ``base``; keys of ``top`` win."""
    kept = F.map_filter(F.coalesce(base, F.expr("cast(map() as map<string,array<string>>)")),
                        lambda k, v: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def set_field(conv: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Set conversation fields by path (``changes``: conv_id, path, value, seq)."""
    allow = F.col("value").isNotNull() & ((F.col("_path") != "meta.status") | F.col("value").isin(*STATUSES))
    per_conversation, rejected = _path_changes(conv, changes, allow)
    touched = conv.join(per_conversation, "conv_id")
    context = (F.col("context").withField("contextType", F.coalesce(F.col("_type.value"), "context.contextType"))
               .withField("domain", F.coalesce(F.col("_domain.value"), "context.domain"))
               .withField("environment", _overlay(F.col("context.environment"), F.col("_environment"))))
    updated = touched.withColumn("context", context).withColumn(
        "status", F.coalesce(F.col("_status.value"), "status")).withColumn(
        "properties", _overlay(F.col("properties"), F.col("_properties"))).withColumn("last_modified", now)
    untouched = conv.join(per_conversation.select("conv_id"), "conv_id", "left_anti")
    return untouched.unionByName(updated.select(*conv.columns)), rejected


def unset_field(conv: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Remove conversation fields by path; the status cannot be removed."""
    given = changes.withColumn("value", F.lit("")) if "value" not in changes.columns else changes
    per_conversation, rejected = _path_changes(conv, given, F.col("_path") != "meta.status")
    touched = conv.join(per_conversation, "conv_id")

    def without(entries: Column, removed: Column) -> Column:
        return F.map_filter(entries, lambda k, v: ~F.map_contains_key(removed, k))

    context = (F.col("context").withField("contextType", F.when(F.col("_type").isNull(), F.col("context.contextType")))
               .withField("domain", F.when(F.col("_domain").isNull(), F.col("context.domain")))
               .withField("environment", without(F.col("context.environment"), F.col("_environment"))))
    updated = touched.withColumn("context", context).withColumn(
        "properties", without(F.col("properties"), F.col("_properties"))).withColumn("last_modified", now)
    untouched = conv.join(per_conversation.select("conv_id"), "conv_id", "left_anti")
    return untouched.unionByName(updated.select(*conv.columns)), rejected


def set_message_field(msg: DataFrame, changes: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """Set ``field`` of messages (``changes``: conv_id, msg_id, value as text); invalid values come back."""
    coerced = changes.withColumn("_new", coerce_message_field(field, F.col("value")))
    rejected = coerced.filter(F.col("_new").isNull()).drop("_new").withColumn("reason", F.lit("value not supported"))
    valid = coerced.filter(F.col("_new").isNotNull()).select("conv_id", "msg_id", "_new")
    joined = msg.join(valid, ["conv_id", "msg_id"], "left")
    if field.startswith("metadata."):
        key = F.lit(field.split(".", 1)[1])
        others = F.map_filter("metadata", lambda k, v: k != key)
        value = F.when(F.col("_new").isNotNull(), F.map_concat(others, F.create_map(key, "_new"))).otherwise(
            F.col("metadata"))
        return joined.withColumn("metadata", value).select(*msg.columns), rejected
    return joined.withColumn(field, F.coalesce("_new", field)).select(*msg.columns), rejected


def set_status(conv: DataFrame, ids: DataFrame, status: str, now: Column) -> tuple[DataFrame, DataFrame]:
    changes = ids.select("conv_id", F.lit("status").alias("path"), F.lit(status).alias("value"), F.lit(0).alias("seq"))
    return set_field(conv, changes, now)


def mark_deleted(conv: DataFrame, msg: DataFrame, analyses: DataFrame, ids: DataFrame, now: Column
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mark conversations as deleted and drop their user, messages and analyses."""
    gone = not_deleted(conv).join(ids.select("conv_id"), "conv_id", "left_semi").select(
        "conv_id", F.lit(True).alias("_gone"))
    flagged = conv.join(gone, "conv_id", "left")
    now_gone = F.coalesce(F.col("_gone"), F.lit(False))
    marked = (flagged.withColumn("user", F.when(~now_gone, F.col("user")))
              .withColumn("status", F.when(now_gone, "Deleted").otherwise(F.col("status")))
              .withColumn("deleted", F.when(now_gone, now).otherwise(F.col("deleted")))
              .withColumn("last_modified", F.when(now_gone, now).otherwise(F.col("last_modified"))))
    keys = gone.select("conv_id")
    return (marked.select(*conv.columns), msg.join(keys, "conv_id", "left_anti"),
            analyses.join(keys, "conv_id", "left_anti"))


def save_if_unmodified(conv: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Store conversations only where the stored one was not modified after ``seen`` (a column of ``new``)."""
    stored = conv.select("conv_id", F.col("last_modified").alias("_stored"), F.col("deleted").alias("_deleted"))
    checked = new.join(stored, "conv_id", "left")
    current = F.coalesce((F.col("_stored") <= F.col("seen")) & F.col("_deleted").isNull(), F.lit(False))
    conflicts = checked.filter(~current).select(
        "conv_id", F.when(F.col("_stored").isNull() | F.col("_deleted").isNotNull(), "no such conversation")
        .otherwise("modified later").alias("reason"))
    accepted = checked.filter(current).withColumn("last_modified", now).select(*conv.columns)
    return upsert(conv, accepted, ["conv_id"]), conflicts


def append_if_size(msg: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split messages into those whose conversation has the ``expected_size`` they were written for, and conflicts."""
    sizes = msg.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_size"))
    checked = new.join(sizes, "conv_id", "left").withColumn(
        "_ok", F.coalesce("_size", F.lit(0)) == F.col("expected_size"))
    return checked.filter("_ok").drop("_ok", "_size"), checked.filter("not _ok").drop("_ok", "_size")


def upsert_analysis(analyses: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(analyses, new, ["conv_id", "client"], "date")


def upsert_chat_docs(docs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``docs``: client, id, data, removed, modified.  ``new``: client, id, data, seq."""
    latest = newest(new, ["client", "id"], "seq").withColumn("removed", F.lit(False)).withColumn("modified", now)
    return upsert(docs, latest.select(*docs.columns), ["client", "id"])


def remove_chat_docs(docs: DataFrame, removals: DataFrame, now: Column) -> DataFrame:
    """Leave tombstones without data; a null id in ``removals`` (client, id) removes all documents of the client."""
    whole = removals.filter(F.col("id").isNull()).select("client", F.lit(True).alias("_all")).distinct()
    single = removals.filter(F.col("id").isNotNull()).select("client", "id", F.lit(True).alias("_one")).distinct()
    flagged = docs.join(whole, "client", "left").join(single, ["client", "id"], "left")
    gone = F.coalesce("_all", "_one", F.lit(False)) & ~F.col("removed")
    return (flagged.withColumn("data", F.when(~gone, F.col("data")))
            .withColumn("modified", F.when(gone, now).otherwise(F.col("modified")))
            .withColumn("removed", F.col("removed") | gone).select(*docs.columns))


def backfill_property(conv: DataFrame, areas: DataFrame) -> DataFrame:
    """Fill a missing support_area of the environment from ``areas`` (channel_id, support_area)."""
    environment = F.col("context.environment")
    channel = F.get(F.try_element_at(environment, F.lit("channel_id")), F.lit(0))
    missing = F.try_element_at(environment, F.lit("support_area")).isNull()
    keyed = conv.withColumn("_channel", F.when(missing, channel))
    joined = lookup_join(keyed, areas.select(F.col("channel_id").alias("_channel"), F.col("support_area").alias(
        "_area")), ["_channel"], "left", salt_by=[F.col("conv_id")])
    filled = F.when(F.col("_area").isNotNull(), F.map_concat(
        F.map_filter(environment, lambda k, v: k != "support_area"),
        F.create_map(F.lit("support_area"), F.array("_area")))).otherwise(environment)
    return joined.withColumn("context", F.col("context").withField("environment", filled)).select(*conv.columns)


def derive_clients(conv: DataFrame, clients: DataFrame, settings: DataFrame, default_config: Column, now: Column
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tenants from the domains of conversations without owner; the conversations and settings that follow from it.

    ``clients``: client, name, default_client, last_update.  ``settings``: client, config, modified.
    """
    domains = (conv.filter(F.col("owner").isNull() & F.col("context.domain").isNotNull())
               .select(F.col("context.domain").alias("name")).distinct()
               .join(clients.select("name"), "name", "left_anti"))
    created = domains.select(F.sha2("name", 256).substr(1, 24).alias("client"), "name",
                             F.lit(False).alias("default_client"), now.alias("last_update"))
    all_clients = clients.unionByName(created)
    owners = all_clients.select(F.col("name").alias("_domain"), F.col("client").alias("_client"))
    keyed = conv.withColumn("_domain", F.when(F.col("owner").isNull(), F.col("context.domain")))
    owned = lookup_join(keyed, owners, ["_domain"], "left", salt_by=[F.col("conv_id")]).withColumn(
        "owner", F.coalesce("owner", "_client")).select(*conv.columns)
    added = all_clients.join(settings.select("client"), "client", "left_anti").select(
        "client", default_config.alias("config"), now.alias("modified"))
    return owned, all_clients, settings.unionByName(added)


def restructure_meta(conv: DataFrame) -> DataFrame:
    """Move tags, channel and support area into the property map of conversations that have none.

    Old columns: ``tags`` and the environment entries.
    """
    environment = F.col("context.environment")

    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    candidates = F.array(entry("tags", F.col("tags")),
                         entry("channel_id", F.try_element_at(environment, F.lit("channel_id"))),
                         entry("support_area", F.try_element_at(environment, F.lit("support_area"))))
    moved = F.map_from_entries(F.filter(candidates, lambda e: e["value"].isNotNull()))
    return conv.withColumn("properties", F.coalesce("properties", moved)).drop("tags")


def decode_defaults(values: Column) -> Column:
    """URI-decode map values; what cannot be decoded stays as it is.  ``+`` is not a space in this encoding."""
    return F.transform_values(values, lambda k, v: F.coalesce(
        F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v))


def drop_legacy_columns(df: DataFrame, names: Sequence[str] = ("channelId", "tokens", "queryTemplates",
                                                               "lastMessageAnalyzed")) -> DataFrame:
    return df.drop(*names)


def add_component_if_absent(components: Column, present: str, added: str) -> Column:
    """Append a component of type ``added``, enabled like the first one of type ``present``, if it is missing."""
    model = F.get(F.filter(components, lambda c: c["type"] == present), F.lit(0))
    new = F.struct(F.lit(added).alias("type"), F.lit(added).alias("name"), model["enabled"].alias("enabled"))
    needed = F.exists(components, lambda c: c["type"] == present) & ~F.exists(
        components, lambda c: c["type"] == added)
    return F.when(needed, F.array_append(components, new)).otherwise(components)


def store_conversations(conv: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Insert or replace whole conversations.

    A conversation marked as deleted is refused, a new one needs an owner, and an owner cannot change (a missing one is
    taken from the stored conversation).
    """
    stored = conv.select("conv_id", F.col("owner").alias("_owner"), F.lit(True).alias("_known"))
    checked = new.join(stored, "conv_id", "left")
    reason = (F.when(F.col("deleted").isNotNull(), "marked as deleted")
              .when(F.col("_known").isNull() & F.col("owner").isNull(), "owner missing")
              .when(F.col("_known") & F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("_owner")),
                    "owner must not change"))
    checked = checked.withColumn("reason", reason)
    accepted = (checked.filter(F.col("reason").isNull()).withColumn("owner", F.coalesce("owner", "_owner"))
                .withColumn("last_modified", now).select(*conv.columns))
    rejected = checked.filter(F.col("reason").isNotNull()).select("conv_id", "reason")
    return upsert(conv, accepted, ["conv_id"]), rejected


def upsert_clients(clients: DataFrame, new: DataFrame, settings: DataFrame, now: Column
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert or replace tenants (``new``: client, name, default_client, seq).

    Names must follow the pattern and be unique; the last new default tenant replaces the one before.  Tenants without
    settings start with a copy of the settings of the default tenant.
    """
    taken = clients.select("name", F.col("client").alias("_holder"))
    first = new.groupBy("name").agg(F.min("seq").alias("_first"))
    checked = new.join(taken, "name", "left").join(first, "name", "left")
    reason = (F.when(~F.col("name").rlike(CLIENT_NAME) | F.col("name").isNull(), "name does not match")
              .when(F.col("_holder").isNotNull() & (F.col("_holder") != F.col("client")), "name is taken")
              .when(F.col("seq") > F.col("_first"), "name is taken"))
    checked = checked.withColumn("reason", reason)
    accepted = checked.filter(F.col("reason").isNull())
    rejected = checked.filter(F.col("reason").isNotNull()).select("client", "name", "reason")
    merged = upsert(clients, accepted.withColumn("last_update", now).select(*clients.columns), ["client"])
    # one row at most: the newest default tenant among the new ones
    chosen = accepted.filter("default_client").agg(F.max_by("client", "seq").alias("chosen")).scalar()
    merged = merged.withColumn("default_client", F.when(chosen.isNotNull(), F.col("client") == chosen).otherwise(
        F.col("default_client")))
    def settings_of(tenants: DataFrame) -> Column:
        own = settings.join(tenants.filter("default_client").select("client"), "client", "left_semi")
        return own.agg(F.max("config").alias("config")).scalar()

    # a new default tenant may have no settings itself; those of the one before serve then
    model = F.coalesce(settings_of(merged), settings_of(clients))
    added = merged.join(settings.select("client"), "client", "left_anti").select("client", model.alias("config"))
    return merged, settings.unionByName(added), rejected


def validate_settings(settings: DataFrame, known_types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Complete component names and report conflicts.

    ``settings``: client, category, type, name, display_name, position.  A missing name is the slug of the display name
    and the other way round; the second component of the same category, type and name conflicts; unknown types are
    kept but marked ``unbound``.
    """
    name, display = F.col("name"), F.col("display_name")
    completed = settings.withColumns({
        "name": F.when(is_blank(display), name).when(is_blank(name), to_slug(display)).otherwise(name),
        "display_name": F.when(is_blank(display), name).otherwise(display),
        "unbound": ~F.col("type").isin(*known_types)})
    identity = ["client", "category", "type", "name"]
    nameless = is_blank(name)
    first = completed.filter(~nameless).groupBy(*identity).agg(F.min("position").alias("_first"))
    checked = completed.join(first, identity, "left")
    repeated = F.coalesce(F.col("position") > F.col("_first"), F.lit(False))
    conflicts = checked.filter(nameless | repeated).select(
        "client", "category", "position", F.when(nameless, "displayName").otherwise("name").alias("field"))
    return checked.filter(~nameless & ~repeated).drop("_first"), conflicts
