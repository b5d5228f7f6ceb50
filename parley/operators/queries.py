"""From templates to suggested queries, and the freshness of stored analyses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.text import highlight, shortest_window, words
from parley.functions.values import TITLE_BOOST, phrase_query
from parley.lookup import lookup_join
from parley.operators import search as s
from parley.operators.annotate import build_templates, index_tokens, valid_templates
from parley.operators.filters import accept_tokens, context_message_ids, context_users, in_context
from parley.operators.windows import context_start

QUERY_CONFIDENCE = {"solrsearch": 0.8, "google": 0.8, "conversationsearch": 0.6, "conversationmlt": 0.55}


def _by_confidence(value: Column) -> Column:
    """Values in the order of falling confidence; equal confidences in token order."""
    ordered = F.array_sort(F.collect_list(F.struct(
        (-F.col("confidence")).alias("_c"), F.col("token_idx").alias("_i"), value.alias("_v"))))
    return F.transform(ordered, lambda e: e["_v"])


def latch_query(slots: DataFrame, tokens: DataFrame, location_field: str | None = "location",
                text_field: str | None = "text", title_field: str | None = "title") -> DataFrame:
    """Search phrases of the accepted slots by confidence, joined by OR.

    Location slots search the location field, full-text slots the text field, and both the title with a higher boost.
    A field given as None is not searched; templates without phrases still give an (empty) query.
    """
    filled = accept_tokens(slots, tokens)

    def phrases(role: str, field: str | None) -> Column:
        here = F.col("role") == role
        wanted = []
        if field is not None:
            wanted.append(phrase_query(F.col("value"), F.lit(field), F.col("confidence")))
        if title_field is not None and (field is not None or role == "alphabet"):
            wanted.append(phrase_query(F.col("value"), F.lit(title_field), F.col("confidence"), TITLE_BOOST))
        return F.when(here, F.array_compact(F.array(*wanted)))

    params = F.coalesce(phrases("location", location_field), phrases("alphabet", text_field),
                        F.array().cast("array<string>"))
    built = filled.withColumn("_p", params).groupBy("conv_id", "template_idx").agg(
        F.flatten(_by_confidence(F.col("_p"))).alias("params"))
    templates = slots.select("conv_id", "template_idx").distinct()
    return templates.join(built, ["conv_id", "template_idx"], "left").select(
        "conv_id", "template_idx", F.coalesce("params", F.array().cast("array<string>")).alias("params")).withColumn(
        "query", F.array_join("params", " OR ")).withColumn("confidence", F.lit(0.8))


def web_query(slots: DataFrame, tokens: DataFrame) -> DataFrame:
    """Values of location and full-text slots by confidence, joined by a space."""
    usable = accept_tokens(slots.filter(F.col("role").isin("location", "alphabet")), tokens)
    return usable.groupBy("conv_id", "template_idx").agg(_by_confidence(F.col("value")).alias("params")).withColumn(
        "query", F.array_join("params", " ")).withColumn("confidence", F.lit(0.8))


def related_search_query(slots: DataFrame, tokens: DataFrame, starts: DataFrame, similarity: DataFrame | None = None,
                         defaults: Mapping[str, str] | None = None) -> DataFrame:
    """One row per conversation: keywords and terms at or after the context start, each value once, in token order."""
    inside = accept_tokens(slots.filter(F.col("role").isin("Keyword", "Term")), tokens, 0.0).join(
        starts.select("conv_id", F.col("start").alias("_start")), "conv_id").filter(
        (F.col("message_idx") >= F.col("_start")) & (F.col("value") != ""))
    first = inside.groupBy("conv_id", "role", "value").agg(F.min("token_idx").alias("_at"))

    def values(role: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("_at", "value"))))
        return F.transform(ordered, lambda e: e["value"])

    built = first.groupBy("conv_id").agg(values("Keyword").alias("keywords"), values("Term").alias("terms"))
    entries = [F.lit(x) for pair in (defaults or {"rows": "3"}).items() for x in pair]
    built = starts.select("conv_id").join(built, "conv_id", "left").withColumn("defaults", F.create_map(*entries))
    if similarity is not None:
        built = built.join(similarity, "conv_id", "left")
    return built


def context_terms(msg: DataFrame, tf: DataFrame, stats: DataFrame, n_docs: Column, scope: Sequence[str] = (),
                  max_terms: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Interesting terms of the context as they are written in it, with relevance; its users; its message ids."""
    starts = context_start(msg)
    best = s.interesting_terms(tf, stats, n_docs, [*scope, "conv_id"], scope, max_terms)
    words = s.analyze_text(in_context(msg, starts).select("conv_id", "idx", "content"), "content").withColumn(
        "_at", F.struct("idx", "pos"))
    surfaced = s.term_to_surface(best.select(*scope, "conv_id", "term", "rank", F.col("boost").alias("relevance")),
                                 words, ["conv_id"])
    return surfaced, context_users(msg, starts), context_message_ids(msg, starts)


def route_by_creator(queries: DataFrame, settings: DataFrame) -> DataFrame:
    """Query builder type and component settings behind the ``creator`` string ``queryBuilder:type[:name]``.

    ``settings``: client, type, name, ...  A named component that is not configured gives ``routed`` = false.
    """
    parts = F.split("creator", ":")
    split = queries.withColumn("_type", F.get(parts, F.lit(1))).withColumn("_name", F.get(parts, F.lit(2)))
    known = settings.select("client", F.col("type").alias("_type"), F.col("name").alias("_name"),
                            F.lit(True).alias("_found")).distinct()
    joined = lookup_join(split, known, ["client", "_type", "_name"], "left")
    return joined.withColumn("routed", F.col("_type").isNotNull() & (
        F.col("_name").isNull() | F.coalesce("_found", F.lit(False)))).withColumnRenamed(
        "_type", "builder").withColumnRenamed("_name", "component").drop("_found")


def keep_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """New queries with the state a user gave the query of the same template and creator."""
    states = old.filter(F.col("state").isNotNull() & F.col("creator").isNotNull()).select(
        "conv_id", "template_idx", "creator", F.col("state").alias("_state"))
    return new.join(states, ["conv_id", "template_idx", "creator"], "left").withColumn(
        "state", F.coalesce("_state", "state")).drop("_state")


def analysis_keys(conv: DataFrame, settings: DataFrame) -> DataFrame:
    """(conv_id, client, date): the later of the conversation's and the settings' modification."""
    changed = settings.select("client", F.col("modified").alias("_changed"))
    owned = conv.select("conv_id", F.col("owner").alias("client"), "last_modified")
    return lookup_join(owned, changed, ["client"], "left").select(
        "conv_id", "client", F.greatest("last_modified", "_changed").alias("date"))


def fresh_analyses(conv: DataFrame, settings: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored analyses that are still valid, and the keys of those that must be made again."""
    keys = analysis_keys(conv, settings)
    on = ["conv_id", "client", "date"]
    return analyses.join(keys, on, "left_semi"), keys.join(analyses.select(*on), on, "left_anti")


def build_queries(slots: DataFrame, tokens: DataFrame, starts: DataFrame, settings: DataFrame,
                  owners: DataFrame, similarity: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
    """Suggested queries of every enabled component for the valid templates it accepts.

    ``settings``: client, type, name, enabled.  ``owners``: conv_id, client.
    """
    valid = valid_templates(slots, tokens).filter("valid").select("conv_id", "template_idx", "template_type")
    usable = slots.join(valid.select("conv_id", "template_idx"), ["conv_id", "template_idx"], "left_semi")
    latch = latch_query(usable.filter(F.col("template_type") == "ir_latch"), tokens).select(
        "conv_id", "template_idx", "query")
    web = web_query(usable.filter(F.col("template_type") == "ir_latch"), tokens).select(
        "conv_id", "template_idx", "query")
    found = related_search_query(usable, tokens, starts).select("conv_id", F.array_join(
        F.concat(F.coalesce("keywords", F.array().cast("array<string>")),
                 F.coalesce("terms", F.array().cast("array<string>"))), " ").alias("query"))
    related = valid.filter(F.col("template_type") == "related.conversation").join(found, "conv_id").select(
        "conv_id", "template_idx", "query")
    parts = [latch.withColumn("type", F.lit("solrsearch")), web.withColumn("type", F.lit("google")),
             related.withColumn("type", F.lit("conversationsearch"))]
    if similarity is not None:
        alternative = related.join(similarity, "conv_id", "left").select(
            "conv_id", "template_idx", s.fallback_query(F.lit(None), F.col("similarity_query")).alias("query"))
        parts.append(alternative.withColumn("type", F.lit("conversationmlt")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    enabled = settings.filter("enabled").select("client", "type", "name")
    confidence = F.create_map(*[F.lit(x) for pair in QUERY_CONFIDENCE.items() for x in pair])
    queries = lookup_join(merged.join(owners, "conv_id"), enabled, ["client", "type"]).select(
        "conv_id", "template_idx", F.concat_ws(":", F.lit("queryBuilder"), "type", "name").alias("creator"),
        F.coalesce("query", F.lit("")).alias("query"), F.try_element_at(confidence, F.col("type")).alias("confidence"),
        F.lit("Suggested").alias("state"))
    return queries if old is None else keep_states(old, queries)


def reapply_tokens(edited: DataFrame, starts: DataFrame, settings: DataFrame, owners: DataFrame,
                   old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Templates and queries of a token table that a user edited; rejected tokens take no part."""
    tokens = index_tokens(edited.drop("token_idx")) if "token_idx" in edited.columns else index_tokens(edited)
    slots = build_templates(tokens.filter(F.coalesce("state", F.lit("Suggested")) != "Rejected"))
    return slots, build_queries(slots, tokens, starts, settings, owners, old=old)


def search_chat_docs(docs: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """Documents of the asking tenant that match each query, with score and marked text.

    ``docs``: client, id, ``text``, removed.  ``queries``: query_id, client, text.
    """
    live = docs.filter(~F.col("removed")).select("client", "id", F.col(text).alias("text"))
    terms = s.postings(live, ["id", "client"], "text")
    sized = live.select(F.size(F.array_remove(F.split("text", r"[^\p{L}\p{N}]+"), "")).alias("len"))
    hits = s.search(terms, sized, queries, ["id"], ["client"], wildcards=False)
    words = s.query_clauses(queries).groupBy("query_id").agg(F.array_sort(F.collect_set("clause")).alias("_words"))
    return (hits.join(words, "query_id").join(live, ["client", "id"])
            .withColumn("highlight", highlight(F.col("text"), F.col("_words"))).drop("_words", "text"))


def passages(hits: DataFrame, docs: DataFrame, queries: DataFrame, keys: Sequence[str] = ("client", "id"),
             text: str = "text") -> DataFrame:
    """``hits`` with the passage of their document that shows best why they match.

    The passage is the shortest run of words with every word of the query that the document has: ``first_word``,
    ``last_word`` (positions from 0) and ``passage``, its words with one space between and the query's words marked.  All
    three are null where only parts of words match.  Whole texts are read, each in its own row.
    """
    asked = s.query_clauses(queries).filter("mode = 'exact'").groupBy("query_id").agg(
        F.array_sort(F.collect_set("clause")).alias("_asked"))
    found = hits.join(asked, "query_id", "left").join(docs.select(*keys, words(F.col(text)).alias("_words")), list(keys))
    none = F.array().cast("array<string>")
    found = found.withColumn("_asked", F.coalesce("_asked", none)).withColumn(
        "_best", shortest_window(F.transform("_words", F.lower), F.col("_asked")))
    first, last = F.col("_best.first"), F.col("_best.last")
    shown = F.when(F.col("_best").isNotNull(), highlight(F.array_join(
        F.slice("_words", first + 1, last - first + 1), " "), F.col("_asked")))
    return found.select(*hits.columns, first.alias("first_word"), last.alias("last_word"), shown.alias("passage"))
