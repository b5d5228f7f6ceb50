"""Operators over spans and tokens of messages.

Spans (sentences, chunks, words with their annotations) are input.  A group is one message, whose text is one row of
the message table; matches inside it are window scans in text order, so no pairs of spans are formed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from parley.functions.text import extract_urls, is_all_upper, is_blank, strip_code_blocks
from parley.functions.values import (
    DEFAULT_ENTITY_CONFIDENCE, entity_hint, entity_type, fold_probability, sum_probability, topic_hierarchy)
from parley.lookup import lookup_join
from parley.operators.filters import adjective_tokens
from parley.operators.search import interesting_terms
from parley.operators.windows import skips
from parley.scan import bucket_of, ordinal, running_max_before
from parley.schema import TOKEN, TOKEN_TYPES
from parley.session import cut_lineage, written

MESSAGE = ("conv_id", "msg_idx")
NOUNS = ("NOUN", "PROPN", "NN", "NE")
ADJECTIVES = ("ADJ", "ADJA", "ADJD")
NUMBERS = ("NUM", "CARD")
ADPOSITIONS = ("ADP", "APPR", "APPRART")
LOCATION, ORGANIZATION = "location", "organization"
MIN_TOPIC_CONFIDENCE = 0.1
TOKEN_COLUMNS = ("conv_id", "message_idx", "start", "end", "value", "type", "hints", "confidence")


def _is(column: Column, values: Sequence[str]) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False))


def message_words(msg: DataFrame) -> DataFrame:
    """Words of each message with their offsets: a span source that needs no language model."""
    pieces = msg.select("conv_id", F.col("idx").alias("msg_idx"), F.posexplode(F.regexp_extract_all(
        F.concat("content", F.lit(" ")), F.lit(r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+"), F.lit(0))).alias("_n", "text"))
    before = Window.partitionBy(*MESSAGE).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))
    return (placed.filter(F.col("text").rlike(r"^[\p{L}\p{N}]"))
            .withColumn("end", (F.col("start") + F.length("text")).cast("int")).drop("_n"))


def url_entities(msg: DataFrame) -> DataFrame:
    """Web addresses in messages as entity chunks."""
    return msg.select("conv_id", F.col("idx").alias("msg_idx"), F.lit("chunk").alias("kind"),
                      F.inline(extract_urls(F.col("content"))))


TRIE_DEPTH = 4


def label_trie(entries: DataFrame) -> DataFrame:
    """(parent, word, child, more, ends): the first words of all keys as edges of a trie, each once.

    ``more``: keys go on below the child; ``ends``: a key ends there.  A node is a hash of the words that lead to it, the
    root is 0.  ``entries``: ``_key``, words parted by spaces.
    """
    words = F.split("_key", " ")

    def step(state: Column, word: Column) -> Column:
        child = F.xxhash64(state["node"], word)
        edge = F.struct(state["node"].alias("parent"), word.alias("word"), child.alias("child"))
        return F.struct(child.alias("node"), F.concat(state["path"], F.array(edge)).alias("path"))

    none = F.array().cast("array<struct<parent:bigint,word:string,child:bigint>>")
    path = F.aggregate(F.slice(words, 1, TRIE_DEPTH), F.struct(F.lit(0).cast("bigint").alias("node"), none.alias("path")),
                       step)["path"]
    steps = entries.select(F.size(words).alias("_size"), F.posexplode(path).alias("_n", "_edge"))
    return steps.groupBy("_edge.parent", "_edge.word", "_edge.child").agg(
        F.max(F.col("_n") + 1 < F.col("_size")).alias("more"), F.max(F.col("_n") + 1 == F.col("_size")).alias("ends"))


def _trie_node(key: str) -> Column:
    """The deepest node that a key reaches."""
    return F.aggregate(F.slice(F.split(key, " "), 1, TRIE_DEPTH), F.lit(0).cast("bigint"), lambda node, word: F.xxhash64(node, word))


def vocabulary_entities(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Dictionary matches as Term tokens with the label of the entry as value.

    ``vocabulary``: label, surface.  Surfaces written all upper case must match exactly, others without case.  The first
    words of all labels are a trie: a round takes the places that still match one word further, so a long label costs
    nothing to words that do not begin it.  The rest of a label longer than the trie is compared where its beginning is.
    """
    entries = vocabulary.select("label", F.trim(F.regexp_replace("surface", r"[^\p{L}\p{N}]+", " ")).alias("_entry"))
    entries = entries.filter(F.col("_entry") != "").withColumn("_key", F.lower("_entry")).distinct()
    entries = written(entries.withColumn("_words", F.size(F.split("_key", " "))), "labels")
    depth = entries.agg(F.max("_words")).first()[0] or 0
    edges = written(label_trie(entries), "trie")
    numbered = written(words.select(*MESSAGE, "start", "end", "text", F.row_number().over(
        Window.partitionBy(*MESSAGE).orderBy("start")).alias("_at"), F.lower("text").alias("word")), "words")
    place = numbered.select(*MESSAGE, "start", "end", "_at", "word", F.col("text").alias("surface"),
                            F.lit(0).cast("bigint").alias("parent"))
    following = numbered.select(*MESSAGE, (F.col("_at") - 1).alias("_at"), F.col("end").alias("_end"), "text", "word")
    reached = []
    for _ in range(min(depth, TRIE_DEPTH)):
        reached.append(written(lookup_join(place, edges, ["parent", "word"]).drop("parent", "word"), "places"))
        place = reached[-1].filter("more").join(following, [*MESSAGE, "_at"]).select(
            *MESSAGE, "start", F.col("_end").alias("end"), (F.col("_at") + 1).alias("_at"), "word",
            F.concat_ws(" ", "surface", "text").alias("surface"), F.col("child").alias("parent"))
    columns = [*MESSAGE, "start", "end", "surface", F.lower("surface").alias("_key")]
    matched = place.limit(0).select(*columns)
    for step in reached:
        matched = matched.unionByName(step.filter("ends").select(*columns))
    # nodes are hashes: the text itself decides
    hits = lookup_join(matched, entries, ["_key"]).select(*MESSAGE, "start", "end", "surface", "label", "_entry")
    if depth > TRIE_DEPTH:
        longer = entries.filter(F.col("_words") > TRIE_DEPTH).withColumn("child", _trie_node("_key"))
        begun = lookup_join(reached[-1].filter("more").select(*MESSAGE, "start", (F.col("_at") - TRIE_DEPTH + 1).alias("_at"),
                                                              "child"), longer, ["child"])
        whole = numbered.join(begun.select(*MESSAGE).distinct(), list(MESSAGE), "left_semi").groupBy(*MESSAGE).agg(
            F.array_sort(F.collect_list(F.struct("_at", "text", "end"))).alias("_all"))
        told = begun.join(whole, list(MESSAGE)).withColumn("_own", F.slice("_all", F.col("_at"), F.col("_words"))).withColumn(
            "surface", F.array_join(F.transform("_own", lambda w: w["text"]), " "))
        hits = hits.unionByName(told.filter(F.lower("surface") == F.col("_key")).select(
            *MESSAGE, "start", F.element_at("_own", -1)["end"].alias("end"), "surface", "label", "_entry"))
    exact = ~is_all_upper(F.col("_entry")) | (F.col("_entry") == F.col("surface"))
    return hits.filter(exact).select(
        "conv_id", F.col("msg_idx").alias("message_idx"), "start", "end", F.col("label").alias("value"),
        F.lit("Term").alias("type"), F.array().cast("array<string>").alias("hints"),
        F.lit(1.0).alias("confidence")).distinct()


def remove_stopwords(tokens: DataFrame, stop: DataFrame, lang: str | None = None) -> DataFrame:
    """Drop tokens whose value is a stop word of the default list or of the language.

    ``stop``: lang (null = default), key (lower case), variants.  Values written all upper case need an exact variant.
    """
    lists = stop.filter(F.col("lang").isNull() | (F.col("lang") == lang)) if lang else stop.filter("lang is null")
    merged = lists.groupBy(F.col("key").alias("_key")).agg(
        F.array_distinct(F.flatten(F.collect_list("variants"))).alias("_variants"))
    keyed = tokens.withColumn("_key", F.lower("value"))
    joined = lookup_join(keyed, merged, ["_key"], "left")
    hit = F.col("_variants").isNotNull() & (~is_all_upper(F.col("value"))
                                            | F.array_contains("_variants", F.col("value")))
    return joined.filter(~F.coalesce(hit, F.lit(False))).drop("_key", "_variants")


def filter_tokens(tokens: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """Drop tokens any of the ``filters`` matches."""
    drop = F.lit(False)
    for condition in filters:
        drop = drop | F.coalesce(condition, F.lit(False))
    return tokens.filter(~drop)


def mark_negated(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the hint ``negated`` to tokens inside a negated chunk: the furthest end of the negated chunks that start at
    or before the token must reach its end."""
    marked = tokens.withColumn("_token", F.struct(*tokens.columns))
    events = marked.select("conv_id", "message_idx", "start", F.lit(1).alias("_order"), F.lit(None).cast("int").alias(
        "_reach"), "_token")
    negated = chunks.filter(F.coalesce("negated", F.lit(False))).select(
        "conv_id", F.col("msg_idx").alias("message_idx"), "start", F.lit(0).alias("_order"),
        F.col("end").alias("_reach"), F.lit(None).cast(marked.schema["_token"].dataType).alias("_token"))
    order = Window.partitionBy("conv_id", "message_idx").orderBy("start", "_order").rowsBetween(
        Window.unboundedPreceding, 0)
    reached = events.unionByName(negated).withColumn("_until", F.max("_reach").over(order)).filter(
        F.col("_token").isNotNull())
    hints = F.when(F.col("_until") >= F.col("end"), F.array_union(
        "hints", F.array(F.lit("negated")))).otherwise(F.col("hints"))
    return reached.select("_token.*", "_until").withColumn("hints", hints).drop("_until")


def entities_with_content_word(entities: DataFrame, words: DataFrame) -> DataFrame:
    """Entities (conv_id, message_idx, start, end, ...) that cover a noun, an adjective, or an alphanumeric word without
    part of speech: among the content words starting at or after the entity the nearest end must lie inside it."""
    content = words.filter(_is(F.col("pos"), NOUNS + ADJECTIVES)
                           | (F.col("pos").isNull() & F.col("text").rlike(r"[\p{L}\p{Nd}]")))
    marked = entities.withColumn("_entity", F.struct(*entities.columns))
    events = marked.select("conv_id", "message_idx", "start", F.lit(1).alias("_order"),
                           F.lit(None).cast("int").alias("_word_end"), "_entity")
    word_events = content.select(
        "conv_id", F.col("msg_idx").alias("message_idx"), "start", F.lit(0).alias("_order"),
        F.col("end").alias("_word_end"), F.lit(None).cast(marked.schema["_entity"].dataType).alias("_entity"))
    order = Window.partitionBy("conv_id", "message_idx").orderBy(F.desc("start"), "_order").rowsBetween(
        Window.unboundedPreceding, 0)
    nearest = events.unionByName(word_events).withColumn("_nearest", F.min("_word_end").over(order))
    return nearest.filter(F.col("_entity").isNotNull() & (F.col("_nearest") <= F.col("_entity.end"))).select("_entity.*")


def match_terms_to_words(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Nouns and adjectives whose text, stem or lemma, as written or lower case, is a term of their message's context.

    ``terms``: conv_id, term, and further columns.  ``words``: word spans, optionally with ``stem``.
    """
    forms = [F.col("text"), F.col("lemma")] + ([F.col("stem")] if "stem" in words.columns else [])
    both = F.array_distinct(F.array_compact(F.array(*forms, *[F.lower(c) for c in forms])))
    candidates = words.filter(_is(F.col("pos"), NOUNS + ADJECTIVES)).withColumn("term", F.explode(both))
    return candidates.join(terms, ["conv_id", "term"])


def keyword_phrases(words: DataFrame, sections: DataFrame, annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """Keyword tokens: runs of nouns, adjectives and numbers, joined by adpositions, that end at their last noun.

    A run ends before any other word and after a word that closes a sentence or noun phrase.  The confidence is the mean
    probability per source of the interesting terms in the phrase, folded over the sources.  ``words``: word spans;
    ``sections``: spans whose ends close a run; ``annotations``: conv_id, msg_idx, start, source, prob of interesting
    words; ``texts``: conv_id, msg_idx, text.
    """
    closing = sections.select(*MESSAGE, "end", F.lit(True).alias("_closes")).distinct()
    tagged = words.join(closing, [*MESSAGE, "end"], "left").select(
        *MESSAGE, "start", "end", F.coalesce("_closes", F.lit(False)).alias("_closes"),
        _is(F.col("pos"), NOUNS).alias("_noun"), _is(F.col("pos"), NOUNS + ADJECTIVES + NUMBERS).alias("_interesting"),
        (_is(F.col("pos"), ADPOSITIONS) & F.col("text").rlike(r"\p{L}")).alias("_connecting"))
    tagged = tagged.withColumn("_member", F.col("_interesting") | F.col("_connecting"))
    order = Window.partitionBy(*MESSAGE).orderBy("start")
    opens = (~F.col("_member") | ~F.coalesce(F.lag("_member").over(order), F.lit(False))
             | F.coalesce(F.lag("_closes").over(order), F.lit(False)))
    numbered = tagged.withColumn("_run", F.sum(opens.cast("int")).over(order)).filter("_member")
    bounds = numbered.groupBy(*MESSAGE, "_run").agg(
        F.min(F.when(F.col("_interesting"), F.col("start"))).alias("_from"),
        F.max(F.when(F.col("_noun"), F.col("end"))).alias("_to"),
        F.sum(F.col("_interesting").cast("int")).alias("_words")).filter(F.col("_to").isNotNull())
    inside = numbered.filter("_interesting").select(*MESSAGE, "_run", "start", "end").join(
        bounds, [*MESSAGE, "_run"]).filter(F.col("end") <= F.col("_to")).join(annotations, [*MESSAGE, "start"])
    per_source = inside.groupBy(*MESSAGE, "_run", "_from", "_to", "_words", "source").agg(
        F.avg("prob").alias("_mean"), F.count_if(F.col("prob") > 0).alias("_positive"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("source", "_mean"))), lambda s: s["_mean"])
    phrases = per_source.groupBy(*MESSAGE, "_run", "_from", "_to", "_words").agg(
        fold_probability(ordered).alias("confidence"), (F.sum("_positive") / F.first("_words")).alias("ranking"))
    return (phrases.filter((F.col("ranking") > 0) & (F.col("confidence") > 0)).join(texts, list(MESSAGE))
            .select("conv_id", F.col("msg_idx").alias("message_idx"), F.col("_from").alias("start"),
                    F.col("_to").alias("end"),
                    F.substring(F.col("text"), F.col("_from") + 1, F.col("_to") - F.col("_from")).alias("value"),
                    F.lit("Keyword").alias("type"), F.array(F.lit("interestingTerm")).alias("hints"), "confidence"))


def adjective_locations(words: DataFrame, chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Location chunks that also cover the attributive adjective directly before them."""
    shape = ["start", "end", "text", "lemma", "prob"]
    both = words.select(*MESSAGE, *shape, F.lit(1).alias("_kind"), (F.col("pos") == "ADJA").alias("_attributive"),
                        F.lit(None).cast("string").alias("ner_tag")).unionByName(
        chunks.filter(F.col("ner_type") == LOCATION).select(
            *MESSAGE, *shape, F.lit(0).alias("_kind"), F.lit(False).alias("_attributive"), "ner_tag"))
    order = Window.partitionBy(*MESSAGE).orderBy("start", F.desc("end"), "_kind")
    reach = F.coalesce(F.max(F.when(F.col("_kind") == 0, F.col("end"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    # chunks inside an earlier location are passed over, words inside one cannot be its adjective
    usable = both.withColumn("_reach", reach).filter((F.col("_kind") == 1) | (F.col("_reach") < F.col("end")))
    before = F.lag(F.struct("_kind", *shape, "_attributive", "_reach")).over(order)
    paired = usable.withColumn("_b", before).filter(
        (F.col("_kind") == 0) & (F.col("_b._kind") == 1) & F.col("_b._attributive") & (F.col("_b._reach") < F.col("_b.end")))
    gap = F.substring(F.col("_full"), F.col("_b.end") + 1, F.col("start") - F.col("_b.end"))
    lemma = F.when(F.col("_b.lemma").isNotNull() | F.col("lemma").isNotNull(), F.concat(
        F.coalesce("_b.lemma", "_b.text"), gap, F.coalesce("lemma", "text")))
    return paired.join(texts.select(*MESSAGE, F.col("text").alias("_full")), list(MESSAGE)).select(
        *MESSAGE, F.lit("chunk").alias("kind"), F.col("_b.start").alias("start"), "end",
        F.substring(F.col("_full"), F.col("_b.start") + 1, F.col("end") - F.col("_b.start")).alias("text"),
        F.lit(LOCATION).alias("ner_type"), "ner_tag",
        sum_probability(F.coalesce("_b.prob", F.lit(0.0)), F.coalesce("prob", F.lit(0.0))).alias("prob"),
        lemma.alias("lemma"))


def _merged_probability(p: Column, q: Column) -> Column:
    known = sum_probability(F.coalesce(p, F.lit(1.0)), F.coalesce(q, F.lit(1.0)))
    return F.when(p.isNotNull() | q.isNotNull(), known)


def append_location_type(words: DataFrame, chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """New location chunks from a location or organization followed directly by a location.

    Neighbours are paired from the left, a chunk used as follower does not start a pair itself.  An organization that
    ends with a nested location gets a location chunk of its own extent instead.
    """
    named = chunks.filter(F.col("ner_type").isin(LOCATION, ORGANIZATION)).select(
        *MESSAGE, "start", "end", "text", "lemma", "prob", "ner_type")
    order = Window.partitionBy(*MESSAGE).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = named.withColumn("_reach", F.coalesce(reach, F.lit(-1)))
    outer = placed.filter(F.col("end") > F.col("_reach")).drop("_reach")
    nested = placed.filter((F.col("end") <= F.col("_reach")) & (F.col("ner_type") == LOCATION)).drop("_reach")
    # the word after each chunk: the next word start at or after its end
    starts = words.select(*MESSAGE, "start").withColumn("_word", F.col("start"))
    ends = outer.withColumn("_chunk", F.struct("start", "end", "text", "lemma", "prob", "ner_type"))
    at = Window.partitionBy(*MESSAGE).orderBy(F.desc("_at"), "_order").rowsBetween(Window.unboundedPreceding, 0)
    events = ends.select(*MESSAGE, F.col("end").alias("_at"), F.lit(1).alias("_order"), F.lit(None).cast("int").alias(
        "_word"), "_chunk").unionByName(starts.select(
            *MESSAGE, F.col("start").alias("_at"), F.lit(0).alias("_order"), "_word",
            F.lit(None).cast(ends.schema["_chunk"].dataType).alias("_chunk")))
    following = events.withColumn("_next", F.min("_word").over(at)).filter(F.col("_chunk").isNotNull()).select(
        *MESSAGE, "_chunk.*", "_next")
    adjacent = (F.lag("_next").over(order) == F.col("start")) & (F.col("ner_type") == LOCATION)
    chained = following.withColumn("_chain", F.sum(F.when(adjacent, 0).otherwise(1)).over(order))
    in_chain = Window.partitionBy(*MESSAGE, "_chain").orderBy("start")
    paired = chained.withColumn("_n", F.row_number().over(in_chain)).withColumn(
        "_f", F.lead(F.struct("start", "end", "text", "lemma", "prob")).over(in_chain)).filter(
        (F.col("_n") % 2 == 1) & F.col("_f").isNotNull())
    full = texts.select(*MESSAGE, F.col("text").alias("_full"))
    gap = F.substring(F.col("_full"), F.col("end") + 1, F.col("_f.start") - F.col("end"))
    lemma = F.when(F.col("lemma").isNotNull() | F.col("_f.lemma").isNotNull(), F.concat(
        F.coalesce("lemma", "text"), gap, F.coalesce("_f.lemma", "_f.text")))
    merged = paired.join(full, list(MESSAGE)).select(
        *MESSAGE, "start", F.col("_f.end").alias("end"),
        F.substring(F.col("_full"), F.col("start") + 1, F.col("_f.end") - F.col("start")).alias("text"),
        _merged_probability(F.col("prob"), F.col("_f.prob")).alias("prob"), lemma.alias("lemma"))
    tail = nested.select(*MESSAGE, "end", F.col("start").alias("_start"), F.col("prob").alias("_prob"),
                         F.col("lemma").alias("_lemma"))
    tailed = outer.filter(F.col("ner_type") == ORGANIZATION).join(tail, [*MESSAGE, "end"]).join(full, list(MESSAGE)).select(
        *MESSAGE, "start", "end", "text", _merged_probability(F.col("prob"), F.col("_prob")).alias("prob"),
        F.coalesce("lemma", F.when(F.col("_lemma").isNotNull(), F.concat(
            F.substring(F.col("_full"), F.col("start") + 1, F.col("_start") - F.col("start")), "_lemma"))).alias("lemma"))
    return merged.unionByName(tailed).withColumn("kind", F.lit("chunk")).withColumn(
        "ner_type", F.lit(LOCATION)).withColumn("ner_tag", F.lit(LOCATION))


def entity_tokens(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Tokens of named entities; overlapping entities of one token type become one token over all of them."""
    kind = entity_type(F.col("ner_type"), F.col("ner_tag"))
    typed = chunks.filter(F.col("ner_type").isNotNull() | F.col("ner_tag").isNotNull()).withColumn("type", kind)
    order = Window.partitionBy(*MESSAGE, "type").orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") >= reach, F.lit(True))
    numbered = typed.withColumn("_opens", opens.cast("int")).withColumn("_n", F.sum("_opens").over(order))
    probability = F.coalesce("prob", F.lit(DEFAULT_ENTITY_CONFIDENCE))
    parts = F.array_sort(F.collect_list(F.struct(
        F.col("start").alias("s"), (-F.col("end")).alias("e"), probability.alias("p"),
        F.coalesce("lemma", "text").alias("v"), entity_hint(F.col("ner_type"), F.col("ner_tag")).alias("h"))))
    grouped = numbered.groupBy(*MESSAGE, "type", "_n").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), parts.alias("_p"))
    first = F.get("_p", F.lit(0))
    covered = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return grouped.join(texts.select(*MESSAGE, "text"), list(MESSAGE)).select(
        "conv_id", F.col("msg_idx").alias("message_idx"), "start", "end",
        F.when(F.col("end") > -first["e"], covered).otherwise(first["v"]).alias("value"), "type",
        F.array_sort(F.array_distinct(F.array_compact(F.transform("_p", lambda p: p["h"])))).alias("hints"),
        F.aggregate(F.slice("_p", F.lit(2), F.size("_p")), first["p"],
                    lambda acc, p: sum_probability(acc, p["p"])).alias("confidence"))


def merge_contained(tokens: DataFrame) -> DataFrame:
    """Drop tokens contained in the token of the same type and value before them; their hints move to it.

    A token with another value takes over, so within a stretch of equal values a token stays only if it reaches further
    than all before it.
    """
    order = Window.partitionBy("conv_id", "message_idx", "type").orderBy("start", F.desc("end"), "value")
    changed = ~F.col("value").eqNullSafe(F.lag("value").over(order)) | (F.row_number().over(order) == 1)
    stretched = tokens.withColumn("_stretch", F.sum(changed.cast("int")).over(order))
    within = Window.partitionBy("conv_id", "message_idx", "type", "_stretch").orderBy("start", F.desc("end"))
    reach = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    kept = stretched.withColumn("_keep", F.coalesce(F.col("end") > reach, F.lit(True)).cast("int"))
    kept = kept.withColumn("_owner", F.sum("_keep").over(within))
    rest = [c for c in tokens.columns if c not in ("conv_id", "message_idx", "type", "hints")]
    merged = kept.groupBy("conv_id", "message_idx", "type", "_stretch", "_owner").agg(
        F.max_by(F.struct(*rest), F.col("_keep")).alias("_token"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hints")))).alias("hints"))
    return merged.select("conv_id", "message_idx", "type", "hints", "_token.*").select(*tokens.columns)


def type_rank(column: str = "type") -> Column:
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(TOKEN_TYPES) for x in (name, i)])
    return F.coalesce(F.try_element_at(ranks, F.col(column)), F.lit(-1))


def token_order() -> list[Column]:
    """Message, start, longer first, type in its defined order, value."""
    return [F.col("message_idx"), F.col("start"), F.desc("end"), type_rank(), F.asc_nulls_first("value")]


def index_tokens(tokens: DataFrame) -> DataFrame:
    """Add ``token_idx``, the position of a token in the analysis of its conversation."""
    placed = ordinal(tokens.withColumn("_bucket", bucket_of("message_idx")), ["conv_id"], token_order(), "_bucket", "_n")
    return placed.withColumn("token_idx", F.col("_n") - 1).drop("_n", "_bucket")


# Roles of the latch template.
_LATCH_ROLES = {"Place": "location", "Date": "time", "Topic": "category", "Entity": "alphabet", "Other": "alphabet",
                "Person": "alphabet", "Product": "alphabet", "Organization": "alphabet", "Keyword": "alphabet"}


def latch_slots(tokens: DataFrame, template_idx: int = 0) -> DataFrame:
    """Slots of the location/time/alphabet/category template, by token type.

    A role and value already seen in the conversation gives a further slot only with a higher confidence than all
    before.  ``tokens`` carry ``token_idx``.
    """
    roles = F.create_map(*[F.lit(x) for pair in _LATCH_ROLES.items() for x in pair])
    slots = tokens.withColumn("role", F.try_element_at(roles, F.col("type"))).filter(
        F.col("role").isNotNull() & F.col("value").isNotNull()).withColumn("_bucket", bucket_of("token_idx"))
    ranked = running_max_before(slots, ["conv_id", "role", "value"], [F.col("token_idx")], "_bucket",
                                F.col("confidence"), "_best")
    kept = ranked.filter(F.col("_best").isNull() | (F.col("confidence") > F.col("_best")))
    required_type = F.when(F.col("role") == "location", "Place").when(F.col("role") == "time", "Date").when(
        F.col("role") == "category", "Topic")
    return kept.select("conv_id", F.lit(template_idx).alias("template_idx"), F.lit("ir_latch").alias("template_type"),
                       "role", required_type.alias("token_type"), F.lit(False).alias("required"), "token_idx")


def related_slots(tokens: DataFrame, template_idx: int = 1) -> DataFrame:
    """Slots of the related-conversation template: keywords, and every other type but topics as terms."""
    role = F.when(F.col("type") == "Keyword", "Keyword").when(F.col("type") != "Topic", "Term")
    return tokens.withColumn("role", role).filter(F.col("role").isNotNull()).select(
        "conv_id", F.lit(template_idx).alias("template_idx"), F.lit("related.conversation").alias("template_type"),
        "role", F.when(F.col("role") == "Keyword", "Keyword").alias("token_type"), F.lit(False).alias("required"),
        "token_idx")


def build_templates(tokens: DataFrame, builders: Sequence[Callable[[DataFrame, int], DataFrame]] = (
        latch_slots, related_slots)) -> DataFrame:
    """Slots of all templates of an analysis; a builder maps (tokens, template number) to slots."""
    parts = [build(tokens, number) for number, build in enumerate(builders)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Per template the roles with their token type, and the roles that must be present (any of each group).
TEMPLATE_RULES: Mapping[str, dict] = {
    "Reiseplanung": {
        "types": {"from": "Place", "to": "Place", "via": "Place", "depart": "Date", "arrive": "Date", "card": "Product",
                  "class": "Product"},
        "needs": [["from"], ["to"], ["depart", "arrive"]]},
    "Umkreissuche": {
        "types": {"location": "Place", "start": "Date", "end": "Date", "what": None},
        "needs": [["location"], ["what"]]},
    "Produkt": {"types": {"product": "Product", "what": None}, "needs": [["product"]]},
    "ir_latch": {"types": {"location": "Place", "time": "Date", "category": "Topic", "alphabet": None,
                           "hierarchy": None}, "needs": []},
    "related.conversation": {"types": {"Keyword": "Keyword", "Term": None}, "needs": []},
}


def valid_templates(slots: DataFrame, tokens: DataFrame, rules: Mapping[str, dict] = TEMPLATE_RULES) -> DataFrame:
    """Templates with the set of filled ``roles`` and whether their rule holds (``valid``).

    A slot counts when its token exists, was not rejected, and has the type the slot asks for; the asked type must be
    that of the role's definition.
    """
    defined, requirement = F.lit(True), F.lit(False)
    present = F.col("roles")
    for template, rule in rules.items():
        for role, kind in rule["types"].items():
            here = (F.col("template_type") == template) & (F.col("role") == role)
            defined = F.when(here, F.col("token_type").eqNullSafe(F.lit(kind).cast("string"))).otherwise(defined)
        holds = F.lit(True)
        for group in rule["needs"]:
            holds = holds & F.arrays_overlap(present, F.array(*[F.lit(r) for r in group]))
        requirement = F.when(F.col("template_type") == template, holds).otherwise(requirement)
    known = tokens.select("conv_id", "token_idx", F.col("type").alias("_type"),
                          F.coalesce("state", F.lit("Suggested")).alias("_state"))
    joined = slots.join(known, ["conv_id", "token_idx"], "left")
    filled = (F.col("_type").isNotNull() & (F.col("_state") != "Rejected")
              & (F.col("token_type").isNull() | (F.col("token_type") == F.col("_type"))) & defined)
    return (joined.groupBy("conv_id", "template_idx", "template_type")
            .agg(F.array_sort(F.collect_set(F.when(filled, F.col("role")))).alias("roles"))
            .withColumn("valid", requirement))


def fill_slots(slots: DataFrame, tokens: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Slots with the token they point to, optionally only tokens of some types."""
    usable = tokens.filter(F.col("type").isin(*types)) if types else tokens
    return slots.filter(F.col("token_idx") >= 0).join(usable, ["conv_id", "token_idx"])


def topic_set(tokens: DataFrame, min_confidence: float = MIN_TOPIC_CONFIDENCE) -> DataFrame:
    """Topics of each message including their ancestors."""
    usable = tokens.filter((F.col("type") == "Topic") & (F.coalesce("state", F.lit("Suggested")) != "Rejected")
                           & (F.col("confidence") >= min_confidence))
    return (usable.select("conv_id", "message_idx", F.explode(topic_hierarchy(F.col("value"))).alias("topic"))
            .groupBy("conv_id", "message_idx").agg(F.array_sort(F.collect_set("topic")).alias("topics")))


def topics_apply(topics: Column, ruleset_topics: Sequence[str]) -> Column:
    return F.arrays_overlap(topics, F.array(*[F.lit(t) for t in ruleset_topics]))


def type_masked_text(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Per message the text with its tokens replaced by ``<Type>`` (``masked``), one row per token with the offset of
    its mask (``offset``).  Overlapping tokens share the mask of the first one."""
    where = ("conv_id", "message_idx")
    order = Window.partitionBy(*where).orderBy("start", F.desc("end"), type_rank(), "value")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = tokens.withColumn("_opens", (F.col("start") >= reach).cast("int")).withColumn(
        "_mask", F.sum("_opens").over(order))
    spans = numbered.groupBy(*where, "_mask").agg(
        F.min("start").alias("_from"), F.max("end").alias("_to"),
        F.max(F.when(F.col("_opens") == 1, F.col("type"))).alias("_type"))
    mask = F.concat(F.lit("<"), "_type", F.lit(">"))
    before = Window.partitionBy(*where).orderBy("_mask").rowsBetween(Window.unboundedPreceding, -1)
    growth = F.coalesce(F.sum(F.length(mask) - (F.col("_to") - F.col("_from"))).over(before), F.lit(0))
    previous = F.coalesce(F.lag("_to").over(Window.partitionBy(*where).orderBy("_mask")), F.lit(0))
    placed = spans.withColumn("offset", (F.col("_from") + growth).cast("int")).withColumn("_gap", previous)
    full = texts.select("conv_id", F.col("msg_idx").alias("message_idx"), "text")
    pieces = F.array_sort(F.collect_list(F.struct("_mask", F.concat(
        F.substring(F.col("text"), F.col("_gap") + 1, F.col("_from") - F.col("_gap")), mask).alias("piece"))))
    built = placed.join(full, list(where)).groupBy(*where).agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("_head"), F.max("_to").alias("_last"),
        F.first("text").alias("text"))
    masked = built.select(*where, F.concat("_head", F.expr("substring(text, _last + 1)")).alias("masked"))
    return numbered.join(placed.select(*where, "_mask", "offset"), [*where, "_mask"]).drop("_opens", "_mask").join(
        masked, list(where))


def _hint_finder(rules: Sequence[tuple[str, Sequence[str | None]]]):
    compiled = [(re.compile(pattern), list(hints)) for pattern, hints in rules]

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()),
                                            T.StructField("hint", T.StringType())])))
    def find(masked: pd.Series) -> pd.Series:
        def hints_of(text: str) -> list[dict]:
            given: dict[int, str] = {}
            for pattern, hints in compiled:
                for match in pattern.finditer(text):
                    for group, hint in enumerate(hints, start=1):
                        # a token takes the hint of the first rule that reaches it
                        if hint is not None and match.start(group) >= 0:
                            given.setdefault(match.start(group), hint)
            return [{"offset": offset, "hint": hint} for offset, hint in given.items()]

        return masked.map(hints_of)

    return find


def apply_hint_rules(masked: DataFrame, rules: Sequence[tuple[str, Sequence[str | None]]]) -> DataFrame:
    """Add hints to the tokens of ``type_masked_text``.  A rule is a pattern over the masked text and one hint per group;
    the token whose mask starts at a group gets the hint."""
    where = ["conv_id", "message_idx"]
    found = masked.select(*where, "masked").distinct().select(
        *where, F.inline(_hint_finder(rules)(F.col("masked"))))
    joined = masked.join(found, [*where, "offset"], "left")
    hints = F.when(F.col("hint").isNotNull(), F.array_union("hints", F.array("hint"))).otherwise(F.col("hints"))
    return joined.withColumn("hints", hints).drop("hint", "masked", "offset")


def apply_rulesets(tokens: DataFrame, texts: DataFrame, rulesets: Sequence[Mapping], lang: str | None) -> DataFrame:
    """Apply rule sets (``rules``, ``lang``, ``topics``, ``types``) to the messages and tokens they are made for.

    A set without language serves every language; one with topics only serves messages with one of them or of their
    descendants; only tokens of its types take part and are not rejected.
    """
    for rules in rulesets:
        if rules.get("lang") not in (None, lang):
            continue
        usable = F.coalesce(F.col("state") != "Rejected", F.lit(True)) if "state" in tokens.columns else F.lit(True)
        if rules.get("types"):
            usable = usable & F.col("type").isin(*rules["types"])
        flagged = tokens.withColumn("_use", usable)
        if rules.get("topics"):
            about = topic_set(tokens.withColumn("state", F.col("state") if "state" in tokens.columns else F.lit(
                "Suggested"))).filter(topics_apply(F.col("topics"), rules["topics"])).select(
                "conv_id", "message_idx", F.lit(True).alias("_about"))
            flagged = flagged.join(about, ["conv_id", "message_idx"], "left").withColumn(
                "_use", F.col("_use") & F.coalesce("_about", F.lit(False))).drop("_about")
        flagged = cut_lineage(flagged)
        hinted = apply_hint_rules(type_masked_text(flagged.filter("_use"), texts), rules["rules"])
        tokens = hinted.select(*tokens.columns).unionByName(flagged.filter(~F.col("_use")).drop("_use"))
    return tokens


def classify_tokens(tokens: DataFrame, classifiers: Sequence[tuple[Column, Column | str]]) -> DataFrame:
    """Type tokens that have none yet (null or Unknown): the first classifier whose condition holds gives the type."""
    given = F.coalesce(*[F.when(condition, kind if isinstance(kind, Column) else F.lit(kind))
                         for condition, kind in classifiers], F.col("type"))
    return tokens.withColumn("type", F.when(F.coalesce(F.col("type"), F.lit("Unknown")) == "Unknown", given).otherwise(
        F.col("type")))


def content_sections(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Text units of each message (start, end): its sections without sections inside, the whole text if it has none.

    In the order of start and falling end a section holds another one exactly if the next one begins before its end.
    """
    order = Window.partitionBy(*MESSAGE).orderBy("start", F.desc("end"))
    sections = spans.filter(F.col("kind") == "section").select(*MESSAGE, "start", "end").distinct()
    leaves = sections.withColumn("_next", F.lead("start").over(order)).filter(
        F.col("_next").isNull() | (F.col("_next") >= F.col("end"))).drop("_next")
    whole = texts.join(sections, list(MESSAGE), "left_anti").select(
        *MESSAGE, F.lit(0).alias("start"), F.length("text").alias("end"))
    return leaves.unionByName(whole)


def union_tokens(*parts: DataFrame) -> DataFrame:
    """Tokens of all extractors in one table."""
    out = parts[0].select(*TOKEN_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*TOKEN_COLUMNS))
    return out


def run_extractors(extractors: Sequence[Callable[[DataFrame, DataFrame], DataFrame]], msg: DataFrame, spans: DataFrame,
                   problems: list[tuple[str, str]] | None = None) -> list[DataFrame]:
    """Token tables of further stages (messages, spans) -> tokens, each run by itself.

    With ``problems`` a stage that fails, when it is planned or when it runs, is noted there with its error and left
    out; the others go on.
    """
    parts = []
    for extract in extractors:
        try:
            parts.append(cut_lineage(extract(msg, spans).select(*TOKEN_COLUMNS)))
        except Exception as error:  # noqa: BLE001 - whatever a stage of somebody else raises
            if problems is None:
                raise
            problems.append((getattr(extract, "__name__", repr(extract)), str(error)))
    return parts


def keyword_terms(tf: DataFrame, corpora: Mapping[str, tuple[DataFrame, Column]], **limits) -> DataFrame:
    """Interesting terms of each conversation per corpus (name -> term statistics, size), with their ``source``."""
    out = None
    for source, (stats, n_docs) in corpora.items():
        part = interesting_terms(tf, stats, n_docs, ["conv_id"], **limits).select(
            "conv_id", "term", F.lit(source).alias("source"), F.col("boost").alias("prob"))
        out = part if out is None else out.unionByName(part)
    return out


def analyze(msg: DataFrame, spans: DataFrame, stop: DataFrame, vocabulary: DataFrame, lang: str = "de",
            terms: DataFrame | None = None, rulesets: Sequence[Mapping] = (),
            extractors: Sequence[Callable[[DataFrame, DataFrame], DataFrame]] = (),
            filters: Sequence[Column] = (), problems: list[tuple[str, str]] | None = None,
            processors: Sequence[Callable[[Column], Column]] = (strip_code_blocks,)) -> DataFrame:
    """All extraction and clean-up stages; the result is the token table of each conversation with ``token_idx``.

    ``msg`` are the messages of the analysis window; their content goes through the ``processors`` first, by default
    without fenced code.  ``spans`` are the annotations of the processed texts, ``terms`` the interesting terms of
    each conversation (conv_id, term, source, prob).  ``extractors`` are further stages (messages, spans) -> tokens,
    see ``run_extractors``; ``filters`` are further conditions that drop a token.  With ``problems`` every stage runs by
    itself, the ones of this module too: one that fails is noted there and left out.
    """
    for process in processors:
        msg = msg.withColumn("content", process(F.col("content")))
    by_users = msg.filter((F.col("origin") == "User") & ~skips() & ~is_blank(F.col("content"))).select(
        "conv_id", F.col("idx").alias("msg_idx"), F.col("content").alias("text"))
    own = spans.join(by_users.select(*MESSAGE), list(MESSAGE), "left_semi")
    words, chunks = own.filter(F.col("kind") == "word"), own.filter(F.col("kind") == "chunk")
    shape = [*MESSAGE, "start", "end", "text", "ner_type", "ner_tag", "prob", "lemma"]

    def entities(_msg: DataFrame, _spans: DataFrame) -> DataFrame:
        urls = url_entities(msg.filter(F.col("origin") == "User")).withColumn("prob", F.lit(None).cast("double")).withColumn(
            "lemma", F.lit(None).cast("string"))
        named = chunks.select(*shape).unionByName(urls.select(*shape)).unionByName(
            adjective_locations(words, chunks, by_users).select(*shape)).unionByName(
            append_location_type(words, chunks, by_users).select(*shape))
        return entities_with_content_word(entity_tokens(named, by_users), words)

    def adjectives(_msg: DataFrame, _spans: DataFrame) -> DataFrame:
        return adjective_tokens(words)

    def labels(_msg: DataFrame, _spans: DataFrame) -> DataFrame:
        return vocabulary_entities(words, vocabulary)

    def phrases(_msg: DataFrame, _spans: DataFrame) -> DataFrame:
        matched = (match_terms_to_words(terms.withColumnRenamed("prob", "_prob"), words)
                   .select(*MESSAGE, "start", "source", F.col("_prob").alias("prob")).distinct())
        sections = own.filter((F.col("kind") == "sentence") | ((F.col("kind") == "chunk") & (F.col("phrase") == "NP")))
        whole = by_users.select(*MESSAGE, F.length("text").alias("end"))
        return keyword_phrases(words, sections.select(*MESSAGE, "end").unionByName(whole), matched, by_users)

    stages = [entities, adjectives, labels, *([phrases] if terms is not None else [])]
    if problems is None:
        parts = [stage(msg, own) for stage in stages]
    else:
        parts = run_extractors(stages, msg, own, problems)
    parts += run_extractors(extractors, msg, own, problems)
    # every stage up to here reads the spans, every stage from here on the tokens: written once in between
    if not parts:  # every stage has failed
        parts = [by_users.limit(0).select("conv_id", F.col("msg_idx").alias("message_idx"), *[F.lit(None).cast(
            TOKEN[c].dataType).alias(c) for c in TOKEN_COLUMNS[2:]])]
    tokens = cut_lineage(union_tokens(*parts))
    tokens = apply_rulesets(tokens, by_users, rulesets, lang)
    tokens = filter_tokens(remove_stopwords(tokens, stop, lang), filters)
    tokens = mark_negated(merge_contained(tokens), chunks)
    return index_tokens(cut_lineage(tokens.withColumn("state", F.lit("Suggested"))))

