"""Expressions over dates, tokens and settings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parley.functions.text import escape_query
from parley.schema import GRAINS, TOKEN_TYPES

DEFAULT_ENTITY_CONFIDENCE = 0.8
TITLE_BOOST = 3.0

# Topic and its parent.
TOPIC_PARENT = {
    "Reiseplanung": None,
    "ReiseplanungBahn": "Reiseplanung",
    "ReiseplanungExtern": "Reiseplanung",
    "ReiseplanungLokal": "Reiseplanung",
    "Umkreissuche": None,
    "UmkreissucheUnterkunft": "Umkreissuche",
    "UmkreissucheGastronomie": "Umkreissuche",
    "UmkreissucheWasTun": "Umkreissuche",
    "UmkreissucheEinkaufenService": "Umkreissuche",
    "UmkreissucheDbBahnProdukt": "Umkreissuche",
    "Danke": None,
    "Reisebuddy": None,
    "Produkt": None,
    "DBProdukt": "Produkt",
    "Zuginformation": None,
    "Sonstiges": None,
    "ApplicationHelp": None,
}


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def sum_probability(p: Column, q: Column) -> Column:
    return (p + q) / (F.lit(1.0) + p * q)


def fold_probability(values: Column) -> Column:
    """``sum_probability`` over an array, starting at 0."""
    return F.aggregate(values, F.lit(0.0), lambda acc, p: sum_probability(acc, p))


def date_range(ts: Column, grain: Column) -> Column:
    """(start, end) of the unit of ``grain`` that contains ``ts``; (ts, ts) without a grain."""
    start, end = ts, ts
    for name in GRAINS:
        begin = F.date_trunc(name, ts)
        start = F.when(grain == name, begin).otherwise(start)
        end = F.when(grain == name, F.timestamp_add(name.upper(), F.lit(1), begin)).otherwise(end)
    return F.struct(start.alias("start"), end.alias("end"))


def date_with_default_time(ts: Column, grain: Column, seconds_of_day: Column) -> Column:
    """Day-or-coarser dates get the given time of day, finer ones stay."""
    coarse = grain.isin(*GRAINS[GRAINS.index("day"):])
    return F.when(F.coalesce(coarse, F.lit(False)), F.timestamp_add(
        "SECOND", seconds_of_day, F.date_trunc("day", ts))).otherwise(ts)


def to_ts(text: Column) -> Column:
    """ISO date-time, null when it cannot be read."""
    return F.try_to_timestamp(text)


def coerce_message_field(field: str, value: Column) -> Column:
    """Value of an edited message field given as text; null where it is not valid."""
    if field == "private":
        return F.lower(value) == "true"
    if field == "votes":
        return F.when(value.rlike(r"^[+-]?\d{1,10}$"), value.try_cast("int"))
    if field == "time":
        return F.when(value.rlike(r"^-?\d+$"), F.timestamp_millis(value.try_cast("long"))).otherwise(to_ts(value))
    if field == "origin":
        return F.when(value.isin("User", "Agent", "Bot"), value)
    if field == "content" or field.startswith("metadata."):
        return value
    raise ValueError(f"unknown message field {field}")


def entity_type(ner_type: Column, ner_tag: Column) -> Column:
    """Token type of a named entity: by its type, for unspecific types by its tag, else Entity."""

    def mapped(label: Column) -> Column:
        return (F.when(label == "location", "Place").when(label == "person", "Person")
                .when(label == "organization", "Organization")
                .when(label.isin(*TOKEN_TYPES), label))

    unspecific = ner_type.isNull() | ner_type.isin("unknown", "misc")
    return F.coalesce(mapped(ner_type), F.when(unspecific, mapped(ner_tag)), F.lit("Entity"))


def entity_hint(ner_type: Column, ner_tag: Column) -> Column:
    blank = F.coalesce(F.trim(ner_type) == "", F.lit(True))
    by_type = F.when(F.coalesce(F.trim(ner_tag) != "", F.lit(False)), F.coalesce(ner_type, F.lit("null")))
    chosen = F.when(blank | (entity_type(ner_type, ner_tag) != "Entity"), by_type).otherwise(
        F.coalesce(ner_tag, F.lit("null")))
    return F.concat(F.lit("entity.type."), chosen)


def topic_hierarchy(topic: Column) -> Column:
    """The topic and all its ancestors."""
    parents = F.create_map(*[F.lit(x) for topic_name, parent in TOPIC_PARENT.items() if parent
                             for x in (topic_name, parent)])
    parent = F.try_element_at(parents, topic)
    return F.when(topic.isin(*TOPIC_PARENT), F.array_compact(F.array(topic, parent)))


def language_fallback(lang: Column, by_lang: Column) -> Column:
    """Entry of the language, else of its base language, else of ``default``."""
    key = F.lower(lang)
    return F.coalesce(F.try_element_at(by_lang, key),
                      F.try_element_at(by_lang, F.regexp_extract(key, r"^([^-_]+)[-_]", 1)),
                      F.try_element_at(by_lang, F.lit("default")))


def content_language(client_setting: Column, configured: Column, detected: Column) -> Column:
    return F.coalesce(client_setting, configured, detected)


def phrase_query(value: Column, field: Column, confidence: Column, boost: float = 1.0) -> Column:
    """``field:"escaped value"^weight``; null for a blank value."""
    weight = (confidence.cast("float") * F.lit(boost).cast("float")).cast("float")
    prefix = F.when(F.coalesce(F.trim(field) != "", F.lit(False)), F.concat(field, F.lit(":"))).otherwise("")
    return F.when(value.rlike(r"\S"), F.concat(
        prefix, F.lit('"'), escape_query(value), F.lit('"^'), weight.cast("string")))
