"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted in the cells source x language x topic.  Raking scales the cells to the target share of one
dimension after the other until all marginals fit; a cell's factor is the weight of its tokens.  Documents are then
drawn with probabilities in proportion to that weight, calibrated so that the expected tokens meet the budget although
no probability exceeds one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import shielded, small_batches, stored
from parley.lookup import lookup_join

DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
MARK = "[#*$%&|<>]"


@dataclass(frozen=True)
class Mix:
    """Targets: each dimension's shares are its token shares to the power given here, scaled to a sum of one.

    ``budget`` is the part of all tokens that the sample should hold; ``sweeps`` and ``rounds`` are the steps of the
    raking and of the calibration.
    """

    source: float = 0.5
    lang: float = 0.7
    topic: float = 0.5
    budget: float = 0.5
    sweeps: int = 10
    rounds: int = 8
    seed: str = "mix"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The kind of text a document is, as the tables name no topic: by its marks, its digits and its length."""
    size = F.greatest(F.length(text), F.lit(1))
    return (F.when(100 * F.regexp_count(text, F.lit(MARK)) >= 2 * size, "marked")
            .when(100 * F.regexp_count(text, F.lit("[0-9]")) >= 2 * size, "numbers")
            .when(n_tokens < 60, "short").when(n_tokens < 600, "article").otherwise("long"))


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 13))


def _celled(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn("_tokens", F.regexp_count(body, F.lit(WORD)).cast("long"))
    return counted.select("*", F.coalesce("source", F.lit("")).alias("_source"), F.coalesce("lang", F.lit("")).alias("_lang"),
                          topic_of(body, F.col("_tokens")).alias("_topic"))


def rake(cells: DataFrame, mix: Mix, most_pairs: int = 1 << 16) -> DataFrame:
    """(_source, _lang, _topic, factor) of cells with ``tokens``: the marginals of tokens * factor have their targets.

    Sources may be very many, pairs of language and topic hardly are.  So a source is one row with the tokens of its
    pairs, its own factor follows inside the row, and a sweep is one job that adds the sources up by pair; the factors of
    languages and topics follow on the driver from these sums, one number a pair.  With more than ``most_pairs`` pairs
    every step is an aggregation and a join of cells instead.  Cells without tokens have factor one.
    """
    pairs = cells.select("_lang", "_topic").distinct().orderBy("_lang", "_topic").limit(most_pairs + 1).collect()
    if len(pairs) > most_pairs:
        return _rake_by_joins(cells, mix)
    names = {name: sorted({r[f"_{name}"] for r in pairs}) for name in ("lang", "topic")}
    of = {name: np.array([names[name].index(r[f"_{name}"]) for r in pairs], np.int64) for name in names}
    spark = cells.sparkSession
    numbers = spark.createDataFrame([(r._lang, r._topic, k) for k, r in enumerate(pairs)] or [("", "", 0)],
                                    "_lang string, _topic string, pair int")
    numbered = cells.join(F.broadcast(numbers), ["_lang", "_topic"])
    by_source = stored(numbered.groupBy("_source").agg(
        F.collect_list(F.struct("pair", F.col("tokens").cast("double").alias("tokens"))).alias("cells")).select(
            "_source", F.col("cells.pair").alias("pairs"), F.col("cells.tokens").alias("tokens")), "sources")

    def goals(sums: np.ndarray, power: float) -> np.ndarray:
        shares = np.where(sums > 0, sums ** power, 0)
        return shares / max(shares.sum(), 1e-300) * sums.sum()

    def add_up(factor: np.ndarray, goal_of_power: float | None) -> np.ndarray:
        """Sum over sources of tokens times the source's factor by pair."""
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(pairs))
            for batch in batches:
                pair, tokens, row = _flat_cells(batch)
                scale = _source_factors(pair, tokens, row, batch.num_rows, factor, goal_of_power, mix.source)
                total += np.bincount(pair, tokens * scale[row], len(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(total)], ["pair", "n"])

        found = np.zeros(len(pairs))
        for r in by_source.mapInArrow(apply, "pair int, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            found[r.pair] = r.n
        return found

    def by(name: str, values: np.ndarray) -> np.ndarray:
        return np.bincount(of[name], values, len(names[name]))

    whole = add_up(np.ones(len(pairs)), None)
    goal = {name: goals(by(name, whole), getattr(mix, name)) for name in names}
    own = F.aggregate("tokens", F.lit(0.0), lambda a, x: a + x)
    powers = by_source.select(own.alias("t")).filter("t > 0").agg(F.sum(F.pow("t", F.lit(mix.source)))).first()[0]
    unit = whole.sum() / powers if powers else 0.0
    factor, before = {name: np.ones(len(names[name])) for name in names}, None
    for _ in range(mix.sweeps):
        before = factor["lang"][of["lang"]] * factor["topic"][of["topic"]]
        sums = add_up(before, unit)
        for name, other in (("lang", "topic"), ("topic", "lang")):
            now = by(name, sums * factor[other][of[other]])
            factor[name] = np.where(now > 0, goal[name] / np.where(now > 0, now, 1), factor[name])
    before = np.ones(len(pairs)) if before is None else before
    last = factor["lang"][of["lang"]] * factor["topic"][of["topic"]]

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, tokens, row = _flat_cells(batch)
            scale = _source_factors(pair, tokens, row, batch.num_rows, before, unit if mix.sweeps else None, mix.source)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(pair.astype(np.int32)), pa.array(tokens.astype(np.int64)),
                 pa.array(np.where(tokens > 0, scale[row] * last[pair], 1.0))], ["_source", "pair", "tokens", "factor"])

    return by_source.mapInArrow(scaled, "_source string, pair int, tokens long, factor double").join(
        F.broadcast(numbers), "pair").select("_source", "_lang", "_topic", "tokens", "factor")


def _flat_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, tokens and row of every cell of a batch of sources."""
    pairs, tokens = batch.column(1), batch.column(2)
    sizes = pc.list_value_length(pairs).to_numpy(zero_copy_only=False).astype(np.int64)
    return (pairs.flatten().to_numpy().astype(np.int64), tokens.flatten().to_numpy().astype(np.float64),
            np.repeat(np.arange(len(sizes)), sizes))


def _source_factors(pair, tokens, row, rows: int, factor: np.ndarray, unit: float | None, power: float) -> np.ndarray:
    """The factor that brings every source to its goal, its tokens to the power times ``unit``; ones without a unit."""
    if unit is None:
        return np.ones(rows)
    own, now = np.bincount(row, tokens, rows), np.bincount(row, tokens * factor[pair], rows)
    return np.where(now > 0, unit * np.where(own > 0, own, 1.0) ** power / np.where(now > 0, now, 1), 1.0)


def _rake_by_joins(cells: DataFrame, mix: Mix) -> DataFrame:
    """Every step is one aggregation, combined before the shuffle, and one join of cells."""
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    targets = {}
    for name in DIMENSIONS:
        own = cells.groupBy(f"_{name}").agg(F.sum("tokens").cast("double").alias("t")).filter("t > 0").withColumn(
            "p", F.pow("t", F.lit(getattr(mix, name))))
        targets[name] = stored(own.select(f"_{name}", (F.col("p") / own.agg(F.sum("p")).scalar() * total.scalar()).alias(
            "goal")), "goals")
    for _ in range(mix.sweeps):
        for name in DIMENSIONS:
            scale = now.groupBy(f"_{name}").agg(F.sum("w").alias("sum")).join(targets[name], f"_{name}").select(
                f"_{name}", (F.col("goal") / F.col("sum")).alias("scale"))
            now = now.join(scale, f"_{name}", "left").withColumn(
                "w", F.col("w") * F.coalesce("scale", F.lit(1.0))).drop("scale")
        now = stored(now, "raked")
    return now.select("_source", "_lang", "_topic", "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
                      .otherwise(1.0).alias("factor"))


def calibrate(raked: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``probability``: factor times one number for all cells, at most one, so that the budget is met.

    Cells that reach one give what they have; the number is found again for the others, ``rounds`` times.
    """
    scale, sums = 0.0, None
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    goal = mix.budget * total
    for _ in range(mix.rounds):
        full = F.col("factor") * F.lit(scale) >= 1
        sums = raked.agg(F.sum(F.when(full, F.col("tokens"))).cast("double").alias("full"),
                         F.sum(F.when(~full, F.col("tokens") * F.col("factor"))).alias("rest")).first()
        if not sums.rest:
            break
        scale = max(scale, (goal - (sums.full or 0.0)) / sums.rest)
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * F.lit(scale)))


def weighed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and _topic, _tokens, _factor, _probability, _sampled.

    Nulls in source or lang are a value of their own; null and empty texts have no tokens, weigh one and are kept with
    the chance of their cell.  The draw depends on the key alone, so repeated rows stay or go together; rows without
    a key share one draw.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = _celled(docs, text)
    cells = stored(rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")), "cells")
    found = stored(calibrate(rake(cells, mix), mix), "weights").select(
        "_source", "_lang", "_topic", F.col("factor").alias("_factor"), F.col("probability").alias("_probability"))
    joined = lookup_join(rows, found, ["_source", "_lang", "_topic"], salt_by=[F.col(key)])
    return joined.withColumn("_sampled", chance(F.col(key), mix.seed) < F.col("_probability")).drop("_source", "_lang")


def sql(mix: Mix = Mix()) -> str:
    """The query of the weighed documents as DuckDB SQL, raking and calibration unrolled."""
    steps = [f"""rows_ AS (SELECT *, CASE WHEN 100 * marks >= 2 * size THEN 'marked' WHEN 100 * digits >= 2 * size THEN 'numbers'
    WHEN n_tokens < 60 THEN 'short' WHEN n_tokens < 600 THEN 'article' ELSE 'long' END AS topic FROM (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, greatest(length(body), 1) AS size,
    len(regexp_extract_all(body, '{WORD}')) AS n_tokens, len(regexp_extract_all(body, '{MARK}')) AS marks,
    len(regexp_extract_all(body, '[0-9]')) AS digits FROM (SELECT *, coalesce(text, '') AS body FROM documents)))""",
             "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, "
             "CAST(sum(n_tokens) AS DOUBLE) AS w FROM rows_ GROUP BY ALL)"]
    for name in DIMENSIONS:
        steps.append(f"""goal_{name} AS MATERIALIZED (SELECT {name}, pow(t, {getattr(mix, name)}) / sum(pow(t, {getattr(mix, name)}))
  OVER () * sum(t) OVER () AS goal FROM (SELECT {name}, sum(tokens) AS t FROM cells GROUP BY {name}) WHERE t > 0)""")
    last = "cells"
    for k in range(mix.sweeps):
        for name in DIMENSIONS:
            steps.append(f"""w{k}_{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * coalesce(goal / s, 1) AS w
  FROM {last} c LEFT JOIN (SELECT {name}, sum(w) AS s FROM {last} GROUP BY {name}) USING ({name})
  LEFT JOIN goal_{name} USING ({name}))""")
            last = f"w{k}_{name}"
    steps.append(f"raked AS MATERIALIZED (SELECT source, lang, topic, tokens, "
                 f"CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS factor FROM {last})")
    steps.append("scale AS (SELECT CAST(0 AS DOUBLE) AS b)")
    before = "scale"
    for k in range(mix.rounds):
        steps.append(f"""scale{k} AS MATERIALIZED (SELECT greatest(before, coalesce(({mix.budget} * total - coalesce(done, 0)) / nullif(rest, 0), before)) AS b
  FROM (SELECT any_value(b) AS before, sum(tokens) AS total, sum(tokens) FILTER (factor * b >= 1) AS done,
    sum(tokens * factor) FILTER (factor * b < 1) AS rest FROM raked, {before}))""")
        before = f"scale{k}"
    draw = f"CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':{mix.seed}')), 1, 13)) AS BIGINT)"
    return f"""WITH {", ".join(steps)}
SELECT doc_id, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(factor, 6) AS weight,
  round(least(1, factor * b), 6) AS probability, {draw} / {float(16 ** 13)} < least(1, factor * b) AS sampled
FROM rows_ JOIN raked USING (source, lang, topic), scale{mix.rounds - 1}"""


def report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, topic, n_tokens, weight, probability, sampled) of every document."""
    return weighed(docs.select("doc_id", "text", "source", "lang"), mix).select(
        "doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_factor", 6).alias("weight"), F.round("_probability", 6).alias("probability"),
        F.col("_sampled").alias("sampled"))


@shielded
def sample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The drawn rows with the columns of ``docs``."""
    return weighed(docs, mix).filter("_sampled").select(*docs.columns)
