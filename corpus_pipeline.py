"""From raw documents to token ids: quality rules, near-dedup, secret scan, source mix, word BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given.  All but the last return the columns of
``documents``.  Nulls, empty texts, repeated rows, empty tables and extra columns pass through as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm import mixing, quality, secrets, simhash, wordbpe
from parley.llm.common import ROW, only, shielded, stored, with_row

#: The sample keeps this part of the tokens; it is less than all because the sources are mixed to target weights.
BUDGET = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and lie in their language's perplexity band."""
    return _well_written(docs)


@shielded
def _well_written(docs: DataFrame) -> DataFrame:
    rows = with_row(docs)
    return only(rows, quality.judge(rows, key=ROW).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (fingerprints within four bits, or five-word shingles at a similarity of 0.8 or
    more) the row with the smallest id."""
    return _one_of_each(docs)


@shielded
def _one_of_each(docs: DataFrame) -> DataFrame:
    rows = with_row(docs)
    return only(rows, simhash.all_duplicates(rows, key=ROW).filter(F.col(ROW) == F.col("component")), once=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with found secrets replaced in the text; n_chars of a changed text is counted anew."""
    return _without_secrets(docs)


@shielded
def _without_secrets(docs: DataFrame) -> DataFrame:
    clean = secrets.redact(docs.withColumn("_size", F.length("text")))
    changed = F.length("text") != F.col("_size")
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
        F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target weights by source, language and topic."""
    return mixing.sample(docs, mixing.Mix(budget=BUDGET))


def word_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text that they decode to, in place of the text."""
    return wordbpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("source_mix", source_mix), ("word_bpe", word_bpe)]

#: A Kneser-Ney model, fingerprints of XXH64 and a tokenizer are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the stored rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
