"""The operators over the driver's tables, as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm import crossalign, html, lmscore, mixing, packing, quality, secrets, simhash, suffixes, tokenfile, vectorcodes, vectors, wordbpe
from parley.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; most token queries use the first."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("drawn", "low", "high")


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


ORACLE["op6_source_mix"] = mixing.sql()


@query
def op7_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.held_out_scores(table(spark, sf_dir, "documents"), order=3)


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


ORACLE["op8_secret_scan"] = secrets.sql()


@query
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.written_and_read(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


@query
def op10_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op12_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossalign.aligned(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                              vocabulary("piece_bpe_32k.model"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf_dir, "embeddings"))


ORACLE["op13_vector_codes"] = vectorcodes.sql()
