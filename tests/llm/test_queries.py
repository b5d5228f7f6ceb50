"""The registered queries over whole driver tables: their columns, and their twins where they have one."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402
from parley.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_word_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_main_text": "page_id url text n_chars",
    "op5_token_files": "doc_id start n_tokens ids_crc32",
    "op6_source_mix": "doc_id topic n_tokens weight probability sampled",
    "op7_trie_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_simhash_components": "doc_id fingerprint component_id",
    "op10_adaptive_scan": "query_id rank vec_id score",
    "op11_harmonic_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op12_cross_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
}
LONG = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_removed", "n_spans", "n_tokens",
        "n_chars", "start", "ids_crc32", "n_known", "train_tokens", "n_assign", "n_access", "n_hex", "query_id", "vec_id",
        "length", "doc_tokens", "sequence_id", "offset", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "error", "label_error"}


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS) and set(COLUMNS) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert set(COLUMNS[name].split()) <= set(kinds)
    assert all(kinds[c] == "bigint" for c in LONG & set(kinds))
    rows = df.count()
    if name == "op10_adaptive_scan":
        vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
        assert rows == 10 * vectors.filter("vec_id % 100 = 0").count()
    elif name == "op11_harmonic_packing":
        assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    elif name == "op13_vector_codes":
        assert rows == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    else:
        assert rows == spark.read.parquet(f"{SF}/{'pages' if 'page_id' in kinds else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twins(spark, name):
    ok, note = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLE[name])
    assert ok, note


def test_nothing_else_imports_the_package():
    for path in (ROOT / "parley").rglob("*.py"):
        if "llm" not in path.parts:
            assert "parley.llm" not in path.read_text(), path
