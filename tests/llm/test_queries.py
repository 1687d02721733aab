"""The registered queries of this subpackage, and the pipeline, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_counts": "doc_id n_tokens",
    "op2_simhash_near_dedup": "doc_id fingerprint component_id",
    "op3_mix_sources": "doc_id size source_size target taken source",
    "op4_html_extraction": "page_id url text n_chars",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_left",
    "op6_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score bits_per_byte",
    "op7_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_benchmark_decontamination": "doc_id item_id n_windows n_found coverage n_slots consistency reparameterised",
    "op10_language_id": "doc_id held_out lang_pred score",
    "op11_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    run = entry.queries()[name]
    if name in entry.oracle_sql():
        assert oracle.compare(spark, oracle.connect(SF_DIR), run, entry.oracle_sql()[name], SF_DIR) is None
    got = run(spark, SF_DIR)
    assert got.columns == COLUMNS[name].split()
    rows = spark.read.parquet(f"{SF_DIR}/{'pages' if name.startswith('op4') else 'documents'}.parquet").count()
    assert got.count() == rows or name.startswith(("op9", "op12"))


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert 0.7 * before.count() <= out.count() <= before.count()
    assert out.filter("taken > 3 * size").count() == 0
    assert len(corpus_pipeline.STAGES) == 5
