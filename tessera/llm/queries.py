"""Thin queries over the operators of this subpackage, with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hard_negatives, html_text, langid, line_dedup, lm, merkle, mixing, pii, quality, secrets, simhash, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(column: str, kind: str) -> F.Column:
    """How many spans of a kind are written in a column."""
    return F.regexp_count(F.col(column), F.lit(rf"(?:^|,){kind}:")).cast("long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, as a separator scan over flat token files finds them."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.judge(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and mixed log10 probability of every document."""
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and all spans of secrets of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(docs))
    return found.select(
        "doc_id",
        *[_spans("base_spans", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern counts and all spans of personal data, disclosing terms included, of every document."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written(pii.KINDS), 256).alias("base_sha256"),
        pii.written((*pii.KINDS, "term")).alias("spans"),
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that may teach."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(langid.training_rows()))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many went, and the digest of what stays."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its version of the tree has."""
    found = merkle.versions(_table(spark, sf_dir, "documents"))
    folded = F.coalesce(F.try_element_at("copied", F.lit(-1)), "tampered_leaf", "leaf")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_secret_scan": op7_secret_scan,
    "op8_pii": op8_pii,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": mixing.MIX_SQL.replace("{docs}", "documents"),
    "op5_quality_rules": quality.JUDGE_SQL.replace("{docs}", "documents"),
    "op11_line_dedup": line_dedup.DEDUP_SQL.replace("{docs}", "documents"),
    "op12_hard_negatives": hard_negatives.MINE_SQL.replace("{vectors}", "embeddings"),
    "op13_merkle_manifest": merkle.versions_sql().replace("{docs}", "documents"),
}
