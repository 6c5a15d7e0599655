"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegrain.llm import collocations, decontaminate, gru_lm, language_id, license_scan, merkle, near_dedup, packing, quality_crf, quality_rules, secret_scan, suffix_dedup, toxicity


def tokenizer_path() -> str:
    """Where the public tokenizer's vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, table(spark, sf_dir, "documents")).drop("text_hash")


def op3_crf_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents"))


def op5_gru_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(spark, table(spark, sf_dir, "documents"))


def op6_template_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark, table(spark, sf_dir, "documents"))


def op7_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_documents(spark, table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_prefix_join_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_windows(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(spark, table(spark, sf_dir, "documents"))


def op10_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_automaton_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spark, table(spark, sf_dir, "documents"))


def op12_folded_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_octopus_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_karmarkar_karp_packing": op1_karmarkar_karp_packing,
        "op2_mcd_quality_rules": op2_mcd_quality_rules,
        "op3_crf_quality_classifier": op3_crf_quality_classifier,
        "op4_hierarchical_language_id": op4_hierarchical_language_id,
        "op5_gru_lm_scoring": op5_gru_lm_scoring,
        "op6_template_license_scan": op6_template_license_scan,
        "op7_trigram_secret_scan": op7_trigram_secret_scan,
        "op8_prefix_join_decontamination": op8_prefix_join_decontamination,
        "op9_sparse_suffix_dedup": op9_sparse_suffix_dedup,
        "op10_superminhash_near_dedup": op10_superminhash_near_dedup,
        "op11_automaton_collocations": op11_automaton_collocations,
        "op12_folded_lexicon_toxicity": op12_folded_lexicon_toxicity,
        "op13_octopus_merkle_manifest": op13_octopus_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_template_license_scan": license_scan.oracle(),
        "op8_prefix_join_decontamination": decontaminate.ORACLE,
        "op11_automaton_collocations": collocations.oracle(),
        "op13_octopus_merkle_manifest": merkle.oracle(),
    }
