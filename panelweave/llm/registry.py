"""The queries of this subpackage: ``opN_<name>`` over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import bpe, cotraining, fingerprints, language_model, licenses, merkle, near_dedup, packing, phrases, pii, quality_rules, substring_dedup, toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.op1(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.op2(table(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.op3(table(spark, folder, "documents"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.op4(table(spark, folder, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.op5(table(spark, folder, "documents"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.op6(table(spark, folder, "documents"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.op7(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.op8(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.op9(table(spark, folder, "documents"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.op10(*(table(spark, folder, t) for t in ("documents", "labels", "pages")))


def op11_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.op11(table(spark, folder, "documents"))


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.op12(table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.op13(table(spark, folder, "documents"))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_pii, op4_bpe, op5_substring_dedup, op6_license_scan, op7_fingerprints, op8_toxicity, op9_near_dedup, op10_quality_classifier, op11_language_model, op12_phrases, op13_merkle_manifest)}


def sql_texts() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.SQL, "op12_phrases": phrases.SQL, "op13_merkle_manifest": merkle.SQL}
