"""Queries of the curation operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import table

from . import chat, fingerprints, htmltext, jaccard, kernel, licenses, packing, pieces, quality, repair, resample, substrings, warc


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every message, and the calls and results derived from the table; it holds none of its own."""
    return chat.format_messages(chat.with_tool_calls(table(spark, folder, "conversations")), chat.EXAMPLE_SCHEMAS)


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_distances(table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.shared_passages(table(spark, folder, "documents")).select("doc_id", "start", "stop", "kept_in", "kept_start", "component_id")


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabularies are on this machine; every executor has them too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return repair.report(conversations, repair.damage(conversations))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return kernel.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    out = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_warc": op5_warc,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scans": op9_license_scans,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_importance_resampling": op13_importance_resampling,
}


def queries() -> dict:
    import corpus_pipeline  # it imports from here

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op1_quality_rules": quality.verdicts_sql(), "op2_chat_formatting": chat.formatted_sql(), "op9_license_scans": licenses.scan_sql(), "op11_conversation_repair": repair.report_sql(), "op13_importance_resampling": resample.resample_sql()}
