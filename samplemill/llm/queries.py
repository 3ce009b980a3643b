"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, html_extraction, language_id, line_dedup, media, near_dedup, ngram_lm, packing, resampling, token_files, warc, whitening
from .common import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = chat.raw_transcripts(read_table(spark, sf_dir, "conversations"))
    learned = chat.learn_turns(raw.filter(F.coalesce(language_id.remainder(F.col("transcript"), 4) != 2, F.lit(False))))
    recovered = chat.recover_roles(raw, learned)
    return chat.render_turns(recovered).withColumnRenamed("transcript", "conv_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(read_table(spark, sf_dir, "documents"))
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.store_texts(read_table(spark, sf_dir, "documents"))
    return media.load_media(spark, folder).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language_id.learn_dictionaries(language_id.training_rows(docs))
    held_out = F.coalesce(language_id.remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return language_id.identify_languages(docs.select("doc_id", "text"), learned).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.build_responses(read_table(spark, sf_dir, "pages"))
    return warc.build_derivatives(responses).withColumnRenamed("source_id", "page_id").drop("record")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(language_id.remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    model = ngram_lm.train(docs.filter(~held_out))
    return ngram_lm.score_documents(docs, model).withColumn("held_out", held_out)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resampling.importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract_main_text(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened_rows(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_near_dedup": op2_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_token_files": op5_token_files,
    "op6_media_columns": op6_media_columns,
    "op7_language_id": op7_language_id,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_html_extraction": op12_html_extraction,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op2_near_dedup": near_dedup.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op12_html_extraction": html_extraction.ORACLE,
}
