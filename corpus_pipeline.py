"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage's result is written as Parquet and read again as the next one's documents. Each row is judged by
its own doc_id and text: rows with a null or repeated doc_id are documents like others. An empty table
passes through all stages as an empty one. Columns besides those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplemill.llm import decontamination, language_id, line_dedup, near_dedup, packing
from samplemill.llm.common import DOCUMENT_COLUMNS, bounded_batches, read_table, written

#: The stage links from 0.8 on (op2 alone from 0.85); these bands miss a pair there with odds of 2 in 10 million.
NEAR_PERCENT, NEAR_BANDS, NEAR_BAND_ROWS = 80, 29, 4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; lang becomes the one predicted.

    A null or empty text, one without a letter and one between two languages goes; repeated rows are judged
    alike; very long texts are compressed whole. A null lang is no label, and is filled in.
    """
    bounded_batches(spark)
    learned = language_id.learn_dictionaries(language_id.training_rows(docs))
    found = language_id.identify_languages(docs.select(*DOCUMENT_COLUMNS), learned)
    return found.filter(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*DOCUMENT_COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs; what had nothing else goes.

    A null text stays null and an empty one empty. The first copy stays: that of the smallest doc_id (null
    first), then of the smaller line. Rows that repeat doc_id and text keep the same lines. n_chars is that
    of the text that is left, and stays as it was where nothing went.
    """
    bounded_batches(spark)
    clean = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    left = clean.filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, of several with it the
    one with the smallest hash of its text, and one row of those that repeat both.

    A null doc_id comes last. Null and empty texts, and those without words, are no duplicates and all stay.
    """
    bounded_batches(spark)
    return near_dedup.drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS), percent=NEAR_PERCENT, bands=NEAR_BANDS, band_rows=NEAR_BAND_ROWS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; rows that repeat go or stay alike; very long texts are looked
    through whole. An empty or null item is held by none.
    """
    bounded_batches(spark)
    return decontamination.drop_contaminated(docs.select(*DOCUMENT_COLUMNS), read_table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of the packed sequences, as packing.pack_documents returns them: each row of docs is packed
    whole, a null or empty text as its end id alone, repeated rows each, a very long text in many pieces."""
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", pack_stage),
]

#: SQL can't express compression, MinHash or byte-pair encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
