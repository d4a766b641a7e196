"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.  ``run``
writes each stage's rows as Parquet to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm import common as C
from lexaudit.llm.op2_packing import pack_documents
from lexaudit.llm.op3_lines import dedup_lines
from lexaudit.llm.op6_simhash import one_of_each
from lexaudit.llm.op8_language import identify, train
from lexaudit.llm.op9_decontaminate import find_contamination
from lexaudit.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold; rows without a language (no letters, no text) go, and lang becomes the prediction."""
    docs = docs.select(COLUMNS)
    model = train(docs.filter(C.id_bucket("doc_id", 4) != 2))
    known = identify(docs, model, keep=tuple(COLUMNS)).filter("lang_pred <> 'und'")
    return known.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; so does a document that they leave without a word."""
    out = dedup_lines(docs.select(COLUMNS))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one with the smallest id, a null id last."""
    return one_of_each(docs.select(COLUMNS)).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = find_contamination(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(COLUMNS))
    return found.filter("not contaminated").select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the language model nor the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; those of the stages before it are deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        folder = C.new_folder(spark, f"pipeline-{name}")
        docs = C.table(stage(spark, docs, sf_dir), folder)
        if before:
            C.drop(spark, before)
        before = folder
    return docs
