"""Registry of queries, and the binding of the data model to the test tables.

``examples``: one row for each document (source: its source, domain: its
language), with an official split, version and generator by rule, the stand-in
score, and a fixed calibration.  ``labelled`` keeps the labelled ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The fixed calibration map of the example scores.
WEIGHT, INTERCEPT = 1.7, -0.3


def query(sql: str | None = None, over_examples: bool = False):
    """Register a query under its function's name; ``over_examples`` puts the definition of examples and labelled in front of the SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = PRELUDE + sql if over_examples else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(text) -> Column:
    """The official split of an example with this id."""
    h = H.hash_int(text) % 10
    return F.when(h < 6, "development").when(h < 8, "calibration").otherwise("test")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(table(spark, sf_dir, "documents"))


def _examples(docs: DataFrame) -> DataFrame:
    more = [c for c in docs.columns if c in ("label", "quality")]
    d = docs.select(*more, "doc_id", F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("domain"), F.col("source").alias("source_id"))
    d = d.withColumn("split", split_of("id"))
    d = d.withColumn("version", F.when(F.col("doc_id") % 3 == 0, "v0").when(F.col("doc_id") % 3 == 1, "v2").otherwise("v4"))
    d = d.withColumn("generator", F.when(F.col("doc_id") % 4 == 0, "held-out").when(F.col("doc_id") % 4 == 1, "gen-a").otherwise("gen-b"))
    # the count goes through a generator of one row: filters on what follows from it stay above, so that words are found once
    d = d.select("*", F.inline(F.array(F.struct(F.size(T.words("text")).alias("n_words")))))
    d = d.withColumn("status", F.when(F.col("doc_id") % 97 == 5, "failed").when(F.col("n_words") < 8, "insufficient").otherwise("scored"))
    d = d.withColumn("raw", F.when(F.col("status") == "scored", H.hash_unit("id")))
    return d.withColumn("calibrated", F.round(H.calibrate("raw", WEIGHT, INTERCEPT), 6))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with label 1 for toxic documents; the small label table decides the join's size."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    return _examples(table(spark, sf_dir, "documents").join(labels, "doc_id"))


WORD_SQL = r"'[\p{L}\p{N}]+(?:[''’]\p{L}+)*'"
PRELUDE = rf"""WITH ex0 AS (SELECT doc_id, doc_id::VARCHAR AS id, text, lang AS domain, source AS source_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS h,
    len(regexp_extract_all(text, {WORD_SQL}))::INT AS n_words FROM documents),
ex1 AS (SELECT * EXCLUDE (h), CASE WHEN h < 6 THEN 'development' WHEN h < 8 THEN 'calibration' ELSE 'test' END AS split,
    CASE doc_id % 3 WHEN 0 THEN 'v0' WHEN 1 THEN 'v2' ELSE 'v4' END AS version, CASE doc_id % 4 WHEN 0 THEN 'held-out' WHEN 1 THEN 'gen-a' ELSE 'gen-b' END AS generator,
    CASE WHEN doc_id % 97 = 5 THEN 'failed' WHEN n_words < 8 THEN 'insufficient' ELSE 'scored' END AS status FROM ex0),
ex2 AS (SELECT *, CASE WHEN status = 'scored' THEN ('0x' || substr(sha256(id), 1, 4))::INT / 65535.0::DOUBLE END AS raw FROM ex1),
examples AS MATERIALIZED (SELECT *, CASE WHEN raw IS NOT NULL THEN round(1 / (1 + exp(-greatest(-35, least(35, {INTERCEPT} + {WEIGHT} * ln(greatest(1e-6, least(1 - 1e-6, raw)) / (1 - greatest(1e-6, least(1 - 1e-6, raw)))))))), 6) END AS calibrated FROM ex2),
labelled AS MATERIALIZED (SELECT e.*, toxic AS label, quality FROM examples e JOIN labels USING (doc_id))
"""
