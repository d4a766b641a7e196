"""Readers and writers: JSON, JSON lines, corpus CSV, checksums, predictions, reports."""

from __future__ import annotations

import ast
import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict: a malformed line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def audit_jsonl(lines: DataFrame, line: Column, schema: str) -> DataFrame:
    """``lines`` with the parsed record and whether the line is malformed; blank lines are neither."""
    parsed = F.from_json(line, schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    out = lines.filter(F.trim(line) != "").withColumn("record", parsed)
    return out.withColumn("malformed", F.col("record").isNull() | F.col("record._corrupt").isNotNull())


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line, text) of the malformed lines with their physical numbers: files are read whole, one record each."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "text"))
    return audit_jsonl(text, F.col("text"), schema).filter("malformed").select((F.col("pos") + 1).alias("line"), "text")


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CORPUS_RECORD).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).option("mode", "FAILFAST").csv(path)


def parse_list(cell: str | None) -> list[str] | None:
    """A serialised list: JSON, or else a Python literal; never evaluated. None if it is no list."""
    if cell is None:
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(cell)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        return [v if isinstance(v, str) else json.dumps(v) for v in value] if isinstance(value, list) else None
    return None


def _parse_cells(cells: pd.Series) -> pd.Series:
    return cells.map(parse_list)


def parse_list_column(cell: Column) -> Column:
    """JSON lists stay in the JVM; only what JSON cannot read goes to the literal reader."""
    literal = F.pandas_udf(_parse_cells, T.ArrayType(T.StringType()))
    as_json = F.from_json(cell, "array<string>")
    return F.coalesce(as_json, literal(F.when(as_json.isNull(), cell)))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), "length", F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, sidecars: DataFrame, revision: str) -> DataFrame:
    """Files against their sidecar rows (path, sha256, revision): ok only if both agree."""
    j = files.alias("f").join(sidecars.alias("s"), "path", "left")
    ok = F.coalesce((F.col("f.sha256") == F.col("s.sha256")) & (F.col("s.revision") == revision), F.lit(False))
    return j.select("path", "length", F.col("f.sha256").alias("sha256"), ok.alias("ok"))


def write_jsonl(df: DataFrame, path: str, exclusive: bool = True) -> None:
    """Lines of JSON; an existing path is refused unless ``exclusive`` is off. The commit protocol makes it all or nothing."""
    df.write.mode("errorifexists" if exclusive else "overwrite").option("ignoreNullFields", False).json(path)


def write_json(path: str, value, exclusive: bool = False) -> None:
    """One small artifact: written aside and moved, or created only if it is new; readable by its owner alone."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    body = json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    target = path if exclusive else f"{path}.{os.getpid()}.tmp"
    flags = os.O_WRONLY | os.O_CREAT | (os.O_EXCL if exclusive else os.O_TRUNC)
    with os.fdopen(os.open(target, flags, 0o600), "w", encoding="utf-8") as f:
        f.write(body)
    if not exclusive:
        os.replace(target, path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of an XML sitemap."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
