"""Deterministic samples and assignments by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing as H


def hash_sample(df: DataFrame, groups: list[str], id_col: str, k: int, seed: int) -> DataFrame:
    """The first k ids of each group by seeded digest; the rank filter keeps k rows of each group before the shuffle."""
    order = H.sample_order(F.col(id_col).cast("string"), seed)
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(order, id_col)))
    return ranked.filter(F.col("place") <= k)


def selection_counts(df: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Requested, available and selected rows of each group."""
    n = df.groupBy(*groups).agg(F.count("*").alias("available"))
    return n.select(*groups, F.lit(k).cast("long").alias("requested"), "available", F.least("available", F.lit(k)).cast("long").alias("selected"))


def stratified_fill(df: DataFrame, group: str, id_col: str, mandatory: Column, k: int, seed: int) -> DataFrame:
    """All mandatory rows of each group first, then others by digest, up to k."""
    order = H.sample_order(F.col(id_col).cast("string"), seed)
    ranked = df.withColumn("mandatory", mandatory).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("mandatory"), order, id_col)))
    return ranked.filter(F.col("place") <= k)


def positional_folds(df: DataFrame, group: str, id_col: str) -> DataFrame:
    return df.withColumn("fold", F.row_number().over(Window.partitionBy(group).orderBy(id_col)) - 1)


def counterbalance(spark, participants: int = 12, pairs: int = 6) -> DataFrame:
    """Each participant's tasks: which passage of each pair, under which condition, in a rotated order."""
    p, i = F.col("participant"), F.col("pair")
    grid = spark.range(participants).withColumnRenamed("id", "participant").select("participant", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("pair"))
    grid = grid.withColumn("passage", ((p + i) % 2).cast("int")).withColumn("condition", F.when((F.floor(p / 2) + i) % 2 == 1, "highlighted").otherwise("plain"))
    turn = (i + p) % pairs
    return grid.withColumn("position", F.row_number().over(Window.partitionBy("participant").orderBy(turn)))


def noncontiguous(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys that come back after their run has ended, with their number of runs: islands over a total order.

    A run begins where the row before has another key.  The row before is found within ranges of the order that are
    sorted in parallel; only the edges of the ranges meet in one place.
    """
    part = df.select(key, *order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    inside = part.withColumn("__before", F.lag(F.struct(F.col(key).alias("k"))).over(Window.partitionBy("__p").orderBy(*order)))
    edges = part.groupBy("__p").agg(F.max_by(F.struct(F.col(key).alias("k")), F.struct(*order)).alias("__last"))
    edges = edges.withColumn("__edge", F.lag("__last").over(Window.orderBy("__p"))).select("__p", "__edge")
    joined = inside.join(F.broadcast(edges), "__p")
    before = F.coalesce("__before", "__edge")
    starts = joined.filter(before.isNull() | ~before["k"].eqNullSafe(F.col(key)))
    return starts.groupBy(key).agg(F.count("*").alias("runs")).filter("runs > 1")
