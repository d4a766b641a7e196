"""Where iterative operators keep their steps, and running sums over a whole table."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder in ``spark.checkpoint.dir`` (a temporary one only where that is unset in local mode) and go on from there."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexaudit-"))
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[Column], sums: dict[str, str], by: list[str] = ()) -> DataFrame:
    """``df`` with running sums (new name -> column) in the given order, in each group or over all rows; ``order`` must not tie in a group.

    Over all rows, ranges of the order are summed in parallel, and only one row of totals for each range meets in one place.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({k: F.sum(c).over(w) for k, c in sums.items()})
    dealt = cut(df.sparkSession, df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__p").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    totals = totals.select("__p", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in sums])
    # as many rows as ranges
    out = dealt.join(F.broadcast(totals), "__p").withColumns({k: F.sum(c).over(inside) + F.col(f"__{k}") for k, c in sums.items()})
    return out.drop("__p", *[f"__{k}" for k in sums])


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with its rows numbered from 0 in the given order."""
    one = running(df.withColumn("__one", F.lit(1)), [F.col(c) for c in order], {name: "__one"})
    return one.withColumn(name, F.col(name) - 1).drop("__one")
