"""Dense numbers in a stated order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_number(df: DataFrame, order: str, out: str, shift: int, start: int = 0) -> DataFrame:
    """``df`` with column ``out``: its rank by the distinct long ``order``, from ``start``.

    Rows are ranked inside ranges of 2**shift order values; the ranges' sizes - one row per range - are summed up
    in a window of their own and joined back, so the only ordered single task is over ranges, not rows.
    """
    ranged = df.withColumn("_range", F.shiftright(order, shift))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_rank", rank).join(offsets, "_range").withColumn(out, (F.col("_before") + F.col("_rank") + (start - 1)).cast("long")).drop("_range", "_rank", "_before")
