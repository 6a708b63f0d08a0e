"""Numbering of unbroken runs within groups, however many rows one group has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_runs(df: DataFrame, group: str, order: list[str], carry: list[str], breaks: Callable[[Column, Column], Column], block: int) -> DataFrame:
    """df with `run_no`, from 1 per group: a row opens a new run where breaks(row before, row) holds; the first one always does.

    order: columns whose first is a BIGINT; both arguments of `breaks` are structs of it and the columns of `carry`. The order is cut into
    blocks of `block` units: breaks are found inside each block, then over the blocks' first and last rows alone, so that a
    group with a third of all rows is spread over its blocks. Null groups are a group of their own.
    """
    row = F.struct(order[0], *[c for c in carry if c != order[0]])
    b = df.withColumns({"__b": F.floor(F.col(order[0]) / F.lit(block)).cast("bigint"), "__row": row})
    own = Window.partitionBy(group, "__b").orderBy(*order)
    b = b.withColumn("__was", F.lag("__row").over(own)).withColumn("__new", F.when(F.col("__was").isNotNull(), breaks(F.col("__was"), F.col("__row")).cast("int")).otherwise(0))
    b = b.withColumn("__own", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*order)
    ends = b.groupBy(group, "__b").agg(F.min_by("__row", key).alias("__first"), F.max_by("__row", key).alias("__last"), F.sum("__new").alias("__inside"))
    w = Window.partitionBy(group).orderBy("__b")  # over blocks
    ends = ends.withColumn("__prev", F.lag("__last").over(w)).withColumn("__border", F.when(F.col("__prev").isNull(), 1).otherwise(breaks(F.col("__prev"), F.col("__first")).cast("int")))
    before = F.sum(F.col("__border")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("__inside").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col(group).alias("__g"), F.col("__b").alias("__k"), before.alias("__before"))
    j = b.join(ends, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__k")))
    return j.withColumn("run_no", F.col("__own") + F.col("__before")).drop("__b", "__row", "__was", "__new", "__own", "__g", "__k", "__before")
