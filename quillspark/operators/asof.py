"""Bounded nearest-timestamp join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(left: DataFrame, right: DataFrame, by: str, left_id: str, right_id: str, bucket_us: int, buckets: int = 1) -> DataFrame:
    """left with (match_id, gap_us): per row of left the right row of equal `by` that is nearest in time.

    Both sides have `at` (BIGINT microseconds). Candidates lie in the row's bucket of bucket_us microseconds and the
    `buckets` ones before. Ties: the row's own bucket first, then the smaller right_id. Without candidate, or with a null key or
    time, match_id is null. Right rows are shown to the buckets that may ask for them, a constant number; within a bucket both sides are
    merged in order of time and each left row looks at its neighbours alone, so that work grows with the rows, not with their product.
    """
    cell = F.floor(F.col("at") / F.lit(bucket_us)).cast("bigint")
    ask = left.filter(F.col(by).isNotNull() & F.col("at").isNotNull()).select(F.col(by), "at", cell.alias("cell"), F.lit(None).cast("int").alias("back"), F.col(left_id).alias("l_id"), F.lit(None).cast(right.schema[right_id].dataType).alias("r_id"))
    show = right.filter(F.col(by).isNotNull() & F.col("at").isNotNull()).groupBy(by, "at").agg(F.min(right_id).alias("r_id"))  # of equal times the smaller id
    show = show.select(F.col(by), "at", F.explode(F.sequence(F.lit(0), F.lit(buckets))).alias("back"), cell.alias("c"), "r_id")
    show = show.select(F.col(by), "at", (F.col("c") + F.col("back")).cast("bigint").alias("cell"), F.col("back").cast("int").alias("back"), F.lit(None).cast(left.schema[left_id].dataType).alias("l_id"), "r_id")
    w = Window.partitionBy(by, "cell").orderBy("at")
    seen = F.when(F.col("r_id").isNotNull(), F.struct("at", "back", "r_id"))
    before = F.last(seen, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("gap_us"), F.col(f"{c}.back").alias("back"), F.col(f"{c}.r_id").alias("r_id")))
    met = ask.unionByName(show).withColumns({"before": before, "after": after}).filter("l_id is not null")
    best = met.select("l_id", F.least(option("before"), option("after")).alias("best")).groupBy("l_id").agg(F.min("best").alias("best"))
    best = best.select(F.col("l_id").alias(left_id), F.col("best.r_id").alias("match_id"), F.col("best.gap_us").alias("gap_us"))
    return left.join(best, left_id, "left")
