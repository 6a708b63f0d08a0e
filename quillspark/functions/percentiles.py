"""Exact percentiles with linear interpolation that no single task has to hold all values for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_percentiles(df: DataFrame, value: str, named: dict[str, float], by: list[str] | None = None, cells: int = 128) -> DataFrame:
    """One row per group: `by`, `n` non-null values, and a column per name of `named` with that percentile (0 to 1).

    Values are counted before anything else; approximate quantiles cut each group into cells, the cells' totals tell which of them
    hold the ranks sought, and only those few cells are put in order. Groups without values give no row.
    """
    by = by or []
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    cuts = c.groupBy(*by).agg(F.percentile_approx("__v", [i / cells for i in range(1, cells)], 1000).alias("__cuts"))
    at = c.join(cuts, by) if by else c.crossJoin(F.broadcast(cuts))  # ungrouped: one row
    at = at.withColumn("__cell", F.size(F.filter("__cuts", lambda x: x < F.col("__v")))).drop("__cuts")
    w = Window.partitionBy(*by).orderBy("__cell")  # over cells
    totals = at.groupBy(*by, "__cell").agg(F.sum("__n").alias("__t"))
    totals = totals.withColumns({"__before": F.coalesce(F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("__t").over(Window.partitionBy(*by))})
    ranks = {f"{k}_{side}": f((F.col("n") - 1) * p).cast("bigint") for k, p in named.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    holds = [(r >= F.col("__before")) & (r < F.col("__before") + F.col("__t")) for r in ranks.values()]
    wanted = totals.filter(F.greatest(*[h.cast("int") for h in holds]) == 1)
    few = at.join(wanted, [*by, "__cell"])
    inside = Window.partitionBy(*by, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    here = {k: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__n")) for k, r in ranks.items()}
    picked = few.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(h, F.col("__v"))).alias(f"__{k}") for k, h in here.items()])
    between = {k: F.col(f"__{k}_lo") + (F.col(f"__{k}_hi") - F.col(f"__{k}_lo")) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)) for k, p in named.items()}
    return picked.filter("n is not null").select(*by, "n", *[v.alias(k) for k, v in between.items()])
