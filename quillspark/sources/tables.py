"""Parquet tables of the pipeline, read with column pruning left to Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_key(c: Column | str) -> Column:
    """Kinds and event ids compared without case and surrounding blanks."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def latest_rows(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the one with the greatest `by`; nulls lose, exact repeats collapse.

    Ties on `by` are broken by the row's own content, so the choice doesn't depend on partitioning.
    """
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    w = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), F.xxhash64(*plain).desc())
    return df.filter(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def hash_sample(df: DataFrame, key: Column, about: int) -> DataFrame:
    """About `about` rows of df, at most twice as many: the same ones on every run, whatever the partitioning.

    The rows are filtered where they are read, so that no task sends more than its share; the limit only guards the bound.
    """
    n = df.count()
    if n <= about:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * about / n)).limit(2 * about)
