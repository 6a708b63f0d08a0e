"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.timestamp_sql import instants_sql
from quillspark.operators.timestamps import shape_mask, utc_micros
from quillspark.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The time texts of the three tables, one row per distinct (row, text, zone)."""
    slack = table(spark, d, "slack_messages").select(F.lit("slack_messages").alias("src"), F.col("msg_id").cast("string").alias("row_key"), F.col("ts").alias("text"), F.col("user_tz").alias("zone"))
    memos = table(spark, d, "memos").select(F.lit("memos").alias("src"), F.col("id").alias("row_key"), F.col("created_at").alias("text"), F.lit(None).cast("string").alias("zone"))
    items = table(spark, d, "harvest_items").select(F.lit("harvest_items").alias("src"), F.col("ref_no").cast("string").alias("row_key"), F.col("created_at").alias("text"), F.col("meta")["tz"].alias("zone"))
    return slack.unionByName(memos).unionByName(items)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).filter(F.col("text").isNotNull())
    return rows.select("src", "row_key", utc_micros(F.col("text"), F.col("zone")).alias("utc_micros")).filter("utc_micros is not null").distinct()


def p6_shapes(spark: SparkSession, d: str) -> DataFrame:
    """How often each shape occurs and how many of its texts gave an instant: what a new source must be checked for."""
    rows = _texts(spark, d).select("src", shape_mask(F.col("text")).alias("mask"), utc_micros(F.col("text"), F.col("zone")).alias("m"))
    return rows.groupBy("src", F.coalesce("mask", F.lit("")).alias("mask")).agg(F.count("*").alias("n_texts"), F.count("m").alias("n_instants"))


QUERIES = {"p6_found": p6_found, "p6_shapes": p6_shapes}

_X = """with x as (select 'slack_messages' as src, msg_id::varchar as row_key, ts as t, user_tz as zone from slack_messages union all select 'memos', id, created_at, null from memos
 union all select 'harvest_items', ref_no::varchar, created_at, meta['tz'] from harvest_items), """
_MASK = r"coalesce(regexp_replace(regexp_replace(tt, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g'), '')"
ORACLES = {
    "p6_found": _X + instants_sql() + " select distinct src, row_key, us as utc_micros from inst where us is not null",
    "p6_shapes": _X + instants_sql() + f" select src, {_MASK} as mask, count(*) as n_texts, count(us) as n_instants from inst group by 1, 2",
}
