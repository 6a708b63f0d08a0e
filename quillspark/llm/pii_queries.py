"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.pii import find_pii, fit, mask_pii
from quillspark.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    slack = table(spark, d, "slack_messages").select(F.lit("slack_messages").alias("src"), F.col("msg_id").cast("string").alias("row_key"), "text")
    raw = table(spark, d, "raw_items").select(F.lit("raw_items").alias("src"), F.col("raw_id").alias("row_key"), F.col("content").alias("text"))
    return slack.unionByName(raw)


def _model(spark: SparkSession, d: str):
    return fit(_texts(spark, d).filter("src = 'raw_items'").unionByName(_texts(spark, d).filter("src = 'slack_messages'")), table(spark, d, "people"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(_texts(spark, d), _model(spark, d)).distinct()


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    return mask_pii(_texts(spark, d), _model(spark, d)).distinct()


QUERIES = {"p4_found": p4_found, "p4_masked": p4_masked}
