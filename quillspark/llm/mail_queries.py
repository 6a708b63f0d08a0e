"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.mail import learn_closings, written_lines
from quillspark.sources.tables import kind_key, table


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").filter(kind_key("source_kind") == "gmail_thread").select("raw_id", "content", "modified_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    mails = _mails(spark, d)
    return written_lines(mails, "raw_id", "content", learn_closings(mails, "content"), "modified_at").select("raw_id", "line_no").distinct()


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each mail's new text in one piece."""
    mails = _mails(spark, d)
    lines = written_lines(mails, "raw_id", "content", learn_closings(mails, "content"), "modified_at").dropDuplicates(["raw_id", "line_no"])
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("raw_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("new_text"), F.count("*").alias("n_lines"))


QUERIES = {"p1_found": p1_found, "p1_texts": p1_texts}
