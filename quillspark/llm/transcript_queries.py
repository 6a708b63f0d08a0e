"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.transcripts import learn, speaker_turns
from quillspark.sources.tables import kind_key, table


def _turns(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "raw_items").filter(kind_key("source_kind").isin("gmeet_transcript", "transcript_file")).select("raw_id", "content")
    return speaker_turns(items, "raw_id", "content", learn(items, "content"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("raw_id", "turn_no", "speaker", "n_words").distinct()


def p7_turns(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).dropDuplicates(["raw_id", "turn_no"])


QUERIES = {"p7_found": p7_found, "p7_turns": p7_turns}
