"""Queries of problems 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.containers import document_items, fill_containers
from quillspark.llm.mixing import draw, reached_shares
from quillspark.llm.splitting import split_pieces
from quillspark.llm.tokens import configured, token_count
from quillspark.plans.session import materialise
from quillspark.sources.tables import kind_key, table


def limits(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of a purpose; a fixed table of three rows."""
    row = table(spark, d, "size_limits").filter(F.col("purpose") == purpose).agg(F.min("max_tokens"), F.min("overlap_tokens")).first()
    return int(row[0]), int(row[1] or 0)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = limits(spark, d, "piece")
    return split_pieces(table(spark, d, "documents"), "doc_id", "text", limit, overlap, tokenizer=None).select("doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = limits(spark, d, "piece")
    return split_pieces(table(spark, d, "documents"), "doc_id", "text", limit, overlap, configured(spark)).withColumnRenamed("size", "n_tokens")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = limits(spark, d, "container")
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    packed = fill_containers(document_items(docs, capacity, configured(spark)), capacity)
    return packed.select("container_id", F.col("item").alias("doc_id"), F.col("part").alias("piece_no"), F.col("size").alias("n_tokens"), F.col("filled").alias("container_tokens"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mix_targets").groupBy(kind_key("source").alias("source"))
    return t.agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", kind_key("source").alias("source"), "text")
    wanted = docs.join(F.broadcast(_targets(spark, d).select("source")), "source", "left_semi")
    return wanted.select("doc_id", "source", token_count(F.col("text"), configured(spark)).alias("size"))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """Every document of a target source with its expected and its drawn number of copies."""
    return draw(_sized(spark, d), _targets(spark, d), limits(spark, d, "mixture")[0])


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return p9_copies(spark, d).filter("copies > 0").select("doc_id", "source", F.col("size").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached_shares(materialise(p9_copies(spark, d), "p9-drawn"), _targets(spark, d))


QUERIES = {"p9_copies": p9_copies, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p8_containers": p8_containers, "p10_found": p10_found, "p10_pieces": p10_pieces}
ORACLES = {
    "p10_found": "select distinct doc_id from documents where length(text) // 4 > (select min(max_tokens) from size_limits where purpose = 'piece')",
}
