"""Readers of the pipeline's files, each with an explicit schema and one row per item.

Files that can't be read as what they should be are kept as rows with a status, never dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.moments import stamp_of, tolerant

RUN = "started_at string, ended_at string, ok boolean, scheduler string, phase string, error string, cutoff string, sources map<string, struct<new: int, errors: array<string>>>"
THREAD = "channel string, thread_ts string, messages array<struct<type: string, user: string, ts: string, text: string>>"
EVENT = "ts string, session_id string, event string, duration_ms double, data string"
ACCURACY = ["art_id", "candidate_kind", "pred_mode", "predicted_action", "predicted_scope", "predicted_confidence", "predicted_reasoning", "user_action", "user_scope", "action_agreed", "scope_agreed", "notes", "scope_source"]
#: Sources of text drops and the extensions that they take.
FOLDERS = {"granola": ["md", "txt", "rtf"], "gmeet": ["vtt", "txt"], "transcripts": ["vtt", "srt", "txt"]}
RETIRED = ("slack", "gmail")


def whole_files(spark: SparkSession, path: str, extensions: list[str], since: str | None = None) -> DataFrame:
    """(path, name, content, modified_at) of the files below path, those modified at or after `since`; dot folders are left out."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    f = r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"))
    f = f.filter(~F.col("path").rlike(r"/\.[^/]+/"))
    return f if since is None else f.filter(F.col("modified_at") >= F.lit(since).cast("timestamp"))


def folder_items(spark: SparkSession, source: str, path: str, since: str | None = None) -> DataFrame:
    """Items of a text drop with their dedupe keys: the source and 16 hex digits of the content's SHA-256."""
    if source in RETIRED:
        raise ValueError(f"{source} is no folder source")
    if source not in FOLDERS:
        raise ValueError(f"unknown source {source}")
    f = whole_files(spark, path, FOLDERS[source], since)
    return f.withColumn("dedupe_key", F.concat_ws(":", F.lit(source), F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16)))


def slack_threads(spark: SparkSession, path: str) -> DataFrame:
    """Thread files: (channel, thread_ts, messages, title, created_at, dedupe_key)."""
    t = spark.read.schema(THREAD).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    first = F.split(F.get(F.transform("messages", lambda m: m["text"]), F.lit(0)), "\n")[0]
    return t.withColumns({"title": first, "created_at": F.timestamp_seconds(F.col("thread_ts").try_cast("double")), "dedupe_key": F.concat_ws(":", F.lit("slack"), "channel", "thread_ts")})


def render_thread(messages: Column) -> Column:
    """A thread as text: a heading with time, user and key per message, then its words."""
    head = lambda m: F.concat(F.lit("## "), F.date_format(F.timestamp_seconds(m["ts"].try_cast("double")), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(" — user:"), F.coalesce(m["user"], F.lit("bot")), F.lit(" (ts:"), m["ts"], F.lit(")"))
    return F.array_join(F.transform(messages, lambda m: F.concat(head(m), F.lit("\n\n"), F.coalesce(m["text"], F.lit("")))), "\n\n")


def front_matter(files: DataFrame, strict: bool = False) -> DataFrame:
    """files with (fields MAP, body, status) of texts that begin with a block between `---` lines.

    Top-level `key: value` lines become fields, quotes taken off. Status: ok, none (no block) or open (no end). Strict
    readers want a line end after the block's end.
    """
    close = r"\n---\n" if strict else r"\n---"
    block = F.regexp_extract("content", rf"(?s)\A---\n(.*?){close}", 1)
    begins = F.col("content").startswith("---\n")
    closed = F.col("content").rlike(rf"(?s)\A---\n.*?{close}")
    keys = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$"), F.lit(1))
    values = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$"), F.lit(2)), lambda v: F.regexp_replace(F.trim(v), r"""^(["'])(.*)\1$""", "$2"))
    names = F.array_distinct(keys)  # of repeated keys the first counts
    fields = F.map_from_arrays(names, F.transform(names, lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1)))
    body = F.regexp_replace(F.regexp_replace("content", rf"(?s)\A---\n.*?{close}", ""), r"\A\n+", "")
    return files.withColumns({"fields": F.when(closed, fields), "body": F.when(closed, body).otherwise(F.col("content")), "status": F.when(closed, "ok").when(begins, "open").otherwise("none")})


def event_log(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Events of the day files events-YYYY-MM-DD.jsonl whose names lie in [start, end]; broken and blank lines are skipped."""
    lines = spark.read.option("pathGlobFilter", "events-*.jsonl").text(path).select("value", F.col("_metadata.file_name").alias("name"))
    day = F.regexp_extract("name", r"events-(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    return lines.withColumn("day", day).filter(F.col("day").between(start, end) & good).select("day", F.from_json("value", EVENT).alias("e")).select("day", "e.*")


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """Run files: (name, at, status, and the run's fields). Status: ok, corrupt (no JSON) or other (JSON, but no object)."""
    f = whole_files(spark, path, ["json"])
    run = F.from_json("content", RUN)
    begins = F.trim("content").startswith("{")
    good = F.try_parse_json("content").isNotNull()
    f = f.withColumns({"status": F.when(~good, "corrupt").when(begins, "ok").otherwise("other"), "run": F.when(good & begins, run)})
    at = F.coalesce(tolerant(F.coalesce(F.nullif("run.started_at", F.lit("")), F.col("run.ended_at"))), stamp_of(F.col("name")), F.col("modified_at"))
    return f.select("name", "modified_at", "status", at.alias("at"), "run.*")


def accuracy_log(spark: SparkSession, path: str) -> DataFrame:
    """The prediction log: tab-separated, comment lines first; rows under 12 columns are dropped, a missing 13th is `unknown`."""
    parts = F.split("value", "\t")
    t = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(parts) >= 12))
    cols = [F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(ACCURACY[:-1])]
    return t.select(*cols, F.coalesce(F.nullif(F.get(parts, F.lit(12)), F.lit("")), F.lit("unknown")).alias(ACCURACY[-1]))


def pinned_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic): one per line, trimmed; blank lines and those that begin with # don't count, repeats collapse. Topics are configuration, so they may be collected."""
    t = F.trim("value")
    return spark.read.text(path).select(t.alias("topic")).filter((F.col("topic") != "") & ~F.col("topic").startswith("#")).distinct()


def snapshots(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Snapshots below path, oldest first, each with `known`: whether it has the schema version that this reader is for. Broken lines are left out."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    head = F.from_json("value", "generated_at string, schema_version int")
    s = t.filter(good).select(head.alias("h"), F.col("value").alias("snapshot")).select(F.col("h.generated_at").alias("generated_at"), F.coalesce(F.col("h.schema_version") == version, F.lit(False)).alias("known"), "snapshot")
    return s.orderBy(F.col("generated_at").asc_nulls_first(), "snapshot")
