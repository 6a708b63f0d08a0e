"""Writers: event log, harvested items, archive split, snapshots, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import tsv_safe
from quillspark.plans.session import materialise

EVENT_BYTES = 4000
# Keys of event data that name persons or texts and are never written.
DENIED = """raw_query query_text query raw_text body content message prompt email email_address phone phone_number ssn name full_name username
user_id user address ip ip_address dob birthdate password api_key apikey token access_token refresh_token secret credential authorization
auth cookie session_token""".split()


def safe_data(data: Column) -> Column:
    """A MAP<STRING,STRING> without denied keys, whatever their case."""
    return F.map_filter(data, lambda k, v: ~F.lower(k).isin(DENIED))


def append_events(events: DataFrame, path: str) -> None:
    """Events (ts TIMESTAMP, session_id, event, duration_ms, data MAP) to JSON by day; an event over EVENT_BYTES is left out."""
    e = events.withColumns({"data": safe_data(F.col("data")), "event": F.substring("event", 1, 64), "event_date": F.date_format("ts", "yyyy-MM-dd")})
    line = F.to_json(F.struct("ts", "session_id", "event", "duration_ms", "data"))
    e.filter(F.octet_length(line) <= EVENT_BYTES).write.mode("append").partitionBy("event_date").json(path)


def harvest(items: DataFrame, state_path: str, raw_path: str, spark: SparkSession, dry_run: bool = False) -> DataFrame:
    """Append the items (dedupe_key, ...) whose key isn't in the state, then their keys; running it twice writes nothing more.

    Items of one key in a batch count once, the one with the smallest content digest. Gives the new items.
    """
    one = items.filter("dedupe_key is not null").groupBy("dedupe_key").agg(F.min_by(F.struct(*items.columns), F.xxhash64("content")).alias("x")).select("x.*")
    try:
        seen = spark.read.parquet(state_path).select("dedupe_key")
        one = one.join(seen.distinct(), "dedupe_key", "left_anti")
    except Exception as e:  # no state yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    one = materialise(one, "harvest")
    if not dry_run:
        one.write.mode("append").parquet(raw_path)
        one.select("dedupe_key").write.mode("append").parquet(state_path)
    return one


def split_archive(memos: DataFrame, state: Column, path: str) -> None:
    """Write memos as two partitions: moved ones to the archive, others stay retrievable."""
    memos.withColumn("place", F.when(state == "moved", "archive").otherwise("retrievable")).write.mode("overwrite").partitionBy("place").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below path, without version control, archives and credentials."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keep = ~F.col("path").rlike(r"/\.(git|archive)/") & ~F.lower("path").rlike(r"(credential|secret|\.pem$|\.key$|/\.env)")
    return f.filter(keep).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(listed: DataFrame, there: DataFrame) -> DataFrame:
    """(path, problem): missing, unlisted, changed, or unsafe paths; nothing for a sound archive."""
    j = listed.alias("l").join(there.alias("t"), "path", "full_outer")
    unsafe = F.col("path").rlike(r"^/|(^|/)\.\.(/|$)")
    problem = F.when(unsafe, "unsafe").when(F.col("t.sha256").isNull(), "missing").when(F.col("l.sha256").isNull(), "unlisted").when(F.col("l.sha256") != F.col("t.sha256"), "changed")
    return j.select("path", problem.alias("problem")).filter("problem is not null")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text; tabs and line ends inside fields become blanks."""
    df.select(*[tsv_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns]).write.mode("append").option("sep", "\t").option("quote", "").csv(path)


def write_snapshot(row: DataFrame, path: str, start: str, end: str, generated: str) -> str:
    """One JSON snapshot in a folder of its own, never overwriting one."""
    to = f"{path}/{start}_{end}_{generated}"
    row.coalesce(1).write.mode("error").json(to)
    return to


def mark_processed(keys: DataFrame, path: str, at: Column) -> None:
    """Append (key, processed_at) of what has been worked off; a key may be marked again, readers take keys as a set. Null keys are left out."""
    keys.select("key").filter("key is not null").distinct().withColumn("processed_at", at).write.mode("append").parquet(path)


def unprocessed(keys: DataFrame, path: str) -> DataFrame:
    """The rows of keys (key, ...) that no marker below path names; all of them where nothing has been marked yet."""
    try:
        done = keys.sparkSession.read.parquet(path).select("key").distinct()
    except Exception as e:  # no marker yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return keys
    return keys.join(done, "key", "left_anti")
