"""Metrics of the event log: response times, coverage, attribution, sessions.

The event table stands for the log: a session is a user's day, `view` starts a query, `purchase` ends one, `click` is a
compression and `error` a gap; `value` is a duration and props.k a number of hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.percentiles import exact_percentiles
from quillspark.operators.asof import nearest
from quillspark.operators.islands import number_runs
from quillspark.sources.tables import table

DAY_US = 86_400_000_000


def log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "user_id", session.alias("session"), F.col("event_type").alias("event"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("hits"))


def user_experience(events: DataFrame) -> DataFrame:
    """One row: queries, sessions, exact percentiles of response times and of queries per session, and the share of abandoned sessions."""
    per = events.groupBy("session").agg(F.count_if(F.col("event") == "purchase").alias("ended"), F.count_if(F.col("event") == "view").alias("started"))
    sessions = per.agg(
        F.count("*").alias("sessions_total"),
        F.round(F.count_if(F.expr("started > 0 and ended = 0")) / F.greatest(F.count_if(F.expr("started > 0")), F.lit(1)), 4).alias("query_abandonment_rate"),
    )
    ended = events.filter("event = 'purchase'")
    times = exact_percentiles(ended, "value", {"a": 0.5, "b": 0.95}).select(F.col("a").cast("bigint").alias("time_to_response_ms_p50"), F.col("b").cast("bigint").alias("time_to_response_ms_p95"))
    each = exact_percentiles(per.filter("ended > 0"), "ended", {"queries_per_session_p50": 0.5, "queries_per_session_p95": 0.95}).drop("n")
    total = ended.agg(F.count("*").alias("queries_total"))
    return total.crossJoin(sessions).join(times, how="left").join(each, how="left")  # one row each, or none without values


def coverage(events: DataFrame) -> DataFrame:
    """Per day of the log: queries, hit and empty-handed rates (null without queries), gaps per query."""
    q, gap = F.col("event") == "purchase", F.col("event") == "error"
    day = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(q).alias("queries"), F.avg(F.when(q, (F.col("hits") > 0).cast("int"))).alias("hit"), F.avg(F.when(q, (F.col("hits") < 10).cast("int"))).alias("empty"), F.count_if(gap).alias("gaps")
    )
    return day.select("day", "queries", F.round("hit", 4).alias("memory_hit_rate"), F.round("empty", 4).alias("empty_handed_rate"), "gaps", F.round(F.try_divide("gaps", "queries"), 4).alias("gap_rate"))


def sessions(events: DataFrame, gap_us: int = 1_800_000_000) -> DataFrame:
    """(user_id, session_no, started, ended, n_events): a session goes on while the gap to the event before is at most gap_us."""
    e = events.filter("user_id is not null").select("user_id", "event_id", "at")
    numbered = number_runs(e, "user_id", ["at", "event_id"], [], lambda was, row: row["at"] - was["at"] > gap_us, DAY_US).withColumnRenamed("run_no", "session_no")
    return numbered.groupBy("user_id", "session_no").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n_events"))


def a2_user_experience(spark: SparkSession, d: str) -> DataFrame:
    return user_experience(log(spark, d))


def a6_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(log(spark, d))


def a8_event_histogram(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy(F.coalesce(F.nullif("event", F.lit("")), F.lit("unknown")).alias("event")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


def a9_outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour of the day by type, further types in `other`."""
    hour = F.hour(F.col("ts")).alias("hour")
    known = F.when(F.col("event").isin("view", "click", "purchase"), F.col("event")).otherwise("other")
    p = log(spark, d).withColumn("kind", known).groupBy(hour).pivot("kind", ["view", "click", "purchase", "other"]).count().fillna(0)
    return p.withColumn("total", F.col("view") + F.col("click") + F.col("purchase") + F.col("other"))


def a11_topic_breadth(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("event").agg(F.countDistinct("hits").alias("breadth"), F.sum("hits").alias("hits"))


def a14_source_economy(spark: SparkSession, d: str) -> DataFrame:
    """Per attributed source of a compression: count, over-budget count and rate; the count of large ones is null rather than 0."""
    a = j1_nearest_event(spark, d).select("match_id", "event_id")
    e = log(spark, d)
    src = e.select(F.col("event_id").alias("match_id"), (F.col("hits") % 5).alias("source"))
    mine = a.join(e.select("event_id", "value"), "event_id").join(src, "match_id", "left").withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("unknown")))
    over = F.count_if(F.col("value") > 50)
    return mine.groupBy("source").agg(F.count("*").alias("n"), over.alias("over_budget"), F.round(over / F.count("*"), 4).alias("over_budget_rate"), F.nullif(F.count_if(F.col("value") > 100), F.lit(0).cast("bigint")).alias("large"))


def j1_nearest_event(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's nearest click of the same day or the day before."""
    e = log(spark, d)
    left = e.filter("event = 'purchase'").select("event_id", "user_id", "at")
    right = e.filter("event = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "at")
    return nearest(left, right, "user_id", "event_id", "click_id", DAY_US).select("event_id", "user_id", "match_id", "gap_us")


def j17_abandoned_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    ended = e.filter("event = 'purchase'").select("session").distinct()
    return e.filter("event = 'view'").select("session").distinct().join(ended, "session", "left_anti")


def s19_daily_spine(spark: SparkSession, d: str) -> DataFrame:
    """Events per day, days without events included."""
    e = log(spark, d).select(F.to_date("ts").alias("day"), "event")
    spine = e.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    n = e.groupBy("day").agg(F.count("*").alias("n"))
    return spine.join(n, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def w8_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(log(spark, d))


def w11_daily_change(spark: SparkSession, d: str) -> DataFrame:
    """Events per day with the day before's and whether they grew. The window is over days, not events."""
    days = log(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")
    return days.withColumn("n_before", F.lag("n").over(w)).withColumn("grew", F.col("n") > F.col("n_before"))


QUERIES = {f.__name__: f for f in (a2_user_experience, a6_coverage, a8_event_histogram, a9_outcome_pivot, a11_topic_breadth, a14_source_economy, j1_nearest_event, j17_abandoned_sessions, s19_daily_spine, w8_sessions, w11_daily_change)}

_LOG = """with log as (select event_id, ts, epoch_us(ts) as t_us, user_id, user_id::varchar || '-' || strftime(ts, '%Y-%m-%d') as session, event_type as event, value,
 try_cast(json_extract_string(props, '$.k') as bigint) as hits from events)"""
_NEAREST = """, near as (select event_id, user_id, match_id, gap_us from (
  select l.event_id, l.user_id, r.event_id as match_id, abs(l.t_us - r.t_us) as gap_us,
   row_number() over (partition by l.event_id order by abs(l.t_us - r.t_us), l.t_us // 86400000000 - r.t_us // 86400000000, r.event_id) as rn
  from (select * from log where event = 'purchase') l left join (select * from log where event = 'click') r
   on l.user_id = r.user_id and r.t_us // 86400000000 in (l.t_us // 86400000000, l.t_us // 86400000000 - 1)) where rn = 1)"""
ORACLES = {
    "a2_user_experience": _LOG + """, per as (select session, count(*) filter (event = 'purchase') as ended, count(*) filter (event = 'view') as started from log group by 1)
 select * from (select count(*) as queries_total, trunc(quantile_cont(value, 0.5))::bigint as time_to_response_ms_p50, trunc(quantile_cont(value, 0.95))::bigint as time_to_response_ms_p95 from log where event = 'purchase'),
 (select count(*) as sessions_total, quantile_cont(ended, 0.5) filter (ended > 0)::double as queries_per_session_p50, quantile_cont(ended, 0.95) filter (ended > 0)::double as queries_per_session_p95,
 round(count(*) filter (started > 0 and ended = 0) / greatest(count(*) filter (started > 0), 1), 4) as query_abandonment_rate from per)""",
    "a6_coverage": _LOG + """ select strftime(ts, '%Y-%m-%d') as day, count(*) filter (event = 'purchase') as queries, round(avg((hits > 0)::int) filter (event = 'purchase'), 4) as memory_hit_rate,
 round(avg((hits < 10)::int) filter (event = 'purchase'), 4) as empty_handed_rate, count(*) filter (event = 'error') as gaps, round(count(*) filter (event = 'error') / nullif(count(*) filter (event = 'purchase'), 0), 4) as gap_rate from log group by 1""",
    "a8_event_histogram": _LOG + " select coalesce(nullif(event, ''), 'unknown') as event, count(*) as n, count(distinct user_id) as n_users from log group by 1",
    "a9_outcome_pivot": _LOG + """ select hour(ts)::int as hour, count(*) filter (event = 'view') as view, count(*) filter (event = 'click') as click, count(*) filter (event = 'purchase') as purchase,
 count(*) filter (event not in ('view', 'click', 'purchase')) as other, count(*) as total from log group by 1""",
    "a11_topic_breadth": _LOG + " select event, count(distinct hits) as breadth, sum(hits)::bigint as hits from log group by 1",
    "a14_source_economy": _LOG + _NEAREST + """ select coalesce((s.hits % 5)::varchar, 'unknown') as source, count(*) as n, count(*) filter (l.value > 50) as over_budget, round(count(*) filter (l.value > 50) / count(*), 4) as over_budget_rate,
 nullif(count(*) filter (l.value > 100), 0) as large from near n join log l on l.event_id = n.event_id left join log s on s.event_id = n.match_id group by 1""",
    "j1_nearest_event": _LOG + _NEAREST + " select * from near",
    "j17_abandoned_sessions": _LOG + " select distinct session from log where event = 'view' and session not in (select session from log where event = 'purchase')",
    "s19_daily_spine": """with e as (select ts::date as day, count(*) as n from events group by 1), r as (select min(day) as a, max(day) as b from e)
 select strftime(s.day, '%Y-%m-%d') as day, coalesce(n, 0) as n from (select unnest(generate_series(a, b, interval 1 day))::date as day from r) s left join e on e.day = s.day""",
    "w8_sessions": _LOG + """, m as (select *, case when t_us - lag(t_us) over w > 1800000000 or lag(t_us) over w is null then 1 else 0 end as new from log where user_id is not null window w as (partition by user_id order by t_us, event_id)),
 s as (select *, sum(new) over (partition by user_id order by t_us, event_id rows unbounded preceding)::bigint as session_no from m)
 select user_id, session_no, min(t_us) as started, max(t_us) as ended, count(*) as n_events from s group by 1, 2""",
    "w11_daily_change": _LOG + ", d as (select strftime(ts, '%Y-%m-%d') as day, count(*) as n from log group by 1) select *, lag(n) over (order by day) as n_before, n > lag(n) over (order by day) as grew from d",
}
