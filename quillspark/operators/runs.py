"""Run states of the harvester: health, streaks of failures, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.moments import tolerant
from quillspark.operators.islands import number_runs
from quillspark.sources.tables import latest_rows, table

#: Older than this a newest run is stale; so many failures with one error in a row are a stuck state.
MAX_AGE_HOURS, STUCK = 26, 3
MONTH_US = 30 * 86_400_000_000


def runs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per run, with the columns named and `at`: started_at, else ended_at, else the time of modification."""
    r = latest_rows(table(spark, d, "harvest_runs").select("run_id", "modified_at", "started_at", "ended_at", *columns), "run_id", "modified_at")
    at = F.coalesce(tolerant(F.coalesce(F.nullif("started_at", F.lit("")), F.col("ended_at"))), F.col("modified_at"))
    return r.withColumn("at", at)


def streaks(r: DataFrame) -> DataFrame:
    """(scheduler, error, first_at, last_at, n_failures): unbroken failures with one error, per scheduler in order of time.

    A missing error is ''. Runs with unknown outcome neither break nor extend a streak.
    """
    known = r.filter("ok is not null").select("scheduler", "run_id", F.unix_micros("at").alias("at"), "ok", F.when(F.col("ok"), F.lit("")).otherwise(F.coalesce("error", F.lit(""))).alias("error"))
    numbered = number_runs(known, "scheduler", ["at", "run_id"], ["ok", "error"], lambda was, row: (was["ok"] != row["ok"]) | (was["error"] != row["error"]), MONTH_US)
    out = numbered.filter("not ok").groupBy("scheduler", "error", "run_no").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n_failures"))
    return out.select("scheduler", "error", "first_at", "last_at", "n_failures")


def freshness(r: DataFrame, by: str) -> DataFrame:
    """State per `by` of its newest run as of the newest run of all: STUCK, STUCK_AND_STALE, STALE, FAILED or PASS, in this order.

    `failures` is the length of the unbroken failures with one error that the newest run ends; a run of unknown outcome breaks them.
    """
    now = r.agg(F.max("at").alias("now"))
    bad = F.coalesce(~F.col("ok"), F.lit(False))
    runs_ = r.select(F.col(by), "run_id", F.unix_micros("at").alias("at"), "ok", bad.alias("bad"), F.coalesce("error", F.lit("")).alias("error"))
    numbered = number_runs(runs_, by, ["at", "run_id"], ["bad", "error"], lambda was, row: ~was["bad"] | ~row["bad"] | (was["error"] != row["error"]), MONTH_US)
    per = numbered.groupBy(by, "run_no").agg(F.count_if("bad").alias("failures"), F.max(F.struct("at", "run_id", "ok")).alias("last"))
    s = per.groupBy(by).agg(F.max_by(F.struct("failures", "last"), "run_no").alias("x")).select(by, "x.failures", F.col("x.last.at").alias("at"), F.col("x.last.ok").alias("ok"))
    s = s.crossJoin(F.broadcast(now)).withColumn("age_hours", (F.unix_micros("now") - F.col("at")) / 3.6e9)  # now is one row
    stale, stuck = F.col("age_hours") > MAX_AGE_HOURS, F.col("failures") >= STUCK
    state = F.when(stuck & stale, "STUCK_AND_STALE").when(stuck, "STUCK").when(stale, "STALE").when(~F.col("ok"), "FAILED").otherwise("PASS")
    return s.select(by, state.alias("state"), "failures", F.round("age_hours", 4).alias("age_hours"))


def a15_run_health(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d, "ok").withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return r.groupBy("day").agg(F.count("*").alias("runs"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.try_divide(F.count_if("ok"), F.count("*")), 4).alias("success_rate"))


def a17_errors_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = runs(spark, d, "sources").select(F.explode("sources").alias("source", "x"))
    return s.groupBy("source").agg(F.sum(F.size(F.coalesce("x.errors", F.array().cast("array<string>")))).cast("bigint").alias("errors"), F.sum("x.new").cast("bigint").alias("new_items")).filter("errors > 0")


def w1_failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return streaks(runs(spark, d, "scheduler", "ok", "error"))


def w2_freshness(spark: SparkSession, d: str) -> DataFrame:
    return freshness(runs(spark, d, "scheduler", "ok", "error"), "scheduler")


def w7_cutoff_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Per scheduler the newest success, from which the next run reads; none: a cold start."""
    g = runs(spark, d, "scheduler", "ok").groupBy("scheduler").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("good"), F.max("at").alias("last"))
    days = (F.unix_micros("last") - F.unix_micros("good")) / 8.64e10
    return g.select("scheduler", F.unix_micros("good").alias("anchor"), F.when(F.col("good").isNull(), "cold_start").when(days > 14, "too_old").otherwise("resume").alias("mode"))


QUERIES = {f.__name__: f for f in (a15_run_health, a17_errors_by_source, w1_failure_streaks, w2_freshness, w7_cutoff_anchor)}

_RUNS = """with runs as (select *, epoch_us(coalesce(try_cast(coalesce(nullif(started_at, ''), ended_at) as timestamptz), modified_at)) as t_us from
 (select *, row_number() over (partition by run_id order by modified_at desc) as rn from harvest_runs) where rn = 1)"""
ORACLES = {
    "a15_run_health": _RUNS + """ select strftime(make_timestamp(t_us), '%Y-%m-%d') as day, count(*) as runs, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed,
 round(count(*) filter (ok) / count(*), 4) as success_rate from runs group by 1""",
    "a17_errors_by_source": _RUNS + """ select e.k as source, sum(len(coalesce(e.v.errors, [])))::bigint as errors, sum(e.v.new)::bigint as new_items from (select unnest(map_keys(sources)) as k, unnest(map_values(sources)) as v from runs) e
 group by 1 having sum(len(coalesce(e.v.errors, []))) > 0""",
    "w1_failure_streaks": _RUNS + """, k as (select scheduler, run_id, t_us, ok, case when ok then null else coalesce(error, '') end as error from runs where ok is not null),
 i as (select *, row_number() over (partition by scheduler order by t_us, run_id) - row_number() over (partition by scheduler, ok, error order by t_us, run_id) as island from k)
 select scheduler, error, min(t_us) as first_at, max(t_us) as last_at, count(*) as n_failures from i where not ok group by scheduler, error, island""",
    "w2_freshness": _RUNS + """, n as (select *, row_number() over w as rn, first_value(coalesce(error, '')) over w as newest_error from runs window w as (partition by scheduler order by t_us desc, run_id desc)),
 b as (select *, max(case when coalesce(not ok, false) and coalesce(error, '') = newest_error then 0 else 1 end) over (partition by scheduler order by rn rows unbounded preceding) as broken from n),
 s as (select scheduler, max(t_us) as t_us, arg_max(coalesce(ok::int, 2), -rn) as ok, count(*) filter (broken = 0) as failures from b group by 1),
 t as (select *, ((select max(t_us) from runs) - t_us) / 3.6e9 as age from s)
 select scheduler, case when failures >= 3 and age > 26 then 'STUCK_AND_STALE' when failures >= 3 then 'STUCK' when age > 26 then 'STALE' when ok = 0 then 'FAILED' else 'PASS' end as state, failures, round(age, 4) as age_hours from t""",
    "w7_cutoff_anchor": _RUNS + """, g as (select scheduler, max(t_us) filter (ok) as good, max(t_us) as last from runs group by 1)
 select scheduler, good as anchor, case when good is null then 'cold_start' when (last - good) / 8.64e10 > 14 then 'too_old' else 'resume' end as mode from g""",
}
