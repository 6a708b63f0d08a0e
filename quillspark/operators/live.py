"""Live augmentation and its bookkeeping: when memory doesn't suffice, what live calls brought, growth, histories and the snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import markup, text
from quillspark.operators.memory import memos
from quillspark.operators.metrics import log, user_experience
from quillspark.operators.runs import freshness, runs
from quillspark.operators.texts import item_key, slack
from quillspark.sources.tables import kind_key, latest_rows, table

#: Live bodies are kept up to so many characters, topics up to so many.
BODY, TOPIC = 65_536, 64


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """(msg_id, hits, topic, reason): a message as a question; memory has the hits that the event of the same number counts, teams are the pinned topics."""
    pinned = sorted(r["team"] for r in table(spark, d, "people").select("team").filter("team is not null").distinct().collect())  # of a fixed table
    e = log(spark, d).select(F.col("event_id").alias("msg_id"), F.coalesce(F.col("hits") % 5, F.lit(0)).alias("hits"))
    m = slack(spark, d, F.substring(markup.first_topic(F.coalesce("text", F.lit("")), pinned), 1, TOPIC).alias("topic")).join(e, "msg_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return m.select("msg_id", hits.alias("hits"), "topic", markup.live_reason(hits, F.col("topic")).alias("reason"))


def live_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).groupBy("reason", "topic").agg(F.count("*").alias("n"))


def a7_gap_reasons(spark: SparkSession, d: str) -> DataFrame:
    """One row: questions, gaps per question and the gaps by reason as a text of pairs."""
    g = decisions(spark, d).groupBy("reason").agg(F.count("*").alias("n"))
    pairs = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "reason", "n")))), ",")
    return g.agg(F.sum("n").alias("queries"), F.round(F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("gap_rate"), pairs.alias("by_reason"))


def a8_live_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of harvest runs per source by outcome (error, empty, success), and calls per run."""
    r = runs(spark, d, "sources")
    total = r.agg(F.count("*").alias("n_runs"))
    c = r.select(F.explode("sources").alias("source", "x"))
    failed = F.size(F.coalesce("x.errors", F.array().cast("array<string>"))) > 0
    empty = ~failed & (F.coalesce("x.new", F.lit(0)) == 0)
    g = c.groupBy("source").agg(F.count("*").alias("calls"), F.count_if(failed).alias("error"), F.count_if(empty).alias("empty"), F.count_if(~failed & ~empty).alias("success"))
    return g.crossJoin(F.broadcast(total)).select("source", "calls", "error", "empty", "success", F.round(F.col("calls") / F.col("n_runs"), 4).alias("calls_per_run"))  # one row


def a10_growth(spark: SparkSession, d: str) -> DataFrame:
    """Canonical memos added per month: alternates and later states of a memo are no growth."""
    return memos(spark, d, "is_canonical_for_event").filter("is_canonical_for_event").groupBy(F.date_format("modified_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def a16_freshness_states(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the states in which schedulers are, and of runs whose outcome is unknown."""
    r = runs(spark, d, "scheduler", "ok", "error")
    return freshness(r, "scheduler").groupBy("state").agg(F.count("*").alias("n")).unionByName(r.filter("ok is null").groupBy(F.lit("UNKNOWN").alias("state")).agg(F.count("*").alias("n")))


def a19_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """One row: the metrics of the event log, of memory and of the runs at once."""
    u = user_experience(log(spark, d))
    m = memos(spark, d, "is_canonical_for_event", "provenance").agg(F.count("*").alias("memos"), F.count_if("is_canonical_for_event").alias("canonical"), F.count_if(F.col("provenance") == "live").alias("live"))
    r = runs(spark, d, "ok").agg(F.count("*").alias("runs"), F.round(F.try_divide(F.count_if("ok"), F.count("*")), 4).alias("success_rate"))
    return u.crossJoin(m).crossJoin(r)  # one row each


def a26_memo_counts(spark: SparkSession, d: str) -> DataFrame:
    """Memos and those superseded, in one pass."""
    return memos(spark, d, "superseded_by").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("superseded_by") != "", F.lit(False))).alias("n_superseded"))


def a28_severities(spark: SparkSession, d: str) -> DataFrame:
    """Runs by how bad their end was, worst first."""
    worst = F.when(F.col("ok"), "none").when(F.col("ok").isNull(), "unknown").when(F.col("error").isNull(), "medium").otherwise("high")
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "unknown", 1).otherwise(0)
    g = runs(spark, d, "ok", "error").groupBy(worst.alias("severity")).agg(F.count("*").alias("n"))
    return g.select("severity", "n", rank.alias("rank")).orderBy(F.desc("rank"), F.desc("n"))


def w10_steady_growth(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether its months from the fourth on each added more than the one before. The window is over months."""
    n = memos(spark, d).groupBy("source", F.date_format("modified_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("month")
    n = n.withColumns({"i": F.row_number().over(w), "next": F.lead("n").over(w)})
    return n.groupBy("source").agg(F.count("*").alias("months"), F.coalesce(F.bool_and(F.when((F.col("i") >= 4) & F.col("next").isNotNull(), F.col("n") < F.col("next"))), F.lit(True)).alias("steady"))


def w12_last_errors(spark: SparkSession, d: str) -> DataFrame:
    """The last ten errors per scheduler, oldest first; the rest is dropped before anything is collected."""
    r = runs(spark, d, "scheduler", "error").filter("error is not null")
    w = Window.partitionBy("scheduler").orderBy(F.desc("at"), F.desc("run_id"))
    last = r.withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
    kept = F.array_sort(F.collect_list(F.struct("at", "run_id", "error")))
    return last.groupBy("scheduler").agg(F.array_join(F.transform(kept, lambda x: x["error"]), "|").alias("errors"), F.count("*").alias("n"))


def j9_idle_sources(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of source with five memos or more of which the last batches bring nothing."""
    m = memos(spark, d).groupBy("source").agg(F.count("*").alias("n")).filter("n >= 5")
    active = table(spark, d, "harvest_items").select(kind_key("source_name").alias("name")).distinct()
    named = m.withColumn("name", F.when(F.col("source").startswith("gmeet"), "gmeet").when(F.col("source").startswith("granola"), "granola").when(F.col("source").startswith("slack"), "slack").when(F.col("source").startswith("transcript"), "transcripts").otherwise(F.col("source")))
    return named.join(active, "name", "left_anti").select("source", "n")


def st7_late_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that arrive after a later batch has begun: judged in a second pass over what the first one missed."""
    i = latest_rows(table(spark, d, "harvest_items").select("ref_no", "batch_no", "arrived_at"), "ref_no", "arrived_at")
    begun = i.groupBy("batch_no").agg(F.min("arrived_at").alias("begun"))  # as many rows as batches
    nxt = begun.withColumn("next_begun", F.lead("begun").over(Window.orderBy("batch_no"))).select("batch_no", "next_begun")
    late = i.join(nxt, "batch_no").withColumn("late", F.coalesce(F.col("arrived_at") > F.col("next_begun"), F.lit(False)))
    return late.groupBy("batch_no").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


def k8_live_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Items as live artifacts: where they'd be written, the length kept of their body, and whether it was cut; guarded against
    missing sources, queries and bodies, which give a reason instead."""
    i = latest_rows(table(spark, d, "harvest_items").select("ref_no", "source_name", "title", "content", "arrived_at"), "ref_no", "arrived_at")
    why = F.when(F.trim(F.coalesce("source_name", F.lit(""))) == "", "no_source").when(F.trim(F.coalesce("title", F.lit(""))) == "", "no_query").when(F.trim(F.coalesce("content", F.lit(""))) == "", "no_body")
    path = F.concat(F.lit("raw/live/"), "source_name", F.lit("/"), F.date_format("arrived_at", "yyyy-MM-dd'T'HHmmss'Z'"), F.lit("-"), text.digest(F.col("title")), F.lit(".md"))
    return i.select("ref_no", why.alias("rejected"), F.when(why.isNull(), path).alias("path"), F.least(F.length("content"), F.lit(BODY)).cast("bigint").alias("kept"), (F.length("content") > BODY).alias("cut"))


def st11_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    """Items per source that no processed marker names yet, and how many of them can be written now; the rest waits for the next run."""
    i = latest_rows(table(spark, d, "harvest_items").select("ref_no", "source_name", item_key().alias("key"), F.col("title").isNotNull().alias("titled"), "arrived_at"), "ref_no", "arrived_at")
    done = table(spark, d, "harvest_seen").filter("memory_path is not null").select(F.col("dedupe_key").alias("key")).distinct()
    left = i.join(done, "key", "left_anti")
    return left.groupBy("source_name").agg(F.count("*").alias("n"), F.count_if("titled").alias("n_ready"))


QUERIES = {
    f.__name__: f
    for f in (
        live_decisions, a7_gap_reasons, a8_live_calls, a10_growth, a16_freshness_states, a19_snapshot, a26_memo_counts, a28_severities, w10_steady_growth, w12_last_errors,
        j9_idle_sources, st7_late_items, k8_live_artifacts, st11_unprocessed,
    )
}

from quillspark.operators.metrics import ORACLES as _METRICS  # noqa: E402
from quillspark.operators.runs import ORACLES as _RUN_SQL  # noqa: E402
from quillspark.operators.runs import _RUNS  # noqa: E402

_M = "with m as (select *, lower(trim(source_kind, ' ')) as source from (select *, row_number() over (partition by id order by modified_at desc) as rn from memos) where rn = 1)"
_I = "i as (select * from (select *, row_number() over (partition by ref_no order by arrived_at desc) as rn from harvest_items) where rn = 1)"
_D = r"""with s as (select msg_id, coalesce(text, '') as text from (select *, row_number() over (partition by msg_id order by ingested_at desc) as rn from slack_messages) where rn = 1),
 t as (select s.msg_id, min(team) as topic from s join (select distinct team from people where team is not null) p on regexp_matches(lower(s.text), '\b' || lower(p.team) || '\b') group by 1),
 d as (select s.msg_id, coalesce(try_cast(json_extract_string(e.props, '$.k') as bigint) % 5, 0) as hits, substr(t.topic, 1, 64) as topic from s left join t on t.msg_id = s.msg_id left join events e on e.event_id = s.msg_id),
 r as (select *, case when hits = 0 then 'zero_hit' when topic is not null then 'topic_pinned' end as reason from d)"""
ORACLES = {
    "live_decisions": _D + " select reason, topic, count(*) as n from r group by 1, 2",
    "a7_gap_reasons": _D + ", g as (select reason, count(*) as n from r group by 1) select sum(n)::bigint as queries, round(sum(case when reason is not null then n else 0 end) / sum(n), 4) as gap_rate, string_agg(reason || '=' || n, ',' order by reason || '=' || n) filter (reason is not null) as by_reason from g",
    "a8_live_calls": _RUNS + """, c as (select unnest(map_keys(sources)) as source, unnest(map_values(sources)) as x from runs), f as (select source, len(coalesce(x.errors, [])) > 0 as failed, coalesce(x.new, 0) = 0 as nothing from c)
 select source, count(*) as calls, count(*) filter (failed) as error, count(*) filter (not failed and nothing) as empty, count(*) filter (not failed and not nothing) as success, round(count(*) / (select count(*) from runs), 4) as calls_per_run from f group by 1""",
    "a10_growth": _M + " select strftime(modified_at, '%Y-%m') as month, count(*) as n from m where is_canonical_for_event group by 1",
    "a16_freshness_states": "with x as (" + _RUN_SQL["w2_freshness"] + "), u as (select count(*) as n from (select *, row_number() over (partition by run_id order by modified_at desc) as rn from harvest_runs) where rn = 1 and ok is null) select state, count(*) as n from x group by 1 union all select 'UNKNOWN', n from u where n > 0",
    "a19_snapshot": "with u as (" + _METRICS["a2_user_experience"] + "), mm as (" + _M + " select count(*) as memos, count(*) filter (is_canonical_for_event) as canonical, count(*) filter (provenance = 'live') as live from m), rr as (" + _RUNS + " select count(*) as runs, round(count(*) filter (ok) / count(*), 4) as success_rate from runs) select * from u, mm, rr",
    "a26_memo_counts": _M + " select count(*) as n, count(*) filter (trim(superseded_by, ' ') <> '') as n_superseded from m",
    "a28_severities": _RUNS + """, s as (select case when ok then 'none' when ok is null then 'unknown' when error is null then 'medium' else 'high' end as severity from runs)
 select severity, count(*) as n, (case severity when 'high' then 3 when 'medium' then 2 when 'unknown' then 1 else 0 end)::int as rank from s group by 1""",
    "w10_steady_growth": _M + """, n as (select source, strftime(modified_at, '%Y-%m') as month, count(*) as n from m group by 1, 2), w as (select *, row_number() over (partition by source order by month) as i, lead(n) over (partition by source order by month) as nxt from n)
 select source, count(*) as months, coalesce(bool_and(n < nxt) filter (i >= 4 and nxt is not null), true) as steady from w group by 1""",
    "w12_last_errors": _RUNS + """, l as (select *, row_number() over (partition by scheduler order by t_us desc, run_id desc) as k from runs where error is not null) select scheduler, string_agg(error, '|' order by t_us, run_id) as errors, count(*) as n from l where k <= 10 group by 1""",
    "j9_idle_sources": _M + """, g as (select source, count(*) as n, case when source like 'gmeet%' then 'gmeet' when source like 'granola%' then 'granola' when source like 'slack%' then 'slack' when source like 'transcript%' then 'transcripts' else source end as name from m group by source having count(*) >= 5)
 select source, n from g where name is null or name not in (select lower(trim(source_name, ' ')) from harvest_items where source_name is not null)""",
    "st7_late_items": f"with {_I}, b as (select batch_no, min(arrived_at) as begun from i group by 1), n as (select batch_no, lead(begun) over (order by batch_no) as nxt from b) select i.batch_no, count(*) as n, count(*) filter (arrived_at > nxt) as n_late from i join n on n.batch_no = i.batch_no group by 1",
    "k8_live_artifacts": f"""with {_I}, w as (select *, case when trim(coalesce(source_name, ''), ' ') = '' then 'no_source' when trim(coalesce(title, ''), ' ') = '' then 'no_query' when trim(coalesce(content, ''), ' ') = '' then 'no_body' end as why from i)
 select ref_no, why as rejected, case when why is null then 'raw/live/' || source_name || '/' || strftime(arrived_at, '%Y-%m-%dT%H%M%SZ') || '-' || substr(sha256(title), 1, 8) || '.md' end as path, least(length(content), 65536)::bigint as kept, length(content) > 65536 as cut from w""",
    "st11_unprocessed": f"""with {_I}, k as (select *, case when source_name = 'slack' then 'slack:' || id else source_name || ':' || substr(sha256(coalesce(content, '')), 1, 16) end as key from i)
 select source_name, count(*) as n, count(*) filter (title is not null) as n_ready from k where key not in (select dedupe_key from harvest_seen where memory_path is not null and dedupe_key is not null) group by 1""",
}
