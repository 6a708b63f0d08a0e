"""Threshold rules over daily metrics, their staleness, cached results and line checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text
from quillspark.operators.metrics import coverage, log
from quillspark.sources.tables import kind_key, latest_rows, table

# Metric, threshold it must exceed, severity. A null metric gives no finding.
RULES = [("empty_handed_rate", 0.09, "high"), ("gap_rate", 1.0, "high"), ("miss_rate", 0.01, "medium")]
# Line rules as (name, pattern, word that allows the line).
LINE_RULES = [("unfinished", r"(?i)\b(todo|fixme|tbd)\b", "example"), ("slow_step", r"took \d{4,} rows", "INFO"), ("open_question", r"^(?:[-*] )?Open question:", "decided")]
STALE_RUNS = 5


def findings(day: DataFrame) -> DataFrame:
    """(day, metric, value, severity) of the rules that a day's metrics break."""
    m = day.withColumn("miss_rate", 1 - F.col("memory_hit_rate"))
    rules = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(t).alias("most"), F.lit(s).alias("severity")) for n, t, s in RULES])
    return m.select("day", F.explode(rules).alias("r")).filter("r.value > r.most").select("day", "r.metric", F.round("r.value", 4).alias("value"), "r.severity")


def r1_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings(coverage(log(spark, d)))


def w5_stale_findings(spark: SparkSession, d: str) -> DataFrame:
    """Per metric: how often found, first and last day, the longest unbroken run of days and whether it is stale."""
    f = r1_findings(spark, d).select("metric", "day")
    w = Window.partitionBy("metric").orderBy("day")
    runs = f.withColumn("island", F.date_sub(F.col("day").cast("date"), F.row_number().over(w))).groupBy("metric", "island").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    g = runs.groupBy("metric").agg(F.sum("n").alias("found"), F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.max("n").alias("longest_run"))
    return g.withColumn("stale", F.col("longest_run") >= STALE_RUNS)


def st4_cached_states(spark: SparkSession, d: str) -> DataFrame:
    """Latest memos against the results cached for their earlier states, by id and digest of the body: hits, changed, new."""
    m = table(spark, d, "memos").select("id", "source_kind", "body", "modified_at")
    latest = latest_rows(m, "id", "modified_at").select("id", kind_key("source_kind").alias("source"), text.digest(F.coalesce("body", F.lit(""))).alias("h"), "modified_at")
    older = m.select("id", text.digest(F.coalesce("body", F.lit(""))).alias("h2"), F.col("modified_at").alias("at2"))
    j = latest.join(older, (latest["id"] == older["id"]) & (older["at2"] < latest["modified_at"]), "left")
    per = j.groupBy(latest["id"], "source").agg(F.max((F.col("h") == F.col("h2")).cast("int")).alias("same"))
    state = F.when(F.col("same").isNull(), "new").when(F.col("same") == 1, "hit").otherwise("changed")
    return per.groupBy("source", state.alias("state")).agg(F.count("*").alias("n"))


def st2_scan_window(spark: SparkSession, d: str) -> DataFrame:
    """Memos per source changed since the watermark, the last successful run before 2026-06-01; the next watermark is the run's start."""
    r = latest_rows(table(spark, d, "harvest_runs").select("run_id", "ok", "modified_at"), "run_id", "modified_at").filter("ok and modified_at < timestamp'2026-06-01 00:00:00'")
    mark = r.agg(F.max("modified_at").alias("mark"))
    m = latest_rows(table(spark, d, "memos").select("id", "source_kind", "modified_at"), "id", "modified_at").crossJoin(F.broadcast(mark))  # one row
    return m.groupBy(kind_key("source_kind").alias("source")).agg(F.count_if(F.col("modified_at") >= F.col("mark")).alias("to_scan"), F.count("*").alias("n"))


def t7_quota(spark: SparkSession, d: str) -> DataFrame:
    """Items per batch that a quota of 20 new ones per source would evaluate now, and those left for later."""
    i = latest_rows(table(spark, d, "harvest_items").select("ref_no", "batch_no", "source_name", "arrived_at"), "ref_no", "arrived_at")
    n = i.groupBy("batch_no", "source_name").agg(F.count("*").alias("n"))
    return n.select("batch_no", "source_name", F.least("n", F.lit(20)).alias("evaluated"), F.greatest(F.col("n") - 20, F.lit(0)).alias("left_over"))


def v16_line_checks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that a rule's pattern finds and no allowing word of the same line excuses, per rule and source."""
    lines = table(spark, d, "documents").select(kind_key("source").alias("source"), F.explode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("line"))
    broken = F.array(*[F.when(F.col("line").rlike(p) & ~F.contains("line", F.lit(a)), F.lit(n)) for n, p, a in LINE_RULES])
    return lines.select("source", F.explode(broken).alias("rule")).filter("rule is not null").groupBy("rule", "source").agg(F.count("*").alias("n_lines"))


def u_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of source known to memos, the archive and the trust table: in how many of the three each is."""
    kinds = [table(spark, d, t).select(kind_key("source_kind").alias("source")).distinct().withColumn("place", F.lit(p)) for t, p in (("memos", "memos"), ("raw_items", "archive"), ("source_authority", "trust"))]
    both = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return both.groupBy("source").agg(F.count("*").alias("n_places"), F.array_join(F.array_sort(F.collect_set("place")), ",").alias("places"))


QUERIES = {f.__name__: f for f in (r1_findings, w5_stale_findings, st4_cached_states, st2_scan_window, t7_quota, v16_line_checks, u_key_sets)}

_F = """with e as (select strftime(ts, '%Y-%m-%d') as day, event_type as event, try_cast(json_extract_string(props, '$.k') as bigint) as hits from events),
 c as (select day, round(avg((hits > 0)::int) filter (event = 'purchase'), 4) as hit, round(avg((hits < 10)::int) filter (event = 'purchase'), 4) as empty, round(count(*) filter (event = 'error') / nullif(count(*) filter (event = 'purchase'), 0), 4) as gap from e group by 1),
 f as (select day, 'empty_handed_rate' as metric, empty as value, 'high' as severity from c where empty > 0.09 union all select day, 'gap_rate', gap, 'high' from c where gap > 1.0 union all select day, 'miss_rate', round(1 - hit, 4), 'medium' from c where 1 - hit > 0.01)"""
ORACLES = {
    "r1_findings": _F + " select * from f",
    "w5_stale_findings": _F + """, i as (select metric, day, day::date - row_number() over (partition by metric order by day)::int as island from f), r as (select metric, island, count(*) as n, min(day) as a, max(day) as b from i group by 1, 2)
 select metric, sum(n)::bigint as found, min(a) as first_day, max(b) as last_day, max(n) as longest_run, max(n) >= 5 as stale from r group by 1""",
    "st4_cached_states": """with l as (select * from (select *, row_number() over (partition by id order by modified_at desc) as rn from memos) where rn = 1),
 p as (select l.id, lower(trim(any_value(l.source_kind), ' ')) as source, max((sha256(coalesce(l.body, '')) = sha256(coalesce(o.body, '')))::int) filter (o.id is not null) as same from l left join memos o on o.id = l.id and o.modified_at < l.modified_at group by l.id)
 select source, case when same is null then 'new' when same = 1 then 'hit' else 'changed' end as state, count(*) as n from p group by 1, 2""",
    "st2_scan_window": """with r as (select max(modified_at) as mark from (select *, row_number() over (partition by run_id order by modified_at desc) as rn from harvest_runs) where rn = 1 and ok and modified_at < timestamptz '2026-06-01 00:00:00+00'),
 l as (select * from (select *, row_number() over (partition by id order by modified_at desc) as rn from memos) where rn = 1)
 select lower(trim(source_kind, ' ')) as source, count(*) filter (modified_at >= (select mark from r)) as to_scan, count(*) as n from l group by 1""",
    "t7_quota": "select batch_no, source_name, least(count(distinct ref_no), 20) as evaluated, greatest(count(distinct ref_no) - 20, 0) as left_over from harvest_items group by 1, 2",
    "v16_line_checks": r"""with l as (select lower(trim(source, ' ')) as source, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line from documents)
 select rule, source, count(*) as n_lines from (select 'unfinished' as rule, source from l where regexp_matches(line, '(?i)\b(todo|fixme|tbd)\b') and not contains(line, 'example') union all select 'slow_step', source from l where regexp_matches(line, 'took \d{4,} rows') and not contains(line, 'INFO')
 union all select 'open_question', source from l where regexp_matches(line, '^(?:[-*] )?Open question:') and not contains(line, 'decided')) group by 1, 2""",
    "u_key_sets": """with k as (select distinct lower(trim(source_kind, ' ')) as source, 'memos' as place from memos union all select distinct lower(trim(source_kind, ' ')), 'archive' from raw_items union all select distinct lower(trim(source_kind, ' ')), 'trust' from source_authority)
 select source, count(*) as n_places, string_agg(place, ',' order by place) as places from k group by 1""",
}
