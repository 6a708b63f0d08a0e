"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.survivors import FIELDS, NO_VALUE, agreement, golden_records, judge_values, resolve_events, survivors
from quillspark.operators.timestamp_sql import instants_sql
from quillspark.operators.timestamps import utc_micros
from quillspark.plans.session import materialise
from quillspark.sources.tables import kind_key, latest_rows, table


def event_members(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memos").select("id", "source_kind", "created_at", "title", "summary", "tags", "body", "event_id", "superseded_by", "modified_at")
    m = resolve_events(latest_rows(m, "id", "modified_at")).filter("event is not null")
    trust = table(spark, d, "source_authority").groupBy(kind_key("source_kind").alias("source")).agg(F.min("authority").alias("authority"))
    m = m.withColumns({"source": kind_key("source_kind"), "micros": utc_micros(F.col("created_at"))}).join(trust, "source", "left")
    return m.select("event", "id", "source", "authority", "micros", "title", "summary", "tags", "body")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(event_members(spark, d)).select(F.col("event").alias("event_id"), "field", "memo_id")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return golden_records(materialise(event_members(spark, d), "p2-members")).withColumnRenamed("event", "event_id")


def p2_source_quality(spark: SparkSession, d: str) -> DataFrame:
    members = materialise(event_members(spark, d).select("event", "source", "tags"), "p2-members")
    return judge_values(members)[1].select("source", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often the surviving value of a field is also the quality model's choice."""
    return agreement(event_members(spark, d))


QUERIES = {"p2_found": p2_found, "p2_records": p2_records, "p2_source_quality": p2_source_quality, "p2_agreement": p2_agreement}


_HAS = r"lower(regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')) not in (" + ", ".join(f"'{v}'" for v in NO_VALUE) + ")"
_THERE = {f: _HAS.format(f) for f in FIELDS} | {"id": "true", "tags": "len(list_filter(coalesce(tags, []), lambda g: " + _HAS.format("g") + ")) > 0"}
ORACLES = {
    "p2_found": "with recursive m as (select * from (select *, row_number() over (partition by id order by modified_at desc) as rn from memos) where rn = 1), ends as (select id, case when "
    + _HAS.format("event_id") + r" then lower(regexp_replace(event_id, '^\s+|\s+$', '', 'g')) end as event, case when " + _HAS.format("superseded_by") + """ then trim(superseded_by, ' ') end as via from m),
 walk as (select id, event, case when event is null then via end as nxt from ends union select w.id, e.event, case when e.event is null then e.via end from walk w join ends e on e.id = w.nxt),
 x as (select m.* exclude (event_id), w.event, created_at as t, null::varchar as zone from m join walk w on w.id = m.id where w.event is not null), """
    + instants_sql() + """, trust as (select lower(trim(source_kind, ' ')) as source, min(authority) as a from source_authority group by 1),
 r as (select i.*, count(*) over (partition by i.event) as members, coalesce(trust.a, 2::bigint ** 62) as a, coalesce(-us, 2::bigint ** 62) as late from inst i left join trust on trust.source = lower(trim(i.source_kind, ' '))),
 f as (""" + " union all ".join(f"select event, id, a, late, '{f}' as field from r where members >= 2 and {_THERE[f]}" for f in ["id", *FIELDS]) + """)
 select event as event_id, field, id as memo_id from (select *, row_number() over (partition by event, field order by a, late, id) as k from f) where k = 1""",
}
