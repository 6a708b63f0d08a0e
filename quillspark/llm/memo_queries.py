"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.near_duplicates import best_match_clusters, groups, near_pairs, settle_events
from quillspark.operators.timestamp_sql import instants_sql
from quillspark.operators.timestamps import utc_micros
from quillspark.plans.session import materialise
from quillspark.sources.tables import kind_key, latest_rows, table

#: Score from which a memo joins the cluster of another.
CLUSTER = 0.55


def memo_rows(spark: SparkSession, d: str) -> DataFrame:
    m = latest_rows(table(spark, d, "memos").select("id", "created_at", "body_tokens", "modified_at"), "id", "modified_at")
    return m.select("id", utc_micros(F.col("created_at")).alias("t"), F.col("body_tokens").alias("tokens"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(memo_rows(spark, d)).select("memo_a", "memo_b").distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(materialise(memo_rows(spark, d), "p5-rows"))


def st1_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(memo_rows(spark, d), "st1-rows")
    return best_match_clusters(materialise(near_pairs(rows, CLUSTER).select("memo_a", "memo_b", "score"), "st1-pairs"), rows)


def st1_events(spark: SparkSession, d: str) -> DataFrame:
    """What clustering settles per memo: its event, whether it is canonical, was seeded with the event or demoted."""
    clusters = materialise(st1_clusters(spark, d), "st1-clusters")
    m = latest_rows(table(spark, d, "memos").select("id", "event_id", "source_kind", "created_at", "is_canonical_for_event", "modified_at"), "id", "modified_at")
    trust = table(spark, d, "source_authority").groupBy(kind_key("source_kind").alias("source")).agg(F.min("authority").alias("authority"))
    m = m.withColumn("source", kind_key("source_kind")).join(F.broadcast(trust), "source", "left")  # a fixed table
    rows = m.select("id", F.nullif(kind_key("event_id"), F.lit("")).alias("event"), F.coalesce("authority", F.lit(5)).alias("authority"), utc_micros(F.col("created_at")).alias("t"), F.col("is_canonical_for_event").alias("flagged"))
    return settle_events(clusters, rows)


QUERIES = {"st1_events": st1_events, "p5_found": p5_found, "p5_groups": p5_groups, "st1_clusters": st1_clusters}

_LATEST = "(select *, row_number() over (partition by id order by modified_at desc) as rn from memos)"
_PAIRS = (
    f"with recursive x as (select id, created_at as t, null::varchar as zone, body_tokens, event_id, source_kind, is_canonical_for_event from {_LATEST} where rn = 1), " + instants_sql() + """,
 w as (select id, us, unnest(map_entries(body_tokens)) as e from inst), k as (select id, us, e.key as word, e.value::double as c from w where e.value > 0), len as (select id, sum(c * c) as q from k group by 1),
 dots as (select a.id as ia, b.id as ib, any_value(a.us) as ta, any_value(b.us) as tb, sum(a.c * b.c) as dot from k a join k b on a.word = b.word and a.id < b.id group by 1, 2),
 pairs as (select ia, ib, 0.7 * (dot / sqrt(la.q * lb.q)) + 0.3 * coalesce(greatest(0, 1 - abs(ta - tb) / 86400e6 / 7), 0) as score from dots join len la on la.id = ia join len lb on lb.id = ib)"""
)
_TREES = _PAIRS + f""", o as (select id, coalesce(us, -(2::bigint ** 62)::bigint) as t from inst), both_ as (select ia as id, ib as other, score from pairs where score >= {CLUSTER} - 1e-9 union all select ib, ia, score from pairs where score >= {CLUSTER} - 1e-9),
 seen as (select b.*, row_number() over (partition by b.id order by score desc, other) as k from both_ b join o on o.id = b.id join o p on p.id = b.other where (p.t, p.id) < (o.t, o.id)), chosen as (select id, other from seen where k = 1),
 tree as (select id, id as root from o where id not in (select id from chosen) union all select c.id, t.root from chosen c join tree t on t.id = c.other),
 clusters as (select id, root as cluster_id, count(*) over (partition by root) as n_members from tree)"""
ORACLES = {
    "p5_found": _PAIRS + " select ia as memo_a, ib as memo_b from pairs where score >= 0.8 - 1e-9",
    "st1_clusters": _TREES + " select * from clusters",
    "st1_events": _TREES + """, trust as (select lower(trim(source_kind, ' ')) as source, min(authority) as a from source_authority group by 1),
 j as (select c.*, nullif(lower(trim(event_id, ' ')), '') as event, coalesce(is_canonical_for_event, false) as flagged, row_number() over (partition by cluster_id order by coalesce(trust.a, 5), coalesce(us, 2::bigint ** 62), c.id) = 1 as best from clusters c join inst i on i.id = c.id left join trust on trust.source = lower(trim(i.source_kind, ' '))),
 n as (select *, coalesce(max(event) filter (id = cluster_id) over (partition by cluster_id), 'evt-' || substr(sha256(cluster_id), 1, 16)) as made from j)
 select id, case when n_members = 1 then event else coalesce(event, made) end as event, case when n_members = 1 then flagged else best end as canonical, n_members > 1 and event is null as seeded, n_members > 1 and flagged and not best as demoted from n""",
}
