"""Memory objects: expiry, inventory, tags, canonical choice, references, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import moments, text
from quillspark.functions.percentiles import exact_percentiles
from quillspark.operators.timestamp_sql import instants_sql
from quillspark.operators.timestamps import utc_micros
from quillspark.sources.tables import kind_key, latest_rows, table

AS_OF = "2026-11-01 00:00:00"
# Days that a kind is kept; null is for ever, a kind that isn't listed has DEFAULT_DAYS.
KEEP_DAYS = {"strategy": 180, "weekly": 90, "retrospective": 180, "decision": None, "legal": None, "thread": 90, "note": 90, "glossary_term": None, "incident": 365, "customer_call": 180}
DEFAULT_DAYS = 90
# Fixed value: the authority of a kind of source that isn't listed.
DEFAULT_AUTHORITY = 5


def memos(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(id, modified_at, source, and the columns named) of the latest state of each memo; only what is named is read and shuffled."""
    m = table(spark, d, "memos").select("id", "modified_at", kind_key("source_kind").alias("source"), *columns)
    return latest_rows(m, "id", "modified_at")


def iso(c: Column | str) -> Column:
    return moments.tolerant(F.col(c) if isinstance(c, str) else c)


def expiry_state(m: DataFrame, now: Column) -> Column:
    """not_expired, locked or moved, in this order. No expiry, the empty text and the word null never expire."""
    expired = F.coalesce(iso("expires_at") < now, F.lit(False))
    return F.when(~expired, "not_expired").when(F.coalesce("expiry_locked", F.lit(False)), "locked").otherwise("moved")


def m7_expiry(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(AS_OF).cast("timestamp")
    m = memos(spark, d, "expires_at", "expiry_locked", text.estimated_tokens(F.col("body")).alias("tokens"))
    return m.groupBy("source", expiry_state(m, now).alias("state")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def a21_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Memos by kind and age of the last change, whole days rounded down."""
    days = moments.whole_days(F.col("modified_at"), F.lit(AS_OF).cast("timestamp"))
    bucket = F.when(days < 30, "<30d").when(days < 90, "30-90d").when(days < 180, "90-180d").otherwise(">180d")
    soon = F.coalesce(iso("expires_at").between(F.lit(AS_OF).cast("timestamp"), F.lit(AS_OF).cast("timestamp") + F.expr("interval 14 days")), F.lit(False))
    m = memos(spark, d, "kind", "expires_at", text.estimated_tokens(F.col("body")).alias("tokens"))
    return m.groupBy("kind", bucket.alias("age")).agg(F.count("*").alias("n"), F.count_if(soon).alias("expiring"), F.sum("tokens").alias("tokens"))


def j12_keep_days(spark: SparkSession, d: str) -> DataFrame:
    """Memos per kind with the days they are kept: a listed null is for ever, an unlisted kind has the default."""
    listed = spark.createDataFrame(list(KEEP_DAYS.items()), "kind string, days int").withColumn("listed", F.lit(True))
    m = memos(spark, d, "kind").groupBy("kind").agg(F.count("*").alias("n"))
    return m.join(F.broadcast(listed), "kind", "left").select("kind", "n", F.when(F.col("listed"), F.col("days")).otherwise(F.lit(DEFAULT_DAYS)).alias("days"))


def a22_tag_index(spark: SparkSession, d: str) -> DataFrame:
    """Tags that occur in memos of two kinds of source or more, with their numbers of memos."""
    t = memos(spark, d, "tags").select("id", "source", F.explode("tags").alias("tag")).select(F.lower(F.trim("tag")).alias("tag"), "id", "source")
    return t.groupBy("tag").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("id").alias("n_memos"), F.min("id").alias("first_id")).filter("n_sources >= 2")


def a23_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised words with the number of documents that use them, three at least."""
    runs = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_\-]+"), F.lit(0))
    words = F.array_distinct(F.filter(runs, lambda w: w.rlike(r"^[A-Z][A-Za-z0-9][A-Za-z0-9\-]{1,30}$")))
    t = table(spark, d, "documents").select("doc_id", F.explode(words).alias("phrase"))
    return t.groupBy("phrase").agg(F.count("*").alias("n_documents")).filter("n_documents >= 3")


def w3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Per event the memo of the most trusted source, then the earliest created_at, then the smallest id; memos without a valid created_at come last."""
    trust = table(spark, d, "source_authority").select(kind_key("source_kind").alias("source"), "authority")
    m = memos(spark, d, "event_id", "created_at").withColumn("event", F.nullif(kind_key("event_id"), F.lit(""))).filter("event is not null").join(F.broadcast(trust), "source", "left")
    key = F.struct(F.coalesce("authority", F.lit(DEFAULT_AUTHORITY)).alias("a"), F.coalesce(F.unix_micros(iso("created_at")), F.lit(2**62)).alias("t"), "id")
    return m.groupBy("event").agg(F.min(key).alias("best"), F.count("*").alias("n_members")).select("event", F.col("best.id").alias("canonical_id"), "n_members")


def j11_authority(spark: SparkSession, d: str) -> DataFrame:
    trust = table(spark, d, "source_authority").select(kind_key("source_kind").alias("source"), "authority")
    n = memos(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(trust), "source", "left").select("source", "n", F.coalesce("authority", F.lit(DEFAULT_AUTHORITY)).alias("authority"))


def v_memo_violations(spark: SparkSession, d: str) -> DataFrame:
    """Memos by violated rule: missing required fields, canonical but superseded, superseded by nothing that exists, two canonicals of an event."""
    m = memos(spark, d, "source_uri", "kind", "created_at", "tags", "is_canonical_for_event", "superseded_by", "event_id")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = F.filter(
        F.array(
            F.when(blank("source_uri"), "source_uri_missing"), F.when(blank("kind"), "kind_missing"), F.when(blank("created_at"), "created_at_missing"), F.when(F.col("tags").isNull(), "tags_missing"),
            F.when(F.coalesce("is_canonical_for_event", F.lit(False)) & F.col("superseded_by").isNotNull(), "canonical_superseded"),
        ),
        lambda x: x.isNotNull(),
    )
    own = m.select("id", F.explode(rules).alias("rule"))
    dangling = m.filter("superseded_by is not null").join(m.select(F.col("id").alias("superseded_by")), "superseded_by", "left_anti").select("id", F.lit("superseded_dangling").alias("rule"))
    canon = m.filter("is_canonical_for_event and event_id is not null").select("id", kind_key("event_id").alias("event"))
    many = canon.groupBy("event").agg(F.count("*").alias("n")).filter("n > 1")
    double = canon.join(many, "event", "left_semi").select("id", F.lit("canonical_twice").alias("rule"))
    return own.unionByName(dangling).unionByName(double)


def a31_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memos").groupBy("id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def retrieve(corpus: DataFrame, question: Column, now: Column, most: int = 12) -> DataFrame:
    """The `most` rows of corpus (id, haystack, at, canonical) for a question: 1 + words of it they contain, faded by age.

    Words of four characters or more count once. Rows with is-canonical false count 0.85. Ties: later time, then smaller id.
    The plan keeps the best rows of each partition only.
    """
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0)), lambda w: F.length(w) >= 4))
    hits = F.aggregate(words, F.lit(0), lambda n, w: n + F.contains(F.lower("haystack"), w).cast("int"))
    c = corpus.withColumn("relevance", hits)
    score = (1 + F.col("relevance")) * moments.recency(F.col("at"), now) * F.when(~F.coalesce("canonical", F.lit(True)), 0.85).otherwise(1.0)
    return c.withColumn("score", score).select("id", "relevance", "score", "at").orderBy(F.desc("score"), F.desc("at"), "id").limit(most)


def t1_retrieval(spark: SparkSession, d: str) -> DataFrame:
    m = memos(spark, d, F.concat_ws(" ", "title", "summary", F.array_join("tags", " "), "body").alias("haystack"), "is_canonical_for_event")
    m = m.select("id", "haystack", F.col("modified_at").alias("at"), F.col("is_canonical_for_event").alias("canonical"))
    best = retrieve(m, F.lit("what was decided about the checkpoint and the rollback of the deployment"), F.lit(AS_OF).cast("timestamp"))
    return best.select("id", "relevance", F.round("score", 6).alias("score"))


def a13_memo_age(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the age in days by where the time comes from: created_at, else the last change."""
    m = memos(spark, d, "created_at")
    made = utc_micros(F.col("created_at"))
    at = F.coalesce(made, F.unix_micros("modified_at"))
    age = F.round((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - at) / 8.64e10, 2)
    ages = m.select(F.when(made.isNotNull(), "created_at").otherwise("modified_at").alias("age_source"), age.alias("age"))
    return exact_percentiles(ages, "age", {"p50": 0.5, "p95": 0.95}, ["age_source"])


def v_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Per kind, memos whose summary, ten characters at least, stands in their body but for case and blanks."""
    s, b = text.folded(F.col("summary")), text.folded(F.col("body"))
    ok = (F.length(s) >= 10) & F.contains(b, s)
    m = memos(spark, d, "kind", F.coalesce(ok, F.lit(False)).alias("grounded"))
    return m.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("grounded").alias("n_grounded"))


def w9_budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """Memos per source in order of time while their running tokens stay within 20,000; the first one always, cut to the budget."""
    tokens = F.greatest(F.lit(1), text.estimated_tokens(F.col("body")))
    m = memos(spark, d, tokens.alias("tokens")).select("source", "id", F.unix_micros("modified_at").alias("at"), "tokens")
    packed = running_total(m, "source", ["at", "id"], "tokens")
    return packed.filter((F.col("running") <= 20000) | (F.col("running") == F.col("tokens"))).select("source", "id", F.least("tokens", F.lit(20000)).alias("tokens"), F.least("running", F.lit(20000)).alias("running"))


def running_total(df: DataFrame, group: str, order: list[str], amount: str, block: int = 86_400_000_000 * 30) -> DataFrame:
    """df with `running`: the sum of amount up to each row, per group in the given order, whose first column is a BIGINT.

    The order is cut into blocks of `block` units. Totals per block are summed over blocks, rows only within
    their block, so that a group with a third of all rows is spread over its blocks.
    """
    b = df.withColumn("__b", F.floor(F.col(order[0]) / F.lit(block)).cast("bigint"))
    totals = b.groupBy(group, "__b").agg(F.sum(amount).alias("__t"))
    w = Window.partitionBy(group).orderBy("__b")
    before = totals.select(F.col(group).alias("__g"), F.col("__b").alias("__k"), F.coalesce(F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = Window.partitionBy(group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = b.withColumn("__own", F.sum(amount).over(own)).join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__k")))
    return j.withColumn("running", F.col("__own") + F.col("__before")).drop("__b", "__g", "__k", "__own", "__before")


def a12_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").groupBy(F.split("path", "/")[1].alias("folder"), "extension").agg(F.count("*").alias("n"), F.countDistinct("raw_id").alias("n_items"))


def a34_over_budget(spark: SparkSession, d: str) -> DataFrame:
    m = memos(spark, d, text.estimated_tokens(F.col("body")).alias("t"))
    return m.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("t") > 200).alias("over_budget"), F.max("t").alias("largest"))


def a27_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Share of canonical memos among flagged ones: overall, per kind, per provenance; suppressed below 5, marked below 10."""
    m = memos(spark, d, "is_canonical_for_event", "kind", "provenance").filter("is_canonical_for_event is not null")
    g = m.groupingSets([[], ["kind"], ["provenance"]], "kind", "provenance").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(F.col("is_canonical_for_event").cast("int")).alias("share"))
    rate = F.when(F.col("n") >= 5, F.round("share", 4))
    return g.select(F.col("level").cast("int").alias("level"), "kind", "provenance", "n", rate.alias("rate"), (F.col("n") < 10).alias("few"))


QUERIES = {f.__name__: f for f in (m7_expiry, a21_inventory, j12_keep_days, a22_tag_index, a23_phrases, w3_canonical, j11_authority, v_memo_violations, a31_repeated_ids, t1_retrieval, a13_memo_age, v_grounded, w9_budget_pack, a12_by_source, a34_over_budget, a27_agreement)}

_M = """with m as (select *, lower(trim(source_kind, ' ')) as source from (select *, row_number() over (partition by id order by modified_at desc) as rn from memos) where rn = 1)"""
_EXP = "case when regexp_full_match(trim(expires_at), '\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}([.]\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?') then try_cast(trim(expires_at) as timestamptz) end"
_NOW = f"timestamptz '{AS_OF}+00'"
_TOK = "(length(coalesce(body, '')) // 4)"
_KEEP = ", ".join(f"('{k}', {'null' if v is None else v})" for k, v in KEEP_DAYS.items())
_WORDS = "['what', 'decided', 'about', 'checkpoint', 'rollback', 'deployment']"
ORACLES = {
    "a13_memo_age": _M + ", x as (select *, created_at as t, null::varchar as zone from m), " + instants_sql() + f""", a as (select case when us is not null then 'created_at' else 'modified_at' end as age_source, round((epoch_us({_NOW}) - coalesce(us, epoch_us(modified_at))) / 8.64e10, 2) as age from inst)
 select age_source, count(age) as n, quantile_cont(age, 0.5) as p50, quantile_cont(age, 0.95) as p95 from a where age is not null group by 1""",
    "m7_expiry": _M + f""" select source, case when not coalesce({_EXP} < {_NOW}, false) then 'not_expired' when coalesce(expiry_locked, false) then 'locked' else 'moved' end as state, count(*) as n, sum({_TOK})::bigint as tokens from m group by 1, 2""",
    "a21_inventory": _M + f""", a as (select *, floor((epoch_us({_NOW}) - epoch_us(modified_at)) / 8.64e10) as days from m)
 select kind, case when days < 30 then '<30d' when days < 90 then '30-90d' when days < 180 then '90-180d' else '>180d' end as age, count(*) as n,
 count(*) filter (coalesce({_EXP} between {_NOW} and {_NOW} + interval 14 days, false)) as expiring, sum({_TOK})::bigint as tokens from a group by 1, 2""",
    "j12_keep_days": _M + f""", k(kind, days) as (values {_KEEP}) select m.kind, count(*) as n, (case when any_value(k.kind) is not null then any_value(k.days) else {DEFAULT_DAYS} end)::int as days from m left join k on k.kind = m.kind group by m.kind""",
    "a22_tag_index": _M + """, t as (select lower(trim(tag, ' ')) as tag, id, source from (select id, source, unnest(tags) as tag from m))
 select tag, count(distinct source) as n_sources, count(distinct id) as n_memos, min(id) as first_id from t group by 1 having count(distinct source) >= 2""",
    "a23_phrases": r"""select phrase, count(*) as n_documents from (select doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_\-]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z0-9][A-Za-z0-9\-]{1,30}')))) as phrase from documents) group by 1 having count(*) >= 3""",
    "w3_canonical": _M + f""", e as (select m.*, nullif(lower(trim(event_id, ' ')), '') as event, coalesce(a.authority, 5) as rank from m left join source_authority a on lower(trim(a.source_kind, ' ')) = m.source)
 select event, id as canonical_id, n_members from (select *, row_number() over (partition by event order by rank, {_EXP.replace("expires_at", "created_at")} nulls last, id) as k, count(*) over (partition by event) as n_members from e where event is not null) where k = 1""",
    "j11_authority": _M + " select m.source, count(*) as n, any_value(coalesce(a.authority, 5))::int as authority from m left join source_authority a on lower(trim(a.source_kind, ' ')) = m.source group by 1",
    "v_memo_violations": _M + """ select id, 'source_uri_missing' as rule from m where coalesce(trim(source_uri), '') = '' union all select id, 'kind_missing' from m where coalesce(trim(kind), '') = ''
 union all select id, 'created_at_missing' from m where coalesce(trim(created_at, ' '), '') = '' union all select id, 'tags_missing' from m where tags is null
 union all select id, 'canonical_superseded' from m where is_canonical_for_event and superseded_by is not null
 union all select id, 'superseded_dangling' from m where superseded_by is not null and superseded_by not in (select id from m where id is not null)
 union all select id, 'canonical_twice' from m where is_canonical_for_event and event_id is not null and lower(trim(event_id, ' ')) in (select lower(trim(event_id, ' ')) from m where is_canonical_for_event and event_id is not null group by 1 having count(*) > 1)""",
    "a31_repeated_ids": "select id, count(*) as n_rows from memos group by 1 having count(*) > 1",
    "t1_retrieval": _M + f""", h as (select id, modified_at, is_canonical_for_event as canonical, lower(concat_ws(' ', title, summary, array_to_string(tags, ' '), body)) as hay from m),
 s as (select id, modified_at, len(list_filter({_WORDS}, lambda w: contains(hay, w)))::int as relevance, canonical from h),
 r as (select *, (1 + relevance) * exp(-greatest(0.0, (epoch_us({_NOW}) - epoch_us(modified_at)) / 8.64e10) * 0.6931471805599453 / 90.0) * (case when not coalesce(canonical, true) then 0.85 else 1.0 end) as score from s)
 select id, relevance, round(score, 6) as score from r order by r.score desc, modified_at desc, id limit 12""",
    "v_grounded": _M + r""", f as (select kind, trim(regexp_replace(lower(summary), '\s+', ' ', 'g')) as s, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) as b from m)
 select kind, count(*) as n, count(*) filter (length(s) >= 10 and contains(b, s)) as n_grounded from f group by 1""",
    "w9_budget_pack": _M + f""", t as (select source, id, modified_at, greatest(1, {_TOK})::bigint as tokens from m), r as (select *, sum(tokens) over (partition by source order by modified_at, id rows unbounded preceding)::bigint as running from t)
 select source, id, least(tokens, 20000) as tokens, least(running, 20000) as running from r where running <= 20000 or running = tokens""",
    "a12_by_source": "select split_part(path, '/', 2) as folder, extension, count(*) as n, count(distinct raw_id) as n_items from raw_items group by 1, 2",
    "a34_over_budget": _M + f" select source, count(*) as n, count(*) filter ({_TOK} > 200) as over_budget, max({_TOK})::bigint as largest from m group by 1",
    "a27_agreement": _M + """ select grouping(kind, provenance)::int as level, kind, provenance, count(*) as n, case when count(*) >= 5 then round(avg(is_canonical_for_event::int), 4) end as rate, count(*) < 10 as few
 from m where is_canonical_for_event is not null group by grouping sets ((), (kind), (provenance))""",
}
