"""Problem 2: one surviving record per group of memos that describe one event.

Members of an event are ranked by the given trust in their source, then by time, then by id; per field the
first member with a value survives. Where a field may hold many values (tags), a latent two-sided quality
model judges each value: every source has a sensitivity (it states values that are true) and a specificity
(it does not state values that are false), both inferred by expectation-maximisation, and every value whose
posterior is high enough is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.session import discard, materialise

# Texts that only stand for "no value", compared in lower case without surrounding blanks.
NO_VALUE = ["", "null", "none", "n/a", "na", "-", "--", "...", "???", "??", "?", "tbd", "untitled", "(no title)", "unknown", "nan", "nil"]
FIELDS = ["title", "summary", "tags", "body"]


def has_value(c: Column) -> Column:
    """Whether a text holds a value; null, blank and placeholder texts don't."""
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    return ~t.isin(NO_VALUE)


def real_tags(c: Column) -> Column:
    """The tags that hold a value; null for none."""
    return F.nullif(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: has_value(t)), F.array().cast("array<string>"))


def resolve_events(memos: DataFrame) -> DataFrame:
    """memos with `event`: their own event_id, else that of the memo superseded_by leads to; null where it leads nowhere.

    Pointers are doubled each round, so a chain of n steps takes log2 n rounds; chains that end in a missing memo,
    at a memo without event or in a circle are left without event.
    """
    own = F.lower(F.regexp_replace("event_id", r"^\s+|\s+$", ""))
    m = memos.withColumn("event", F.when(has_value(F.col("event_id")), own))
    ends = m.select("id", "event", F.when(F.col("event").isNull() & has_value(F.col("superseded_by")), F.trim("superseded_by")).alias("to"))
    ends = materialise(ends, "p2-ends")
    open_ = ends.filter("event is null and to is not null").select("id", "to")
    done = None
    for _ in range(64):
        hop = open_.join(ends.select(F.col("id").alias("to"), "event", F.col("to").alias("next")), "to", "left")
        hop = materialise(hop.select("id", "event", F.col("next").alias("to")), "p2-hop")
        found = hop.filter("event is not null").select("id", "event")
        done = found if done is None else done.unionByName(found)
        open_ = hop.filter("event is null and to is not null and to <> id").select("id", "to")
        if not open_.limit(1).count():
            break
        # the open pointers now reach twice as far: those that follow them jump as far in one step
        moved = hop.select("id", F.col("event").alias("e2"), F.col("to").alias("t2"), F.lit(True).alias("was"))
        ends = materialise(ends.join(moved, "id", "left").select("id", F.when(F.col("was"), F.col("e2")).otherwise(F.col("event")).alias("event"), F.when(F.col("was"), F.col("t2")).otherwise(F.col("to")).alias("to")), "p2-ends")
    return m.join(done.select("id", F.col("event").alias("via")), "id", "left").withColumn("event", F.coalesce("event", "via")).drop("via")


def rank_key(authority: Column, micros: Column, id_: Column) -> Column:
    """Ascending order of trust: authority (null last), latest time (null last), smallest id."""
    return F.struct(F.coalesce(authority.cast("long"), F.lit(2**62)).alias("a"), F.coalesce(-micros, F.lit(2**62)).alias("t"), id_.alias("id"))


def survivors(members: DataFrame, least: int = 2) -> DataFrame:
    """(event, field, memo_id): of events with `least` members or more, the member whose value survives per field, and `id`.

    members: (event, id, authority, micros, title, summary, tags, body), one row per id; rows without event belong to none.
    Each field is one min over rank keys, combined before the shuffle, so that an event with a third of all rows is
    an aggregation like any other. A field without any value gives no row. Empty tables give none.
    """
    key = rank_key(F.col("authority"), F.col("micros"), F.col("id"))
    there = {"title": has_value(F.col("title")), "summary": has_value(F.col("summary")), "tags": real_tags(F.col("tags")).isNotNull(), "body": has_value(F.col("body"))}
    best = members.filter("event is not null").groupBy("event").agg(F.count("*").alias("n"), F.min(key).alias("id"), *[F.min(F.when(there[f], key)).alias(f) for f in FIELDS])
    best = best.filter(F.col("n") >= least)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.id").alias("memo_id")) for f in ["id", *FIELDS]])
    return best.select("event", F.explode(pairs).alias("x")).select("event", "x.field", "x.memo_id").filter("memo_id is not null")


def judge_claims(claims: DataFrame, covers: DataFrame, prior: float = 0.5, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(values: event, value, posterior, n_sources) and (quality: source, sensitivity, specificity) of claims (event, source, value).

    covers: (event, source) of the sources that could have stated a value. Of each value stated in an event a covering source either
    states it or doesn't. E-step: the posterior of a value from its sources' qualities; M-step: the qualities from the
    posteriors, smoothed by one pseudo-observation each way. Statements of one source in one event count once.
    """
    stated = claims.select("event", "source", "value").distinct()
    obs = stated.select("event", "value").distinct().join(covers.distinct(), "event").join(stated.withColumn("said", F.lit(1)), ["event", "value", "source"], "left").fillna(0, ["said"])
    obs = materialise(obs, "p2-observations")
    quality = obs.groupBy("source").agg(F.lit(0.6).alias("sensitivity"), F.lit(0.8).alias("specificity"))
    values = None
    for _ in range(rounds):
        o = obs.join(quality, "source")
        yes = F.when(F.col("said") == 1, F.ln("sensitivity")).otherwise(F.ln(1 - F.col("sensitivity")))
        no = F.when(F.col("said") == 1, F.ln(1 - F.col("specificity"))).otherwise(F.ln("specificity"))
        logit = F.sum(yes - no) + math.log(prior / (1 - prior))
        old = values
        values = o.groupBy("event", "value").agg((1 / (1 + F.exp(-logit))).alias("posterior"), F.sum("said").alias("n_sources"))
        values = materialise(values, "p2-values")
        j = obs.join(values.select("event", "value", "posterior"), ["event", "value"])
        p, q, said = F.col("posterior"), 1 - F.col("posterior"), F.col("said")
        before = quality
        quality = j.groupBy("source").agg(((F.sum(p * said) + 1) / (F.sum(p) + 2)).alias("sensitivity"), ((F.sum(q * (1 - said)) + 1) / (F.sum(q) + 2)).alias("specificity"))
        quality = materialise(quality, "p2-quality")
        if old is not None:
            discard(old)
            discard(before)
    return values, quality


def judge_values(members: DataFrame, prior: float = 0.5, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """judge_claims of the multi-valued tags: a source covers an event if it has a member there."""
    m = members.filter("event is not null").select("event", "source", real_tags(F.col("tags")).alias("tags"))
    claims = m.select("event", "source", F.explode("tags").alias("tag")).select("event", "source", F.lower(F.trim("tag")).alias("value"))
    return judge_claims(claims, m.select("event", "source"), prior, rounds)


def agreement(members: DataFrame, least: int = 2) -> DataFrame:
    """(field, n, n_agree, n_open): how often the value that survives by trust is one that the quality model finds at least as likely as any other.

    Every field's values are claims of their sources, single-valued ones by the digest of their text; n counts the (event, field) pairs in
    which anything survives, n_open those where sources state different values, so that there was a choice.
    """
    m = materialise(members.filter("event is not null").select("event", "id", "source", "authority", "micros", "title", "summary", "tags", "body"), "p2-members")
    tags = F.array_join(F.array_sort(F.transform(real_tags(F.col("tags")), lambda t: F.lower(F.trim(t)))), "|")
    cells = {f: F.when(has_value(F.col(f)), F.col(f)) for f in ("title", "summary", "body")} | {"tags": tags}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.xxhash64(c).alias("value"), c.isNotNull().alias("there")) for f, c in cells.items()])).alias("x")
    stated = m.select("event", "id", "source", each).select("event", "id", "source", "x.*").filter("there")
    stated = materialise(stated.select(F.struct("event", "field").alias("event"), "id", "source", "value"), "p2-claims")
    values, _ = judge_claims(stated, stated.select("event", "source"))
    best = values.groupBy("event").agg(F.max("posterior").alias("most"), F.count("*").alias("n_values"))
    kept = survivors(m, least).filter("field <> 'id'").select(F.struct("event", "field").alias("event"), F.col("memo_id").alias("id"))
    chosen = kept.join(stated.select("event", "id", "value"), ["event", "id"]).join(values.select("event", "value", "posterior"), ["event", "value"]).join(best, "event")
    return chosen.groupBy(F.col("event.field").alias("field")).agg(F.count("*").alias("n"), F.count_if(F.col("posterior") >= F.col("most") - 1e-9).alias("n_agree"), F.count_if(F.col("n_values") > 1).alias("n_open"))


def golden_records(members: DataFrame, least: int = 2, keep: float = 0.5) -> DataFrame:
    """One record per event: the surviving single values, and all tags judged true (posterior >= keep); if none is, the surviving memo's tags."""
    s = materialise(survivors(members, least), "p2-survivors")
    values, _ = judge_values(members.join(s.select("event").distinct(), "event", "left_semi"))
    tags = values.filter(F.col("posterior") >= keep).groupBy("event").agg(F.array_sort(F.collect_set("value")).alias("judged"))
    cells = s.join(members.select(F.col("id").alias("memo_id"), "title", "summary", "tags", "body"), "memo_id")
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col(f))).alias(f)
    rec = cells.groupBy("event").agg(F.max(F.when(F.col("field") == "id", F.col("memo_id"))).alias("memo_id"), pick("title"), pick("summary"), pick("tags"), pick("body"))
    return rec.join(tags, "event", "left").withColumn("tags", F.coalesce("judged", "tags")).drop("judged")
