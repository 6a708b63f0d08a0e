"""Document and thread operators: words, sections, headings, threads, harvest keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text
from quillspark.functions.markup import normalised
from quillspark.sources.tables import kind_key, latest_rows, table


# Words of two letters that tell a scope.
SHORT_WORDS = ["hr", "ip", "qa", "ml", "ai", "ux"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("source", kind_key("source"))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_no, line_no, title, n_lines) of the level-2 sections of Markdown texts; headings inside code fences are none.

    Lines count from 1; what stands before the first heading is section 0 without title. A fence ends at the next one of its own kind,
    or with the text. The lines that matter are folded inside the row: nothing is shuffled. Null texts give no row.
    """
    lines = F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")
    fence = lambda x: F.regexp_extract(x, r"^\s*(```|~~~)", 1)
    marks = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), fence(x).alias("fence"), F.when(x.startswith("## "), F.trim(F.substr(x, F.lit(4)))).alias("title"))), lambda m: (m["fence"] != "") | m["title"].isNotNull())
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<at:int,title:string>>").alias("heads"))

    def step(s, m):
        is_fence = m["fence"] != ""
        open_ = F.when(~is_fence, s["open"]).when(s["open"] == "", m["fence"]).when(s["open"] == m["fence"], F.lit("")).otherwise(s["open"])
        heads = F.when(~is_fence & (s["open"] == ""), F.concat(s["heads"], F.array(F.struct(m["at"].alias("at"), m["title"].alias("title"))))).otherwise(s["heads"])
        return F.struct(open_.alias("open"), heads.alias("heads"))

    first = F.array(F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("title")))
    d = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.size(lines).alias("__n"), F.concat(first, F.aggregate(marks, start, step, lambda s: s["heads"])).alias("__heads"))
    d = d.select("id", "__n", "__heads", F.posexplode("__heads").alias("section_no", "__h"))
    end = F.coalesce(F.get("__heads", F.col("section_no") + 1)["at"], F.col("__n") + 1)
    out = d.select("id", F.col("section_no").cast("bigint").alias("section_no"), F.col("__h.at").cast("bigint").alias("line_no"), F.col("__h.title").alias("title"), (end - F.col("__h.at")).cast("bigint").alias("n_lines"))
    return out.filter("n_lines > 0")


def f1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and total of each word over all documents: each row marks the first of a word's uses, so one shuffle of sums will do."""
    t = documents(spark, d).select(F.array_sort(text.terms(F.col("text"))).alias("t"))
    marked = t.select(F.explode(F.transform("t", lambda x, i: F.struct(x.alias("term"), (~x.eqNullSafe(F.get("t", i - 1))).cast("int").alias("first")))).alias("x")).select("x.*")
    return marked.groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("total")).filter("df >= 2")


def f5_keywords(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.array_join(text.topic_keywords(F.col("text")), " ").alias("keywords"))


def f3_slugs(spark: SparkSession, d: str) -> DataFrame:
    m = latest_rows(table(spark, d, "memos").select("id", "title", "modified_at"), "id", "modified_at")
    return m.select("id", text.slug(F.col("title")).alias("slug"), normalised(F.coalesce("title", F.lit(""))).alias("plain"))


def f4_token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(text.estimated_tokens(F.col("text"))).alias("tokens"), F.count_if(F.coalesce(F.col("n_chars") != F.length("text"), F.lit(True))).alias("n_wrong_chars"))


def f36_exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row per text that several documents have: its digest, their number and the smallest id."""
    g = documents(spark, d).filter("text is not null").groupBy(text.digest(F.col("text"), 64).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return g.filter("n > 1").select(F.substring("h", 1, 16).alias("digest"), "n", "first_id")


def s23_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections(documents(spark, d), "doc_id", "text").filter("section_no > 0").withColumnRenamed("id", "doc_id")


def s24_headings(spark: SparkSession, d: str) -> DataFrame:
    """Distinct headings, plain, with the number of documents that have them."""
    s = sections(documents(spark, d), "doc_id", "text").filter("section_no > 0").select("id", normalised(F.col("title")).alias("heading"))
    return s.filter("heading <> ''").groupBy("heading").agg(F.countDistinct("id").alias("n_documents"))


def s25_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge-base entries with a scope: title and the bullets Date, Status and Scope, with the digest of the entry; entries whose title holds a placeholder in angle brackets are left out."""
    e = documents(spark, d).filter("source = 'kb_section'")
    field = lambda k: F.nullif(F.regexp_extract("text", rf"\n- \*\*{k}:\*\* ([^\n]*)", 1), F.lit("")).alias(k.lower())
    e = e.select("doc_id", F.nullif(F.regexp_extract("text", r"\A## ([^\n]*)", 1), F.lit("")).alias("title"), field("Date"), field("Status"), field("Scope"), text.digest(F.rtrim("text")).alias("entry_hash"))
    return e.filter("scope is not null").filter(~F.coalesce(F.col("title").rlike(r"<[^>]+>"), F.lit(False)))


def scope_mentions(memos: DataFrame, scopes: DataFrame) -> DataFrame:
    """(id, scope): memos (id, tags, said) that a scope concerns: a tag shares a word with it, or their text holds one of its words that
    has four letters or is one of SHORT_WORDS. An equi-join on words; scopes (scope) are normalised texts."""
    s = scopes.select("scope").distinct().select("scope", F.explode(F.array_distinct(F.split("scope", " "))).alias("word")).filter("word <> ''")
    tag_words = F.flatten(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.split(t, " ")))
    m = memos.select("id", F.explode(F.array_distinct(F.concat(F.transform(tag_words, lambda w: F.struct(w.alias("word"), F.lit(True).alias("tag"))), F.transform(F.split("said", " "), lambda w: F.struct(w.alias("word"), F.lit(False).alias("tag")))))).alias("x")).select("id", "x.*")
    told = F.col("tag") | (F.length("word") >= 4) | F.col("word").isin(SHORT_WORDS)
    return m.join(s, "word").filter(told).select("id", "scope").distinct()


def j3_scope_routing(spark: SparkSession, d: str) -> DataFrame:
    """Per scope of a decision: decisions, memos that it concerns, and the pairs these make. Counted, not expanded."""
    dec = s25_decisions(spark, d).select(normalised(F.col("scope")).alias("scope")).filter("scope <> ''").groupBy("scope").agg(F.count("*").alias("n_decisions"))
    m = table(spark, d, "memos").select("id", "tags", "modified_at", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("body", F.lit(""))).alias("said"))
    m = latest_rows(m, "id", "modified_at")
    m = m.select("id", F.array_join("tags", " ").alias("joined"), normalised(F.col("said")).alias("said"))
    m = m.select("id", "said", F.split(normalised(F.col("joined")), " ").alias("tags"))
    return dec.join(scope_mentions(m, dec).groupBy("scope").agg(F.count("*").alias("n_memos")), "scope").withColumn("n_pairs", F.col("n_decisions") * F.col("n_memos"))


def j6_unknown_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of memos that no knowledge-base heading knows: they equal none, are no word of one, and hold no word that is one."""
    m = latest_rows(table(spark, d, "memos").select("id", "tags", "modified_at"), "id", "modified_at")
    tags = m.select(F.explode("tags").alias("t")).groupBy("t").agg(F.count("*").alias("n")).select(normalised(F.col("t")).alias("tag"), "n").filter("tag <> ''").groupBy("tag").agg(F.sum("n").alias("n"))
    heads = documents(spark, d).filter("source = 'kb_section'").select(normalised(F.nullif(F.regexp_extract("text", r"\A## ([^\n]*)", 1), F.lit(""))).alias("h")).filter("h <> ''").distinct()
    by_tag = heads.select(F.explode(F.concat(F.array("h"), F.split("h", " "))).alias("tag")).distinct()
    by_word = tags.select("tag", F.explode(F.split("tag", " ")).alias("h")).join(heads, "h", "left_semi").select("tag")
    return tags.join(by_tag, "tag", "left_anti").join(by_word, "tag", "left_anti")


def a33_growth(spark: SparkSession, d: str) -> DataFrame:
    """Documents per month and source with the running number; the window is over months."""
    m = documents(spark, d).groupBy("source", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("total", F.sum("n").over(w))


def slack(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(msg_id, ingested_at, and the columns named) of the last delivery of each message."""
    return latest_rows(table(spark, d, "slack_messages").select("msg_id", "ingested_at", *columns), "msg_id", "ingested_at")


def s2_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads: messages, people, and the time that the thread's key names, in microseconds."""
    s = slack(spark, d, "channel", "thread_ts", "user_id", F.col("text").isNull().alias("empty"))
    g = s.groupBy("channel", "thread_ts").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_people"), F.count_if("empty").alias("n_empty"))
    parts = F.split("thread_ts", r"\.")
    at = parts[0].cast("bigint") * 1_000_000 + F.rpad(F.substring(F.coalesce(F.get(parts, F.lit(1)), F.lit("0")), 1, 6), 6, "0").cast("bigint")
    return g.withColumn("thread_key", F.concat_ws(":", F.lit("slack"), "channel", "thread_ts")).withColumn("at", at)


def s3_thread_text(spark: SparkSession, d: str, block: int = 1000) -> DataFrame:
    """Each thread's messages in the order of their ids as a chain of digests: per block of `block` ids the digest of its lines, over them the
    digest of the digests. A thread of any length is never one list of texts."""
    m = slack(spark, d, "channel", "thread_ts", "user_id", "text").filter("text is not null")
    m = m.select("channel", "thread_ts", "msg_id", F.floor(F.col("msg_id") / block).alias("b"), F.sha2(F.concat(F.coalesce("user_id", F.lit("bot")), F.lit(": "), "text"), 256).alias("line"))
    join = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]]), "\n"), 256)
    blocks = m.groupBy("channel", "thread_ts", "b").agg(join(["msg_id", "line"]).alias("h"), F.count("*").alias("n"))
    return blocks.groupBy("channel", "thread_ts").agg(join(["b", "h"]).alias("text_hash"), F.sum("n").alias("n"))


def w_channel_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The three most active people of each channel: counted first, ranked after."""
    n = slack(spark, d, "channel", "user_id").filter("user_id is not null").groupBy("channel", "user_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("channel").orderBy(F.desc("n"), "user_id")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


def j_people(spark: SparkSession, d: str) -> DataFrame:
    """Messages per team; people who aren't listed count as unknown."""
    p = table(spark, d, "people").select("user_id", "team")
    n = slack(spark, d, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(p), "user_id", "left").groupBy(F.coalesce("team", F.lit("unknown")).alias("team")).agg(F.sum("n").alias("n"))


def item_key() -> Column:
    """The dedupe key of an item reference (source_name, id, content): by thread for Slack, else by content."""
    return F.when(F.col("source_name") == "slack", F.concat(F.lit("slack:"), "id")).otherwise(F.concat_ws(":", "source_name", text.digest(F.coalesce("content", F.lit("")), 16)))


def harvest_keys(spark: SparkSession, d: str) -> DataFrame:
    """(ref_no, batch_no, source_name, key), one row per item."""
    i = table(spark, d, "harvest_items").select("ref_no", "batch_no", "source_name", item_key().alias("key"), "arrived_at")
    return latest_rows(i, "ref_no", "arrived_at").drop("arrived_at")


def j4_unseen_items(spark: SparkSession, d: str) -> DataFrame:
    """Items whose key was never accepted."""
    seen = table(spark, d, "harvest_seen").select(F.col("dedupe_key").alias("key")).distinct()
    return harvest_keys(spark, d).join(seen, "key", "left_anti").select("ref_no", "batch_no", "source_name")


def a32_harvest_summary(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "harvest_seen").select(F.col("dedupe_key").alias("key")).distinct().withColumn("seen", F.lit(1))
    j = harvest_keys(spark, d).join(seen, "key", "left")
    return j.groupBy("batch_no", "source_name").agg(F.count("*").alias("n_items"), F.count("seen").alias("n_seen"))


def j19_archive_check(spark: SparkSession, d: str) -> DataFrame:
    """Accepted keys against the archive: in both, listed only, archived only."""
    seen = table(spark, d, "harvest_seen").select(F.col("dedupe_key").alias("key")).filter("key is not null").distinct().withColumn("listed", F.lit(True))
    raw = table(spark, d, "raw_items").select(F.col("dedupe_key").alias("key")).filter("key is not null").distinct().withColumn("archived", F.lit(True))
    j = seen.join(raw, "key", "full_outer")
    state = F.when(F.col("listed") & F.col("archived"), "both").when(F.col("listed"), "listed_only").otherwise("archived_only")
    return j.groupBy(F.split("key", ":")[0].alias("source_name"), state.alias("state")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        f1_terms, f5_keywords, f3_slugs, f4_token_estimates, f36_exact_copies, s23_sections, s24_headings, s25_decisions, j3_scope_routing, j6_unknown_tags, a33_growth,
        s2_threads, s3_thread_text, w_channel_ranks, j_people, j4_unseen_items, a32_harvest_summary, j19_archive_check,
    )
}

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_MEMOS = "with m as (select * from (select *, row_number() over (partition by id order by modified_at desc) as rn from memos) where rn = 1)"
_SLACK = "with s as (select * from (select *, row_number() over (partition by msg_id order by ingested_at desc) as rn from slack_messages) where rn = 1)"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({})), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_ENTRY = r"""e as (select doc_id, nullif(regexp_extract(text, '^## ([^\n]*)', 1), '') as title, nullif(regexp_extract(text, '\n- \*\*Date:\*\* ([^\n]*)', 1), '') as date,
 nullif(regexp_extract(text, '\n- \*\*Status:\*\* ([^\n]*)', 1), '') as status, nullif(regexp_extract(text, '\n- \*\*Scope:\*\* ([^\n]*)', 1), '') as scope, substr(sha256(rtrim(text, ' ')), 1, 8) as entry_hash
 from documents where lower(trim(source, ' ')) = 'kb_section' and regexp_extract(text, '\n- \*\*Scope:\*\* ([^\n]*)', 1) <> '' and not regexp_matches(regexp_extract(text, '^## ([^\n]*)', 1), '<[^>]+>'))"""
_SECTIONS = r"""l as (select doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) as pos from documents where text is not null),
 f as (select *, sum(regexp_matches(line, '^\s*(```|~~~)')::int) over (partition by doc_id order by pos) as fences from l),
 h as (select *, (fences % 2 = 0 and line like '## %') as head from f), n as (select *, sum(head::int) over (partition by doc_id order by pos)::bigint as section_no from h),
 sec as (select doc_id, section_no, min(pos)::bigint as line_no, max(case when head then trim(substr(line, 4), ' ') end) as title, count(*) as n_lines from n group by 1, 2 having section_no > 0)"""
_KEYS = """k as (select ref_no, batch_no, source_name, case when source_name = 'slack' then 'slack:' || id else source_name || ':' || substr(sha256(coalesce(content, '')), 1, 16) end as key
 from (select *, row_number() over (partition by ref_no order by arrived_at desc) as rn from harvest_items) where rn = 1)"""
ORACLES = {
    "f1_terms": f"""with t as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_\\-]+[\\p{{L}}\\p{{N}}_]'), lambda w: not list_contains({_STOP}, w))) as term from documents),
 p as (select term, doc_id, count(*) as tf from t group by 1, 2) select term, count(*) as df, sum(tf)::bigint as total from p group by 1 having count(*) >= 2""",
    "f3_slugs": _MEMOS + r""" select id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}_\s\-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'untitled') as slug, """ + _PLAIN.format("coalesce(title, '')") + " as plain from m",
    "f4_token_estimates": "select lower(trim(source, ' ')) as source, count(*) as n, sum(length(coalesce(text, '')) // 4)::bigint as tokens, count(*) filter (coalesce(n_chars <> length(text), true)) as n_wrong_chars from documents group by 1",
    "f36_exact_copies": "select substr(sha256(text), 1, 16) as digest, count(*) as n, min(doc_id) as first_id from documents where text is not null group by text having count(*) > 1",
    "s23_sections": f"with {_SECTIONS} select * from sec",
    "s24_headings": f"with {_SECTIONS} select " + _PLAIN.format("title") + " as heading, count(distinct doc_id) as n_documents from sec group by 1 having " + _PLAIN.format("title") + " <> ''",
    "s25_decisions": f"with {_ENTRY} select * from e",
    "j3_scope_routing": _MEMOS + f", {_ENTRY}, d as (select " + _PLAIN.format("scope") + """ as scope, count(*) as n_decisions from e group by 1), w as (select distinct scope, unnest(string_split(scope, ' ')) as word from d where scope <> ''),
 t as (select distinct id, true as tag, unnest(string_split(""" + _PLAIN.format("array_to_string(tags, ' ')") + """, ' ')) as word from m union all select distinct id, false, unnest(string_split(""" + _PLAIN.format("concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(body, ''))") + """, ' ')) from m),
 p as (select distinct id, scope from t join w on w.word = t.word where w.word <> '' and (tag or length(w.word) >= 4 or w.word in ('hr', 'ip', 'qa', 'ml', 'ai', 'ux')))
 select p.scope, any_value(n_decisions) as n_decisions, count(*) as n_memos, any_value(n_decisions) * count(*) as n_pairs from p join d on d.scope = p.scope group by 1""",
    "j6_unknown_tags": _MEMOS + ", t as (select " + _PLAIN.format("tag") + " as tag, count(*)::bigint as n from (select unnest(tags) as tag from m) group by 1), h as (select distinct " + _PLAIN.format(r"regexp_extract(text, '^## ([^\n]*)', 1)") + """ as h from documents where lower(trim(source, ' ')) = 'kb_section')
 select * from t where tag <> '' and tag not in (select h from h where h <> '') and tag not in (select unnest(string_split(h, ' ')) from h) and not exists (select 1 from h where h <> '' and list_contains(string_split(t.tag, ' '), h.h))""",
    "a33_growth": """with g as (select lower(trim(source, ' ')) as source, strftime(created_at, '%Y-%m') as month, count(*) as n from documents group by 1, 2) select *, sum(n) over (partition by source order by month rows unbounded preceding)::bigint as total from g""",
    "s2_threads": _SLACK + """ select channel, thread_ts, count(*) as n, count(distinct user_id) as n_people, count(*) filter (text is null) as n_empty, 'slack:' || channel || ':' || thread_ts as thread_key,
 split_part(thread_ts, '.', 1)::bigint * 1000000 + rpad(substr(coalesce(nullif(split_part(thread_ts, '.', 2), ''), '0'), 1, 6), 6, '0')::bigint as at from s group by 1, 2""".replace(" as at ", ' as "at" '),
    "s3_thread_text": _SLACK + """, b as (select channel, thread_ts, msg_id // 1000 as b, sha256(string_agg(sha256(coalesce(user_id, 'bot') || ': ' || text), chr(10) order by msg_id)) as h, count(*) as n from s where text is not null group by 1, 2, 3)
 select channel, thread_ts, sha256(string_agg(h, chr(10) order by b)) as text_hash, sum(n)::bigint as n from b group by 1, 2""",
    "w_channel_ranks": _SLACK + """, c as (select channel, user_id, count(*) as n from s where user_id is not null group by 1, 2), r as (select *, row_number() over (partition by channel order by n desc, user_id)::int as rank from c) select * from r where rank <= 3""",
    "j_people": _SLACK + " select coalesce(team, 'unknown') as team, count(*) as n from s left join people p on p.user_id = s.user_id group by 1",
    "j4_unseen_items": f"with {_KEYS} select ref_no, batch_no, source_name from k where key not in (select dedupe_key from harvest_seen where dedupe_key is not null)",
    "a32_harvest_summary": f"with {_KEYS} select batch_no, source_name, count(*) as n_items, count(*) filter (key in (select dedupe_key from harvest_seen)) as n_seen from k group by 1, 2",
    "j19_archive_check": """with a as (select distinct dedupe_key as key from harvest_seen where dedupe_key is not null), b as (select distinct dedupe_key as key from raw_items where dedupe_key is not null)
 select split_part(coalesce(a.key, b.key), ':', 1) as source_name, case when a.key is not null and b.key is not null then 'both' when a.key is not null then 'listed_only' else 'archived_only' end as state, count(*) as n from a full join b on a.key = b.key group by 1, 2""",
    "f5_keywords": f"""select doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 5), ' ') as keywords from (select doc_id, list_reduce(list_prepend([]::varchar[], list_transform(list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '\\S+@\\S+', ' ', 'g')), '[a-z][a-z0-9_\\-]{{3,}}'), lambda w: not list_contains({_STOP}, w)), lambda w: [w])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as list_distinct_ordered from documents)""",
}
