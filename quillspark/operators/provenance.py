"""Provenance of memory objects: front matter, inline comments, references, keys, paths and the checks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import markup, text
from quillspark.operators.memory import DEFAULT_DAYS, KEEP_DAYS, iso, memos
from quillspark.operators.texts import documents, slack
from quillspark.sources.tables import kind_key, table

# Fixed value: sections dated from this day on need provenance.
ACCEPTED = "2026-05-07"
RAW_FILE = r"^file:(?:\./)?(.*)$"


def s10_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Memory objects among the documents: the fields of their front matter and the digest of what follows it."""
    t = documents(spark, d).filter("source = 'memory_object'").select("doc_id", markup.header_fields(F.col("text")).alias("f"), F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n*", "").alias("body"))
    return t.filter("f is not null").select("doc_id", F.col("f")["id"].alias("memo_id"), F.col("f")["kind"].alias("kind"), F.col("f")["created_at"].alias("created_at"), F.size("f").cast("bigint").alias("n_fields"), text.digest(F.col("body")).alias("body_hash"))


def k4_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Each memo as a text with front matter, read back: what comes out is what went in."""
    m = memos(spark, d, "kind", "tags", "title", "body")
    t = F.concat(F.lit("---\nid: "), "id", F.lit("\nkind: "), F.coalesce("kind", F.lit("")), F.lit("\ntags:\n"), F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n---\n\n"), F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+$", ""), F.lit("\n"))
    r = m.select("id", "kind", "tags", t.alias("t"))
    return r.select("id", markup.header_fields(F.col("t"))["kind"].alias("kind"), F.coalesce(F.size(markup.header_list(F.col("t"), "tags")), F.lit(0)).cast("bigint").alias("n_tags"), F.length("t").cast("bigint").alias("n_chars"))


def produced_comment(m: DataFrame) -> Column:
    """The inline comment that a memo's fields make; a comma ends a value, as everywhere in such comments."""
    clean = F.regexp_replace(F.coalesce("title", F.lit("")), r'[,"\[\]=\n]', " ")
    return F.concat(F.lit("<!-- produced_by: session="), text.digest(F.col("id")), F.lit(', query="'), clean, F.lit('", at='), F.coalesce("created_at", F.lit("")), F.lit(", sources=[mem://"), F.col("id"), F.lit(", "), F.coalesce("source_uri", F.lit("")), F.lit("] -->"))


def v7_produced_by(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the provenance comments of memos: the query is empty, the instant none, a source not canonical."""
    m = memos(spark, d, "title", "created_at", "source_uri")
    p = m.select("id", markup.produced_by(produced_comment(m)).alias("p"))
    return p.select("id", F.explode(markup.produced_by_errors(F.col("p"))).alias("error")).groupBy("error").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def v8_sections_without_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge-base sections by how they stand to the rule: dated since ACCEPTED or undated entries need a provenance comment, older and shapeless ones don't."""
    e = documents(spark, d).filter("source = 'kb_section'")
    day = F.nullif(F.regexp_extract("text", r"\*\*(?:Date|Last verified):\*\* (\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    entry = F.col("text").rlike(r"(?m)^- \*\*[^*]+:\*\*")
    state = F.when(markup.produced_by(F.col("text")).isNotNull(), "has").when(day >= ACCEPTED, "missing").when(day.isNull() & entry, "undated_entry").otherwise("exempt")
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def v2_dangling_sources(spark: SparkSession, d: str) -> DataFrame:
    """Memos whose source_uri names a file that the archive doesn't hold, by source."""
    m = memos(spark, d, "source_uri").withColumn("path", F.nullif(F.regexp_extract("source_uri", RAW_FILE, 1), F.lit(""))).filter("path is not null")
    there = table(spark, d, "raw_items").select("path").distinct()
    return m.join(there, "path", "left_anti").groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def v9_dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """References `art://` to memos that don't exist, with or without a repeated prefix; the references are those that superseded_by makes."""
    m = memos(spark, d, "superseded_by")
    given = F.nullif(F.trim("superseded_by"), F.lit(""))
    uri = F.concat(F.lit("art://"), F.when(F.length("id") % 2 == 0, "art-").otherwise(""), given)
    refs = m.filter(given.isNotNull()).select("id", markup.bare_reference(uri).alias("to"))
    return refs.join(m.select(F.col("id").alias("to")), "to", "left_anti").select("id", "to")


def v10_flags(spark: SparkSession, d: str) -> DataFrame:
    """States of the texts in superseded_by and expires_at read as flags: absent, false, true or malformed."""
    m = memos(spark, d, "superseded_by", "expires_at")
    both = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), markup.flag_state(F.col(c)).alias("state")) for c in ("superseded_by", "expires_at")])).alias("x")).select("x.*")
    return both.groupBy("field", "state").agg(F.count("*").alias("n"))


def f37_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of memos: the pair key of body and title, the event id that the smallest member gives, and a dated slug with a hash suffix."""
    m = memos(spark, d, "title", "body", "event_id")
    event = F.nullif(kind_key("event_id"), F.lit(""))
    pair = text.digest(F.concat_ws("|", text.digest(F.coalesce("body", F.lit(""))), text.digest(F.coalesce("title", F.lit("")))))
    mine = m.select("id", event.alias("event"), pair.alias("pair_key"), F.concat_ws("-", F.date_format("modified_at", "yyyyMMdd"), F.substring(text.digest(F.col("id"), 64), 1, 4)).alias("slug"))
    first = mine.filter("event is not null").groupBy("event").agg(F.min("id").alias("least"))
    return mine.join(first, "event", "left").select("id", "pair_key", "slug", F.when(F.col("least").isNotNull(), F.concat(F.lit("evt-"), text.digest(F.col("least"), 16))).alias("event_key"))


def f50_memory_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where archived items go as memory objects, and the size of their header with provenance; `live/` falls away, so that both pipelines share places."""
    r = table(spark, d, "raw_items").select("raw_id", "path", kind_key("source_kind").alias("source"), "modified_at").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    header = F.concat(F.lit("# "), "source", F.lit(" :: "), name, F.lit("\n_source path: `"), "path", F.lit("`_\n_modified: "), F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("_\n\n"))
    return r.select("raw_id", F.regexp_replace("path", r"^raw/(?:live/)?", "memory/").alias("memory_path"), text.digest(header).alias("header_hash"))


def f28_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Per kind the memos whose stated expiry lies before, on or after the day that the kind's default gives, counted from their last change."""
    m = memos(spark, d, "kind", "expires_at")
    listed = F.create_map(*[F.lit(x) for k, v in KEEP_DAYS.items() if v is not None for x in (k, v)])
    never = F.col("kind").isin([k for k, v in KEEP_DAYS.items() if v is None])
    days = F.when(~F.coalesce(never, F.lit(False)), F.coalesce(listed[F.col("kind")], F.lit(DEFAULT_DAYS)))
    apart = F.datediff(F.to_date(iso("expires_at")), F.date_add(F.to_date("modified_at"), days))
    state = F.when(days.isNull(), "never").when(iso("expires_at").isNull(), "unstated").when(apart < 0, "before").when(apart > 0, "after").otherwise("on")
    return m.groupBy("kind", state.alias("state")).agg(F.count("*").alias("n"))


def f12_diff_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Fenced blocks of documents read as diffs: their number, their lines without a plus sign, and how many blocks are all additions."""
    b = documents(spark, d).select("doc_id", F.explode(markup.fenced_blocks(F.col("text"))).alias("b")).select("doc_id", F.regexp_replace("b", r"\n$", "").alias("b"))
    return b.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.size(markup.bad_diff_lines(F.col("b")))).cast("bigint").alias("n_bad_lines"), F.count_if(markup.added_lines(F.col("b")).isNotNull()).alias("n_additions"))


def f6_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of memos, cleaned: from their tags, and from their titles split at commas."""
    m = memos(spark, d, "tags", "title")
    join = lambda c: F.array_join(c, "|")
    return m.select("id", join(markup.clean_keywords(F.coalesce("tags", F.array().cast("array<string>")))).alias("tags"), join(markup.clean_keywords(markup.split_keywords(F.coalesce("title", F.lit(""))))).alias("words"))


def t4_top_memos(spark: SparkSession, d: str) -> DataFrame:
    """The five latest memos of each tag with the length of their body cut to 1,500 characters; ties go to the smaller id."""
    m = memos(spark, d, "tags", F.length(F.substring(F.coalesce("body", F.lit("")), 1, 1500)).alias("kept"))
    t = m.select("id", "modified_at", "kept", F.explode(F.array_distinct(F.transform("tags", lambda x: F.lower(F.trim(x))))).alias("tag")).filter("tag <> ''")
    w = Window.partitionBy("tag").orderBy(F.desc("modified_at"), "id")
    return t.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("tag", "rank", "id", F.col("kept").cast("bigint").alias("kept"))


def s17_path_scan(spark: SparkSession, d: str) -> DataFrame:
    """Archived files one level below their source, those changed since a day, by source; dot folders and examples don't count."""
    r = table(spark, d, "raw_items").select("path", "modified_at").distinct()
    ok = F.col("path").rlike(r"^raw/[^/]+/[^/]+\.[a-z]+$") & ~F.col("path").rlike(r"(^|/)(\.[^/]+|examples)/")
    return r.filter(ok).groupBy(F.split("path", "/")[1].alias("folder")).agg(F.count("*").alias("n"), F.count_if(F.col("modified_at") >= F.lit("2026-03-01").cast("timestamp")).alias("n_since"))


def t10_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty memos in an order that a seed fixes."""
    return memos(spark, d).select("id", F.sha2(F.concat(F.lit("42:"), "id"), 256).alias("h")).orderBy("h").limit(20).select("id", F.substring("h", 1, 8).alias("h"))


def u1_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Words that are never candidates: teams, handles and the words of names, each once."""
    p = table(spark, d, "people")
    words = F.concat(F.array(F.lower("team"), F.lower("handle")), F.split(F.lower("full_name"), " "))
    return p.select(F.explode(words).alias("word")).filter("word is not null and word <> ''").distinct()


def j16_resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Short names that people go by in messages, resolved: an exact handle, else a given name that one person has, else nobody."""
    p = table(spark, d, "people").select("user_id", F.lower("handle").alias("handle"), F.lower(F.split("full_name", " ")[0]).alias("given"))
    asked = p.select(F.explode(F.array("handle", "given")).alias("name")).filter("name is not null").distinct()
    exact = p.filter("handle is not null").groupBy(F.col("handle").alias("name")).agg(F.min("user_id").alias("by_handle"))
    given = p.groupBy(F.col("given").alias("name")).agg(F.count("*").alias("n"), F.min("user_id").alias("by_given"))
    j = asked.join(exact, "name", "left").join(given, "name", "left")
    who = j.select("name", F.coalesce("by_handle", F.when(F.col("n") == 1, F.col("by_given"))).alias("user_id"))
    said = slack(spark, d, "text").select("msg_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0)))).alias("name")).groupBy("name").agg(F.count("*").alias("n_messages"))
    return who.join(said, "name", "left").select("name", "user_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


QUERIES = {
    f.__name__: f
    for f in (
        s10_front_matter, k4_rendered, v7_produced_by, v8_sections_without_provenance, v2_dangling_sources, v9_dangling_references, v10_flags, f37_keys, f50_memory_paths,
        f28_expiry, f12_diff_blocks, f6_keywords, t4_top_memos, s17_path_scan, t10_shuffled, u1_excluded, j16_resolved_names,
    )
}

_M = "with m as (select *, lower(trim(source_kind, ' ')) as source from (select *, row_number() over (partition by id order by modified_at desc) as rn from memos) where rn = 1)"
_ISO = r"regexp_full_match(coalesce({}, ''), '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}:?\d{{2}})?')"
_EXP = r"case when regexp_full_match(trim(expires_at), '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?') then try_cast(trim(expires_at) as timestamptz) end"
_DAYS = "case " + " ".join(f"when kind = '{k}' then {'null' if v is None else v}" for k, v in KEEP_DAYS.items()) + f" else {DEFAULT_DAYS} end"
_CLEAN = "array_to_string(list_slice(list_filter(list_transform({}, lambda w: substr(lower(trim(w, ' ')), 1, 32)), lambda w: w <> ''), 1, 5), '|')"
_FLAG = """case when {0} is null then 'absent' when lower(regexp_replace(trim({0}, ' '), '^["'']+|["'']+$', '', 'g')) = 'true' then 'true' when lower(regexp_replace(trim({0}, ' '), '^["'']+|["'']+$', '', 'g')) = 'false' then 'false' else 'malformed' end"""
ORACLES = {
    "s10_front_matter": r"""with o as (select doc_id, text, regexp_extract(text, '(?s)^---\n(.*?)\n---', 1) as b from documents where lower(trim(source, ' ')) = 'memory_object' and regexp_matches(text, '(?s)^---\n.*?\n---'))
 select doc_id, nullif(regexp_extract(b, '(?m)^id: (.*)$', 1), '') as memo_id, nullif(regexp_extract(b, '(?m)^kind: (.*)$', 1), '') as kind, nullif(trim(regexp_extract(b, '(?m)^created_at: (.*)$', 1), '" '), '') as created_at,
 len(regexp_extract_all(b, '(?m)^[A-Za-z_][\w-]*:'))::bigint as n_fields, substr(sha256(regexp_replace(text, '(?s)^---\n.*?\n---\n*', '')), 1, 8) as body_hash from o where b <> ''""",
    "k4_rendered": _M + r""" select id, coalesce(kind, '') as kind, len(list_filter(coalesce(tags, []), lambda x: trim(x, ' ') <> ''))::bigint as n_tags,
 length('---' || chr(10) || 'id: ' || id || chr(10) || 'kind: ' || coalesce(kind, '') || chr(10) || 'tags:' || chr(10) || array_to_string(list_transform(coalesce(tags, []), lambda x: '- ' || x), chr(10)) || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(coalesce(body, ''), '\s+$', '') || chr(10))::bigint as n_chars from m""",
    "v7_produced_by": _M + r""", e as (select id, 'query' as error from m where trim(regexp_replace(coalesce(title, ''), '[,"\[\]=\n]', ' ', 'g'), ' ') = '' union all select id, 'at' from m where not """ + _ISO.format("trim(split_part(created_at, ',', 1), ' ')") + r"""
 union all select id, 'source' from m where coalesce(trim(source_uri, ' '), '') <> '' and not regexp_full_match(trim(source_uri, ' '), '(kb#\S([^\n]*\S)?|mem://[\w-]+|art://[\w-]+|https?://\S+)')) select error, count(*) as n, min(id) as first_id from e group by 1""",
    "v8_sections_without_provenance": r"""with e as (select doc_id, text, nullif(regexp_extract(text, '\*\*(?:Date|Last verified):\*\* (\d{4}-\d{2}-\d{2})', 1), '') as day from documents where lower(trim(source, ' ')) = 'kb_section')
 select case when contains(text, '<!-- produced_by:') then 'has' when day >= '2026-05-07' then 'missing' when day is null and regexp_matches(text, '(?m)^- \*\*[^*]+:\*\*') then 'undated_entry' else 'exempt' end as state, count(*) as n, min(doc_id) as first_id from e group by 1""",
    "v2_dangling_sources": _M + r""", p as (select *, nullif(regexp_extract(source_uri, '^file:(?:\./)?(.*)$', 1), '') as p from m) select source, count(*) as n, min(id) as first_id from p where p is not null and p not in (select path from raw_items where path is not null) group by 1""",
    "v9_dangling_references": _M + r""" select id, trim(superseded_by, ' ') as "to" from m where regexp_full_match(trim(superseded_by, ' '), '[\w-]+') and trim(superseded_by, ' ') not in (select id from m)""",
    "v10_flags": _M + ", f as (select 'superseded_by' as field, " + _FLAG.format("superseded_by") + " as state from m union all select 'expires_at', " + _FLAG.format("expires_at") + " from m) select field, state, count(*) as n from f group by 1, 2",
    "f37_keys": _M + r""", k as (select id, nullif(lower(trim(event_id, ' ')), '') as event, substr(sha256(substr(sha256(coalesce(body, '')), 1, 8) || '|' || substr(sha256(coalesce(title, '')), 1, 8)), 1, 8) as pair_key, strftime(modified_at, '%Y%m%d') || '-' || substr(sha256(id), 1, 4) as slug from m)
 select id, pair_key, slug, case when event is not null then 'evt-' || substr(sha256(min(id) over (partition by event)), 1, 16) end as event_key from k""",
    "f50_memory_paths": r"""select raw_id, regexp_replace(path, '^raw/(?:live/)?', 'memory/') as memory_path, substr(sha256('# ' || lower(trim(source_kind, ' ')) || ' :: ' || split_part(path, '/', -1) || chr(10) || '_source path: `' || path || '`_' || chr(10) || '_modified: ' || strftime(modified_at, '%Y-%m-%dT%H:%M:%S') || '_' || chr(10) || chr(10)), 1, 8) as header_hash
 from (select distinct raw_id, path, lower(trim(source_kind, ' ')) as source_kind, modified_at from raw_items)""",
    "f28_expiry": _M + f""", x as (select kind, {_DAYS} as days, {_EXP} as expires, modified_at from m)
 select kind, case when days is null then 'never' when expires is null then 'unstated' when expires::date < modified_at::date + days::int then 'before' when expires::date > modified_at::date + days::int then 'after' else 'on' end as state, count(*) as n from x group by 1, 2""",
    "f12_diff_blocks": r"""with b as (select doc_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?ms)^[ \t]*```[^\n]*\n(.*?)^[ \t]*```', 1)), '\n$', '') as b from documents),
 l as (select doc_id, len(list_filter(string_split(b, chr(10)), lambda x: trim(x) <> '' and not starts_with(x, '+'))) as bad from b) select doc_id, count(*) as n_blocks, sum(bad)::bigint as n_bad_lines, count(*) filter (bad = 0) as n_additions from l group by 1""",
    "f6_keywords": _M + " select id, " + _CLEAN.format("coalesce(tags, [])") + " as tags, " + _CLEAN.format("string_split(coalesce(title, ''), ',')") + " as words from m",
    "t4_top_memos": _M + """, t as (select distinct id, modified_at, length(substr(coalesce(body, ''), 1, 1500))::bigint as kept, lower(trim(tag, ' ')) as tag from (select *, unnest(tags) as tag from m)),
 r as (select tag, (row_number() over (partition by tag order by modified_at desc, id))::int as rank, id, kept from t where tag <> '') select * from r where rank <= 5""",
    "s17_path_scan": r"""select split_part(path, '/', 2) as folder, count(*) as n, count(*) filter (modified_at >= timestamptz '2026-03-01 00:00:00+00') as n_since from (select distinct path, modified_at from raw_items)
 where regexp_full_match(path, 'raw/[^/]+/[^/]+\.[a-z]+') and not regexp_matches(path, '(^|/)(\.[^/]+|examples)/') group by 1""",
    "t10_shuffled": _M + " select id, substr(sha256('42:' || id), 1, 8) as h from m order by sha256('42:' || id) limit 20",
    "u1_excluded": "with w as (select lower(team) as word from people union select lower(handle) from people union select unnest(string_split(lower(full_name), ' ')) from people) select word from w where word is not null and word <> ''",
    "j16_resolved_names": r"""with p as (select user_id, lower(handle) as handle, lower(split_part(full_name, ' ', 1)) as given from people), a as (select handle as name from p where handle is not null union select given from p where given is not null),
 s as (select msg_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_.]+'))) as name from (select *, row_number() over (partition by msg_id order by ingested_at desc) as rn from slack_messages) where rn = 1), n as (select name, count(*) as n from s group by 1)
 select a.name, coalesce((select min(user_id) from p where handle = a.name), (select case when count(*) = 1 then min(user_id) end from p where given = a.name)) as user_id, coalesce(n.n, 0) as n_messages from a left join n on n.name = a.name""",
}
