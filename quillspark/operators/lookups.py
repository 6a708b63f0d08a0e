"""Lookups, gates and listings over the pipeline's ids, paths and headings: where something is, whether it may pass, in what order it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import markup
from quillspark.operators.memory import memos
from quillspark.operators.runs import runs
from quillspark.operators.texts import documents, item_key, s25_decisions, sections
from quillspark.sources.tables import kind_key, latest_rows, table

# Confidence by rank, a word that isn't listed has 0; order of the files of a knowledge base, others come after.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
FILE_ORDER = ["people", "org", "decisions", "glossary"]
#: Places that are searched for a key, in this order.
BUCKETS = ["archive", "accepted", "arriving"]


def _heading(level: int = 2) -> Column:
    return F.nullif(F.regexp_extract("text", rf"\A{'#' * level} ([^\n]*)", 1), F.lit(""))


def meets(confidence: Column, threshold: str) -> Column:
    """Whether a confidence reaches the threshold; null and unknown words rank below all."""
    ranks = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return F.coalesce(ranks[F.lower(F.trim(confidence))], F.lit(0)) >= CONFIDENCE[threshold]


def pr9_routes(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first team, in alphabetical order, whose name stands anywhere in their text, within words too; null for none."""
    teams = sorted(r["team"] for r in table(spark, d, "people").select("team").filter("team is not null").distinct().collect())  # of a fixed table
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.get(F.filter(F.array(*[F.lit(t) for t in teams]), lambda t: F.contains(low, F.lower(t))), F.lit(0))
    return documents(spark, d).groupBy(hit.alias("team")).agg(F.count("*").alias("n"))


def pr13_confident(spark: SparkSession, d: str) -> DataFrame:
    """Memos by source and whether they may pass at medium confidence: two tags or more that decisions' scopes know are high, one medium, none low; no tags at all rank as unknown."""
    m = memos(spark, d, "tags")
    scopes = s25_decisions(spark, d).select(F.lower(F.trim("scope")).alias("tag")).distinct()
    known = m.select("id", F.explode(F.array_distinct(F.transform("tags", lambda t: F.lower(F.trim(t))))).alias("tag")).join(scopes, "tag", "left_semi").groupBy("id").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    word = F.when(F.coalesce(F.size("tags"), F.lit(0)) <= 0, F.lit(None)).when(k >= 2, "high").when(k == 1, "medium").otherwise("low")
    return m.join(known, "id", "left").groupBy("source", meets(word, "medium").alias("passes")).agg(F.count("*").alias("n"))


def pr14_strict_flags(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the two flags of memos and of their references that count as true: only true and yes do, a number or an id never."""
    m = memos(spark, d, F.col("is_canonical_for_event").cast("string").alias("canonical"), F.col("expiry_locked").cast("string").alias("locked"), "superseded_by")
    both = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), markup.strictly_true(F.col(c)).alias("state")) for c in ("canonical", "locked", "superseded_by")])).alias("x")).select("x.*")
    return both.groupBy("field").agg(F.count("*").alias("n"), F.count_if("state").alias("n_true"))


def pr23_session_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of runs that are session ids of the log (64 ASCII letters and digits at most), as given and without their prefix, and of the short form."""
    r = runs(spark, d).select("run_id", F.regexp_replace("run_id", "^run-", "").alias("bare"))
    long_form = lambda c: F.count_if(F.col(c).rlike(r"\A[A-Za-z0-9]{1,64}\z"))
    return r.agg(F.count("*").alias("n"), long_form("run_id").alias("n_as_given"), long_form("bare").alias("n_bare"), F.count_if(F.substring("bare", 1, 8).rlike(markup.SESSION)).alias("n_short"))


def pr24_applied(spark: SparkSession, d: str) -> DataFrame:
    """Memos by how many documents hold their id as a marker: none, one, or several, which a lookup must refuse."""
    marks = documents(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(mem-[0-9a-f]+)"), F.lit(1)))).alias("id"))
    n = marks.groupBy("id").agg(F.count("*").alias("n"))
    found = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "one").otherwise("several")
    return memos(spark, d).join(n, "id", "left").groupBy(found.alias("found")).agg(F.count("*").alias("n_memos"), F.min("id").alias("first_id"))


def pr25_reference_shapes(spark: SparkSession, d: str) -> DataFrame:
    """References by what is wrong with their shape: superseded_by as `art://` references, source_uri as it is."""
    m = memos(spark, d, "superseded_by", "source_uri")
    given = F.struct(F.lit("superseded_by").alias("field"), F.concat(F.lit("art://"), F.trim("superseded_by")).alias("uri")), F.struct(F.lit("source_uri").alias("field"), F.col("source_uri").alias("uri"))
    refs = m.select(F.explode(F.array(*given)).alias("x")).select("x.*")
    return refs.groupBy("field", markup.reference_error(F.col("uri")).alias("error")).agg(F.count("*").alias("n"))


def pr26_first_place(spark: SparkSession, d: str) -> DataFrame:
    """Keys by the first of BUCKETS that holds them, with the number of keys that stand in a later one too."""
    keys = [
        table(spark, d, "raw_items").select(F.col("dedupe_key").alias("key"), F.lit(0).alias("rank")),
        table(spark, d, "harvest_seen").select(F.col("dedupe_key").alias("key"), F.lit(1).alias("rank")),
        table(spark, d, "harvest_items").select(item_key().alias("key"), F.lit(2).alias("rank")),
    ]
    one = keys[0].unionByName(keys[1]).unionByName(keys[2]).filter("key is not null").groupBy("key").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    return one.groupBy(F.get(F.array(*[F.lit(b) for b in BUCKETS]), F.col("first")).alias("place")).agg(F.count("*").alias("n"), F.count_if(F.col("last") > F.col("first")).alias("n_elsewhere"))


def pr27_diff_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source with a fenced block, and with one that is marked as a diff; both predicates stop at the first match."""
    fence = lambda word: F.coalesce(F.col("text").rlike(rf"(?m)^[ \t]*(```|~~~){word}"), F.lit(False))
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(fence("")).alias("n_fenced"), F.count_if(fence("diff")).alias("n_diff"))


def s30_id_index(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stand in more than one place: rows of the memo table and memory objects among the documents, counted per tier."""
    docs = documents(spark, d).filter("source = 'memory_object'").select(markup.header_fields(F.col("text"))["id"].alias("id"), F.lit(1).alias("tier"))
    all_ = memos(spark, d).select("id", F.lit(0).alias("tier")).unionByName(docs.filter("id is not null"))
    g = all_.groupBy("id").agg(F.count_if(F.col("tier") == 0).alias("n_memos"), F.count_if(F.col("tier") == 1).alias("n_documents"))
    return g.filter(F.col("n_memos") + F.col("n_documents") > 1)


def s33_file_order(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge-base sections by the file that they belong to, in the order in which files are put together: FILE_ORDER, then by name."""
    e = documents(spark, d).filter("source = 'kb_section'")
    has = lambda k: F.col("text").rlike(rf"(?m)^- \*\*{k}:\*\*")
    file = F.when(has("Scope"), "decisions").when(has("Role") | has("Team"), "people").when(has("Last verified"), "glossary").otherwise("other")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(f) for f in FILE_ORDER]), F.col("file")), F.lit(0)), F.lit(99)).cast("bigint")
    return e.groupBy(F.coalesce(file, F.lit("other")).alias("file")).agg(F.count("*").alias("n")).select("file", "n", rank.alias("rank")).orderBy("rank", "file")


def j5_unsuppressed(spark: SparkSession, d: str) -> DataFrame:
    """Archived items per source that aren't suppressed: keys that were seen without becoming a memory object are."""
    out = table(spark, d, "harvest_seen").filter("memory_path is null and seen_at is not null and dedupe_key is not null").select("dedupe_key").distinct()
    r = table(spark, d, "raw_items").filter("dedupe_key is not null").select("raw_id", kind_key("source_kind").alias("source"), "dedupe_key").distinct()
    return r.join(out, "dedupe_key", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def s37_owner_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of three characters or more of knowledge-base headings, and whole headings; those with placeholders in angle brackets are templates and don't count."""
    h = documents(spark, d).filter("source = 'kb_section'").select(_heading().alias("h")).filter("h is not null and not h rlike '<[^>]+>'").select(markup.normalised(F.col("h")).alias("h")).filter("h <> ''")
    words = F.array_distinct(F.concat(F.array("h"), F.filter(F.split("h", " "), lambda w: F.length(w) >= 3)))
    return h.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def j7_new_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Tags of two memos or more that neither the knowledge base nor people's names, handles and teams know."""
    t = memos(spark, d, "tags").select("id", F.explode("tags").alias("t")).select("id", markup.normalised(F.col("t")).alias("word")).filter("word <> ''").distinct()
    n = t.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")
    p = table(spark, d, "people").select(F.explode(F.concat(F.array("team", "handle", "full_name"), F.split("full_name", " "))).alias("w")).select(markup.normalised(F.col("w")).alias("word")).filter("word <> ''").distinct()
    return n.join(s37_owner_words(spark, d).select("word"), "word", "left_anti").join(p, "word", "left_anti")


def s38_heading_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of document its level-2 headings, how many different ones there are, and how many no other kind has."""
    s = sections(documents(spark, d).withColumn("key", F.struct("doc_id", "source")), "key", "text").filter("section_no > 0")
    h = s.select("id.source", markup.normalised(F.col("title")).alias("h")).filter("h <> ''").groupBy("h", "source").agg(F.count("*").alias("n"))
    kinds = h.groupBy("h").agg(F.count("*").alias("k"))
    return h.join(kinds, "h").groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("n_different"), F.count_if(F.col("k") == 1).alias("n_own"))


def s39_tree(spark: SparkSession, d: str) -> DataFrame:
    """Archived paths by the folder of their kind and what their extension makes them: markdown, sidecar, other, or none."""
    p = table(spark, d, "raw_items").filter("path is not null").select("path").distinct()
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    what = F.when(F.col("path").endswith(".meta.yaml"), "sidecar").when(ext == ".md", "markdown").when(ext == "", "none").otherwise("other")
    return p.groupBy(F.regexp_extract("path", r"^raw/([^/]+)/", 1).alias("folder"), what.alias("what")).agg(F.count("*").alias("n"))


def v13_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Archived files against the memory objects of the same stem: missing, matched, or elsewhere (in the folder of another source)."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]+)?$", 1).alias("stem")
    folder = lambda c: F.regexp_extract(c, r"^[^/]+/([^/]+)/", 1)
    raw = table(spark, d, "raw_items").filter("path is not null").select("path", stem("path"), folder("path").alias("folder")).distinct()
    seen = table(spark, d, "harvest_seen").filter("memory_path is not null").select(stem("memory_path"), folder("memory_path").alias("of"), F.lit(True).alias("there")).distinct()
    j = raw.join(seen, "stem", "left").groupBy("path", "folder").agg(F.bool_or("there").alias("there"), F.bool_or(F.col("of") == F.col("folder")).alias("same"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("same"), "matched").otherwise("elsewhere")
    return j.groupBy("folder", state.alias("state")).agg(F.count("*").alias("n"))


def u6_globs(spark: SparkSession, d: str) -> DataFrame:
    """Different archived paths per pattern of a list: a star stays within a folder, two stars don't; a path counts once per pattern."""
    p = table(spark, d, "raw_items").filter("path is not null").select("path").distinct()
    globs = ["raw/*/*.md", "raw/**/2026-0?-*.md", "raw/slack_thread/*", "**/*.txt"]
    hits = F.explode(F.array_compact(F.array(*[F.when(F.col("path").rlike(markup.glob_pattern(g)), F.lit(g)) for g in globs])))
    return p.select("path", hits.alias("glob")).groupBy("glob").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def v12_upstream(spark: SparkSession, d: str) -> DataFrame:
    """Memos as pins of their source, rendered with a nested `upstream` block and read back: pins by the kind that stands there, or none."""
    m = memos(spark, d, "provenance", "source_uri")
    kind = F.when(F.col("provenance").isNotNull(), F.concat(F.lit("  kind: "), "provenance", F.lit("\n"))).otherwise("")
    t = F.concat(F.lit("---\nid: "), "id", F.lit("\nupstream:\n"), kind, F.lit('  uri: "'), F.coalesce("source_uri", F.lit("")), F.lit('"\n---\n'))
    up = m.select("id", markup.header_map(t, "upstream").alias("up"))
    return up.groupBy(F.coalesce(F.nullif(F.col("up")["kind"], F.lit("")), F.lit("missing")).alias("upstream_kind")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("up")["uri"], F.lit("")) != "").alias("n_uri"))


def v14_project_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Projects and their documents by how their slug stands: valid, exempt (begins with a dot), invalid, or missing."""
    slug = F.col("project_id")
    state = F.when(slug.isNull() | (slug == ""), "missing").when(slug.startswith("."), "exempt").when(slug.rlike(r"\A[a-z0-9]+(-[a-z0-9]+)*\z"), "valid").otherwise("invalid")
    return documents(spark, d).groupBy("project_id").agg(F.count("*").alias("n")).groupBy(state.alias("state")).agg(F.count("*").alias("n_projects"), F.sum("n").alias("n_documents"))


def v15_stray_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of document how many of its texts hold provenance comments, and how many such comments there are."""
    n = F.regexp_count("text", F.lit(r"<!--\s*produced_by:"))
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(n > 0).alias("n_with"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_comments"))


def a25_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of a batch's items: cached (key accepted before), rejected (no content), unnamed (no title), or emitted."""
    i = latest_rows(table(spark, d, "harvest_items").select("ref_no", "batch_no", item_key().alias("key"), (F.trim(F.coalesce("content", F.lit(""))) == "").alias("bare"), (F.trim(F.coalesce("title", F.lit(""))) == "").alias("unnamed"), "arrived_at"), "ref_no", "arrived_at")
    seen = table(spark, d, "harvest_seen").filter("dedupe_key is not null").select(F.col("dedupe_key").alias("key")).distinct().withColumn("seen", F.lit(True))
    outcome = F.when(F.col("seen"), "cached").when(F.col("bare"), "rejected").when(F.col("unnamed"), "unnamed").otherwise("emitted")
    return i.join(seen, "key", "left").groupBy("batch_no", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def t5_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the kinds of memos, most frequent first, ties by name."""
    return memos(spark, d, "kind").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def t6_violations(spark: SparkSession, d: str) -> DataFrame:
    """Lines of fenced blocks that are no additions, listed by document, block and line; blocks and lines count from 1."""
    b = documents(spark, d).select("doc_id", F.posexplode(markup.fenced_blocks(F.col("text"))).alias("block", "b"))
    b = b.select("doc_id", (F.col("block") + 1).cast("bigint").alias("block_no"), F.explode(markup.bad_diff_lines(F.regexp_replace("b", r"\n$", ""))).alias("line"))
    return b.select("doc_id", "block_no", F.col("line").cast("bigint").alias("line_no")).orderBy("doc_id", "block_no", "line_no")


def t9_first_runs(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty runs in order of time, then id."""
    return runs(spark, d).orderBy("at", "run_id").limit(20).select("run_id", F.unix_micros("at").alias("at_micros"))


def f10_unfenced(spark: SparkSession, d: str) -> DataFrame:
    """Archived contents below their header that are one fenced block, per source, and the characters that remain without the fence."""
    r = table(spark, d, "raw_items").filter("content is not null").select("raw_id", kind_key("source_kind").alias("source"), F.regexp_replace("content", r"\r\n?", "\n").alias("c")).distinct()
    below = F.trim(F.regexp_replace("c", r"(?s)\A# [^\n]*\n(_[^\n]*\n)+\n", ""))
    r = r.select("source", below.alias("b"), markup.without_fences(below).alias("u"))
    return r.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("u") != F.col("b")).alias("n_fenced"), F.sum(F.length("u")).alias("n_chars"))


def f18_referents(spark: SparkSession, d: str) -> DataFrame:
    """Titles `kind — referent` in the first line of documents: how often each kind stands, and for how many different referents."""
    first = F.split("text", r"\r?\n")[0]
    t = documents(spark, d).select(F.regexp_extract(first, r"^([A-Za-z][A-Za-z ]*?) — (\S.*)$", 1).alias("kind"), F.regexp_extract(first, r"^([A-Za-z][A-Za-z ]*?) — (\S.*)$", 2).alias("of"))
    return t.filter("kind <> ''").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("of").alias("n_referents"))


def f19_updated_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of memory objects with one key set, one added and one deleted: the others stay as they are."""
    t = documents(spark, d).filter("source = 'memory_object'").select("doc_id", markup.header_fields(F.col("text")).alias("f")).filter("f is not null")
    u = t.select("doc_id", markup.updated(F.col("f"), {"kind": "note", "reviewed": "yes", "created_at": None}).alias("u"))
    return u.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("u")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("fields"))


def f29_durations(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds that runs took, per scheduler; ends before the start count as 0, runs without a readable start or end not at all."""
    stamp = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.col(c)).try_cast("timestamp")
    ms = F.greatest(F.lit(0), F.unix_millis(stamp("ended_at")) - F.unix_millis(stamp("started_at")))
    known = stamp("ended_at").isNotNull() & stamp("started_at").isNotNull()
    r = runs(spark, d, "scheduler", "started_at", "ended_at").select("scheduler", F.when(known, ms).alias("ms"))
    return r.groupBy("scheduler").agg(F.count("*").alias("n"), F.count("ms").alias("n_known"), F.sum("ms").alias("total_ms"), F.max("ms").alias("longest_ms"))


def f42_event_maps(spark: SparkSession, d: str) -> DataFrame:
    """Per day the events by type as one text of pairs, in order of type."""
    n = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "n")))  # as many as there are types
    return n.groupBy("day").agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["event_type"], x["n"])), ",").alias("by_type"), F.sum("n").alias("n"))


def f46_literals(spark: SparkSession, d: str) -> DataFrame:
    """Time texts of messages as literals typed by their form: integer, number, or text; and as integers, 0 where they are none."""
    s = latest_rows(table(spark, d, "slack_messages").select("msg_id", "ts", "ingested_at"), "msg_id", "ingested_at")
    t = s.select(markup.literal_type(F.col("ts")).alias("type"), F.coalesce(F.when(F.col("ts").rlike(r"\A-?\d{1,18}\z"), F.col("ts")).cast("bigint"), F.lit(0)).alias("whole"))
    return t.groupBy("type").agg(F.count("*").alias("n"), F.max("whole").alias("largest"))


QUERIES = {
    f.__name__: f
    for f in (
        pr9_routes, pr13_confident, pr14_strict_flags, pr23_session_ids, pr24_applied, pr25_reference_shapes, pr26_first_place, pr27_diff_blocks, s30_id_index, s33_file_order,
        j5_unsuppressed, s37_owner_words, j7_new_phrases, s38_heading_sets, s39_tree, v12_upstream, v13_sidecars, v14_project_slugs, v15_stray_provenance, a25_outcomes, u6_globs,
        t5_kinds, t6_violations, t9_first_runs, f10_unfenced, f18_referents, f19_updated_headers, f29_durations, f42_event_maps, f46_literals,
    )
}

from quillspark.operators.provenance import _M  # noqa: E402
from quillspark.operators.runs import _RUNS  # noqa: E402
from quillspark.operators.texts import _PLAIN, _SECTIONS, ORACLES as _TEXT_SQL  # noqa: E402

_I = "i as (select *, case when source_name = 'slack' then 'slack:' || id else source_name || ':' || substr(sha256(coalesce(content, '')), 1, 16) end as key from (select *, row_number() over (partition by ref_no order by arrived_at desc) as rn from harvest_items) where rn = 1)"
_SRC = "lower(trim(source, ' '))"
_KB = "regexp_extract(text, '^## ([^\\n]*)', 1)"
_WORDS = (
    "h as (select " + _PLAIN.format(_KB) + f" as h from documents where {_SRC} = 'kb_section' and not regexp_matches({_KB}, '<[^>]+>')), w as (select unnest(list_distinct([h] || list_filter(string_split(h, ' '), lambda x: length(x) >= 3))) as word from h where h <> ''), own as (select word, count(*) as n from w group by 1)"
)
_HEADER = r"""o as (select doc_id, regexp_extract(text, '(?s)^---\n(.*?)\n---', 1) as b from documents where lower(trim(source, ' ')) = 'memory_object' and regexp_matches(text, '(?s)^---\n.+?\n---')),
 l as (select doc_id, regexp_extract(x, '^([A-Za-z_][\w-]*):[ \t]*(.*)$', 1) as k, regexp_replace(trim(regexp_extract(x, '^([A-Za-z_][\w-]*):[ \t]*(.*)$', 2), ' '), '^(["''])(.*)["'']$', '\2') as v, i from (select doc_id, unnest(string_split(b, chr(10))) as x, generate_subscripts(string_split(b, chr(10)), 1) as i from o) where regexp_matches(x, '^[A-Za-z_][\w-]*:')),
 fm as (select doc_id, k, arg_min(v, i) as v from l group by 1, 2)"""
_BLOCKS = r"b0 as (select doc_id, regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?ms)^[ \t]*```[^\n]*\n(.*?)^[ \t]*```', 1) as bs from documents), b as (select doc_id, generate_subscripts(bs, 1) as block_no, string_split(regexp_replace(unnest(bs), '\n$', ''), chr(10)) as ls from b0)"
_FLAGS = "select 'canonical' as field, is_canonical_for_event::varchar as x from m union all select 'locked', expiry_locked::varchar from m union all select 'superseded_by', superseded_by from m"
_STAMP = r"case when regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}Z') then epoch_ms(try_cast({0} as timestamptz)) end"
ORACLES = {
    "pr9_routes": f"""with t as (select distinct team from people where team is not null), h as (select doc_id, min(team) as team from documents join t on contains(lower(text), lower(t.team)) group by 1)
 select h.team, count(*) as n from documents d left join h on h.doc_id = d.doc_id group by 1""",
    "pr13_confident": _M + """, s as (select distinct lower(trim(regexp_extract(text, '\\n- \\*\\*Scope:\\*\\* ([^\\n]*)', 1), ' ')) as tag from documents where lower(trim(source, ' ')) = 'kb_section' and not regexp_matches(regexp_extract(text, '^## ([^\\n]*)', 1), '<[^>]+>')),
 k as (select id, count(distinct lower(trim(t, ' '))) as k from (select id, unnest(tags) as t from m) where lower(trim(t, ' ')) in (select tag from s where tag <> '') group by 1)
 select source, coalesce(k.k, 0) >= 1 and coalesce(len(tags), 0) > 0 as passes, count(*) as n from m left join k on k.id = m.id group by 1, 2""",
    "pr14_strict_flags": _M + f", f as ({_FLAGS}) select field, count(*) as n, count(*) filter (lower(trim(x, ' ')) in ('true', 'yes')) as n_true from f group by 1",
    "pr23_session_ids": _RUNS + ", r as (select run_id, regexp_replace(run_id, '^run-', '') as bare from runs) select count(*) as n, count(*) filter (regexp_full_match(run_id, '[A-Za-z0-9]{1,64}')) as n_as_given, count(*) filter (regexp_full_match(bare, '[A-Za-z0-9]{1,64}')) as n_bare, count(*) filter (regexp_full_match(substr(bare, 1, 8), '[0-9a-f]{8}')) as n_short from r",
    "pr24_applied": _M + """, k as (select id, count(*) as n from (select doc_id, unnest(list_distinct(regexp_extract_all(text, 'mem-[0-9a-f]+'))) as id from documents) group by 1)
 select case when k.n is null then 'none' when k.n = 1 then 'one' else 'several' end as found, count(*) as n_memos, min(m.id) as first_id from m left join k on k.id = m.id group by 1""",
    "pr25_reference_shapes": _M + """, r as (select 'superseded_by' as field, 'art://' || trim(superseded_by, ' ') as u from m union all select 'source_uri', source_uri from m)
 select field, case when coalesce(trim(u, ' '), '') = '' then 'missing' when not starts_with(u, 'art://') then 'scheme' when substr(u, 7) = '' then 'empty' when length(substr(u, 7)) > 128 then 'long' when not regexp_full_match(substr(u, 7), '[A-Za-z0-9_-]+') then 'shape' end as error, count(*) as n from r group by 1, 2""",
    "pr26_first_place": f"""with {_I.replace('(select *, row_number() over (partition by ref_no order by arrived_at desc) as rn from harvest_items) where rn = 1', 'harvest_items')}, k as (select dedupe_key as key, 0 as r from raw_items union all select dedupe_key, 1 from harvest_seen union all select key, 2 from i), o as (select key, min(r) as f, max(r) as l from k where key is not null group by 1)
 select case f when 0 then 'archive' when 1 then 'accepted' else 'arriving' end as place, count(*) as n, count(*) filter (l > f) as n_elsewhere from o group by 1""",
    "pr27_diff_blocks": f"select {_SRC} as source, count(*) as n, count(*) filter (regexp_matches(text, '(?m)^[ \\t]*(```|~~~)')) as n_fenced, count(*) filter (regexp_matches(text, '(?m)^[ \\t]*(```|~~~)diff')) as n_diff from documents group by 1",
    "s30_id_index": _M + ", " + _HEADER + ", a as (select id, 0 as t from m union all select v, 1 from fm where k = 'id') select id, count(*) filter (t = 0) as n_memos, count(*) filter (t = 1) as n_documents from a where id is not null group by 1 having count(*) > 1",
    "s33_file_order": f"""with e as (select case when regexp_matches(text, '(?m)^- \\*\\*Scope:\\*\\*') then 'decisions' when regexp_matches(text, '(?m)^- \\*\\*(Role|Team):\\*\\*') then 'people' when regexp_matches(text, '(?m)^- \\*\\*Last verified:\\*\\*') then 'glossary' else 'other' end as file from documents where {_SRC} = 'kb_section')
 select file, count(*) as n, (case file when 'people' then 1 when 'org' then 2 when 'decisions' then 3 when 'glossary' then 4 else 99 end)::bigint as rank from e group by 1""",
    "j5_unsuppressed": "select source, count(*) as n from (select distinct raw_id, lower(trim(source_kind, ' ')) as source, dedupe_key from raw_items where dedupe_key is not null) where dedupe_key not in (select dedupe_key from harvest_seen where memory_path is null and seen_at is not null and dedupe_key is not null) group by 1",
    "s37_owner_words": f"with {_WORDS} select * from own",
    "j7_new_phrases": _M + f", {_WORDS}, t as (select distinct id, " + _PLAIN.format("t") + " as word from (select id, unnest(tags) as t from m)), g as (select word, count(*) as n from t where word <> '' group by 1 having count(*) >= 2), p as (select " + _PLAIN.format("x") + " as word from (select unnest([team, handle, full_name] || string_split(full_name, ' ')) as x from people) where x is not null) select word, n from g where word not in (select word from own) and word not in (select word from p)",
    "s38_heading_sets": f"with {_SECTIONS}, hh as (select {_SRC} as source, " + _PLAIN.format("title") + " as h, count(*) as n from sec join documents using (doc_id) group by 1, 2), k as (select h, count(*) as k from hh group by 1) select source, sum(n)::bigint as n, count(*) as n_different, count(*) filter (k = 1) as n_own from hh join k using (h) where h <> '' group by 1",
    "s39_tree": "select regexp_extract(path, '^raw/([^/]+)/', 1) as folder, case when path like '%.meta.yaml' then 'sidecar' when lower(path) like '%.md' then 'markdown' when not regexp_matches(path, '\\.[A-Za-z0-9]+$') then 'none' else 'other' end as what, count(*) as n from (select distinct path from raw_items where path is not null) group by 1, 2",
    "v13_sidecars": """with r as (select distinct path, regexp_extract(path, '([^/]+?)(\\.[^./]+)?$', 1) as stem, regexp_extract(path, '^[^/]+/([^/]+)/', 1) as folder from raw_items where path is not null), s as (select distinct regexp_extract(memory_path, '([^/]+?)(\\.[^./]+)?$', 1) as stem, regexp_extract(memory_path, '^[^/]+/([^/]+)/', 1) as f from harvest_seen where memory_path is not null),
 j as (select r.path, r.folder, count(s.stem) as k, count(*) filter (s.f = r.folder) as same from r left join s on s.stem = r.stem group by 1, 2) select folder, case when k = 0 then 'missing' when same > 0 then 'matched' else 'elsewhere' end as state, count(*) as n from j group by 1, 2""",
    "u6_globs": " union all ".join(f"select '{g}' as glob, count(distinct path) as n, min(path) as first_path from raw_items where regexp_matches(path, '{r}') having count(*) > 0" for g, r in (("raw/*/*.md", r"^raw/[^/]*/[^/]*\.md$"), ("raw/**/2026-0?-*.md", r"^raw/([^/]+/)*2026-0[^/]-[^/]*\.md$"), ("raw/slack_thread/*", r"^raw/slack_thread/[^/]*$"), ("**/*.txt", r"^([^/]+/)*[^/]*\.txt$"))),
    "v12_upstream": _M + " select coalesce(provenance, 'missing') as upstream_kind, count(*) as n, count(*) filter (source_uri <> '') as n_uri from m group by 1",
    "v14_project_slugs": "with p as (select project_id as s, count(*) as n from documents group by 1) select case when s is null or s = '' then 'missing' when starts_with(s, '.') then 'exempt' when regexp_full_match(s, '[a-z0-9]+(-[a-z0-9]+)*') then 'valid' else 'invalid' end as state, count(*) as n_projects, sum(n)::bigint as n_documents from p group by 1",
    "v15_stray_provenance": f"select {_SRC} as source, count(*) as n, count(*) filter (regexp_matches(text, '<!--\\s*produced_by:')) as n_with, coalesce(sum(len(regexp_extract_all(text, '<!--\\s*produced_by:'))), 0)::bigint as n_comments from documents group by 1",
    "a25_outcomes": f"with {_I} select batch_no, case when key in (select dedupe_key from harvest_seen where dedupe_key is not null) then 'cached' when trim(coalesce(content, ''), ' ') = '' then 'rejected' when trim(coalesce(title, ''), ' ') = '' then 'unnamed' else 'emitted' end as outcome, count(*) as n from i group by 1, 2",
    "t5_kinds": _M + " select kind, count(*) as n from m group by 1",
    "t6_violations": f"with {_BLOCKS}, l as (select doc_id, block_no, unnest(ls) as x, generate_subscripts(ls, 1) as line_no from b) select doc_id, block_no, line_no from l where trim(x, ' ') <> '' and not starts_with(x, '+')",
    "t9_first_runs": _RUNS + " select run_id, t_us as at_micros from runs order by t_us, run_id limit 20",
    "f10_unfenced": r"""with r as (select distinct raw_id, lower(trim(source_kind, ' ')) as source, regexp_replace(content, '\r\n?', chr(10), 'g') as c from raw_items where content is not null), b as (select source, trim(regexp_replace(c, '^# [^\n]*\n(_[^\n]*\n)+\n', ''), ' ') as b from r),
 u as (select *, regexp_replace(b, '(?s)^(?:```|~~~)[\w-]*\n(.*?)\n?(?:```|~~~)\s*$', '\1') as u from b) select source, count(*) as n, count(*) filter (u <> b) as n_fenced, sum(length(u))::bigint as n_chars from u group by 1""",
    "f18_referents": r"with t as (select regexp_extract(text, '^([A-Za-z][A-Za-z ]*?) — (\S[^\r\n]*)', 1) as kind, regexp_extract(text, '^([A-Za-z][A-Za-z ]*?) — (\S[^\r\n]*)', 2) as o from documents) select kind, count(*) as n, count(distinct o) as n_referents from t where kind <> '' group by 1",
    "f19_updated_headers": f"with {_HEADER}, u as (select doc_id, k, v from fm where k not in ('kind', 'reviewed', 'created_at') union all select distinct doc_id, unnest(['kind', 'reviewed']), unnest(['note', 'yes']) from o) select doc_id, string_agg(k || '=' || v, ';' order by k) as fields from u group by 1",
    "f29_durations": _RUNS + f", r as (select scheduler, greatest(0, {_STAMP.format('ended_at')} - {_STAMP.format('started_at')}) as ms, {_STAMP.format('ended_at')} is not null and {_STAMP.format('started_at')} is not null as known from runs) select scheduler, count(*) as n, count(*) filter (known) as n_known, (sum(ms) filter (known))::bigint as total_ms, max(ms) filter (known) as longest_ms from r group by 1",
    "f42_event_maps": "with n as (select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2) select day, string_agg(event_type || '=' || n, ',' order by event_type) as by_type, sum(n)::bigint as n from n group by 1",
    "f46_literals": r"""with s as (select ts from (select *, row_number() over (partition by msg_id order by ingested_at desc) as rn from slack_messages) where rn = 1), t as (select case when coalesce(trim(ts, ' '), '') = '' then 'missing' when trim(ts, ' ') in ('true', 'false') then 'boolean' when trim(ts, ' ') = 'null' then 'null' when regexp_full_match(trim(ts, ' '), '-?(0|[1-9]\d*)') then 'integer' when regexp_full_match(trim(ts, ' '), '-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?') then 'number' else 'text' end as type,
 case when regexp_full_match(ts, '-?\d{1,18}') then try_cast(ts as bigint) else 0 end as whole from s) select type, count(*) as n, max(coalesce(whole, 0)) as largest from t group by 1""",
}
