"""Queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import paths as P
from loamwork.functions import text as T
from loamwork.functions import urls as U
from loamwork.operators import dedupe as D
from loamwork.operators import formats as C
from loamwork.operators import models as M
from loamwork.operators import pages as G
from loamwork.operators import predicate as V
from loamwork.operators import profile as A
from loamwork.operators import sample as S
from loamwork.plans.registry import register
from loamwork.plans.steps import clean_record
from loamwork.sources import html as H
from loamwork.sources import io as I
from loamwork.streaming import ingest as E

SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None, *tables: str):
    """Register a function of the tables as a query."""

    def keep(fn):
        register(name, lambda spark, sf: fn(*[table(spark, sf, t) for t in tables]), sql)
        return fn

    return keep


DOCS, LABELS, PAGES, TURNS = "documents", "labels", "pages", "conversations"
c = F.col

# --- duplicates -----------------------------------------------------------------------------------------------
FIRST = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id) AS r FROM documents) WHERE r = 1"


@query("dedupe_exact_text", FIRST.format(keys="text"), DOCS)
def _(d):
    return D.dedupe_exact(d, [c("doc_id")], ["text"]).select("doc_id")


@query("dedupe_exact_record", FIRST.format(keys="text, lang, source"), DOCS)
def _(d):
    return D.dedupe_exact(d.select("doc_id", "text", "lang", "source"), [c("doc_id")], ["text", "lang", "source"]).select("doc_id")


@query("dedupe_by_key", FIRST.format(keys="source"), DOCS)
def _(d):
    return D.keep_first(d, [c("source")], [c("doc_id")]).select("doc_id")


@query("dedupe_multi_field", FIRST.format(keys="source, lang"), DOCS)
def _(d):
    return D.keep_first(d, [c("source"), c("lang")], [c("doc_id")]).select("doc_id")


@query("dedupe_prefix24", FIRST.format(keys="substr(text, 1, 24)"), DOCS)
def _(d):
    return D.dedupe_by_prefix(d, c("text"), [c("doc_id")]).select("doc_id")


@query("dedupe_chunks", FIRST.format(keys="doc_id // 1000, text"), DOCS)
def _(d):
    return D.keep_first(d, [F.floor(c("doc_id") / 1000), c("text")], [c("doc_id")]).select("doc_id")


@query("record_hash", "SELECT doc_id, sha256(text) AS hash FROM documents", DOCS)
def _(d):
    return d.select("doc_id", F.sha2(c("text").cast("binary"), 256).alias("hash"))


@query("duplicate_groups", "SELECT sha256(text) AS key, count(*) AS size, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS indices FROM documents GROUP BY 1 HAVING count(*) > 1", DOCS)
def _(d):
    return D.duplicate_groups(d, F.sha2(c("text").cast("binary"), 256), c("doc_id")).select("key", "size", F.array_join("indices", ",").alias("indices"))


CONTENT_KEY = r"lower(regexp_replace(trim(text), '\s+', ' ', 'g'))"


@query("duplicate_content_rate", f"SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicates, coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)::DOUBLE AS rate FROM (SELECT {CONTENT_KEY} AS k, count(*) AS n FROM documents GROUP BY 1)", DOCS)
def _(d):
    return D.duplicate_content(d, "text")


@query("duplicates_of_earlier", "SELECT doc_id, coalesce(string_agg(doc_id::VARCHAR, ',') OVER (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS earlier FROM documents", DOCS)
def _(d):
    return D.duplicates_of(d, F.xxhash64("text"), "doc_id").select("doc_id", F.array_join("duplicates_of", ",").alias("earlier"))


# --- URLs -----------------------------------------------------------------------------------------------------
URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
URL_PARTS = f"SELECT page_id, url, regexp_extract(url, '{URL_RE}', 1) AS scheme, regexp_extract(url, '{URL_RE}', 2) AS host, CASE WHEN regexp_extract(url, '{URL_RE}', 3) = '' THEN '/' ELSE regexp_extract(url, '{URL_RE}', 3) END AS path, regexp_extract(url, '{URL_RE}', 4) AS query FROM pages WHERE regexp_matches(url, '{URL_RE}')"
BARE = "coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/')"
CLEAN_URL = f"""SELECT page_id, lower(scheme || '://' || host || {BARE} || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END) AS key
FROM (SELECT *, list_filter(string_split(substr(query, 2), '&'), lambda p: p <> '' AND NOT list_contains({U.TRACKING!r}, string_split(p, '=')[1])) AS q FROM ({URL_PARTS}))"""
SEARCH_KEY = f"SELECT page_id, regexp_replace(lower(host), '^www\\.', '') || lower({BARE}) || query AS key FROM ({URL_PARTS})"
LINK_KEY = f"SELECT page_id, lower(regexp_replace(regexp_replace(host || path, '/$', ''), '^www\\.', '')) AS key FROM ({URL_PARTS})"

for _name, _fn, _sql in (("clean", U.clean_url, CLEAN_URL), ("search", U.search_key, SEARCH_KEY), ("link", U.link_key, LINK_KEY)):
    query(f"normalize_url_{_name}", _sql, PAGES)(lambda p, fn=_fn: p.filter(U.is_url(c("url"))).select("page_id", fn(c("url")).alias("key")))


@query("dedupe_by_url", f"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY key ORDER BY page_id) AS r FROM ({CLEAN_URL})) WHERE r = 1", PAGES)
def _(p):
    return D.dedupe_by_url(p, "url", [c("page_id")]).select("page_id")


@query("search_merge_rank", f"""WITH h AS (SELECT p.page_id, p.url, 'title ' || p.page_id AS title, repeat('s', (p.page_id % 7)::INT) AS snippet, 'p' || (p.page_id % 3) AS provider, (p.page_id % 10) / 10.0::DOUBLE AS score, k.key FROM pages p JOIN ({SEARCH_KEY}) k USING (page_id))
SELECT min_by(url, page_id) AS url, least(1.0, max(score) + (count(DISTINCT provider) - 1) * 0.15::DOUBLE) AS score, count(DISTINCT provider) AS providers FROM h GROUP BY key""", PAGES)
def _(p):
    hits = p.filter(U.is_url(c("url"))).select(c("page_id").alias("_row"), "url", F.concat(F.lit("title "), c("page_id").cast("string")).alias("title"), F.repeat(F.lit("s"), (c("page_id") % 7).cast("int")).alias("snippet"), F.concat(F.lit("p"), (c("page_id") % 3).cast("string")).alias("provider"), (c("page_id") % 10 / F.lit(10.0)).alias("score"))
    return D.merge_rank(hits).select("url", "score", F.size(F.split("provider", r"\+")).cast("long").alias("providers"))


# --- criteria and validation ----------------------------------------------------------------------------------
for _name, _field, _spec, _sql in (
    ("equals", "lang", {"equals": "de"}, "lang = 'de'"), ("contains", "text", {"contains": "THE"}, "contains(lower(text), 'the')"),
    ("regex", "source", {"matches": "^src1[0-9]$"}, "regexp_matches(source, '^src1[0-9]$')"), ("gt", "n_chars", {"greaterThan": 2000}, "n_chars > 2000"),
    ("lt", "n_chars", {"lessThan": 500}, "n_chars < 500"), ("in", "lang", {"in": ["fr", "es"]}, "lang IN ('fr', 'es')"), ("exists", "lang", {"exists": True}, "lang IS NOT NULL"),
):
    query(f"filter_criteria_{_name}", f"SELECT doc_id FROM documents WHERE {_sql}", DOCS)(lambda d, f=_field, s=_spec: V.filter_by_criteria(d, f, s).select("doc_id"))


@query("filter_expr_and_or_not", "SELECT doc_id FROM documents WHERE (coalesce(lang = 'en', false) OR coalesce(n_chars < 800, false)) AND NOT coalesce(source = 'src0', false)", DOCS)
def _(d):
    return V.filter_by_expression(d, {"and": [{"or": [{"field": "lang", "equals": "en"}, {"field": "n_chars", "lessThan": 800}]}, {"not": {"field": "source", "equals": "src0"}}]}).select("doc_id")


@query("remove_empty", "SELECT event_id FROM events WHERE coalesce(props, '') <> '' AND event_type IS NOT NULL AND event_type <> ''", "events")
def _(e):
    return V.remove_empty(e, ["props", "event_type"]).select("event_id")


@query("validate_required", "SELECT event_id AS \"index\", f AS field, 'Required field ''' || f || ''' is missing or empty' AS message, v AS value FROM (SELECT event_id, unnest(['event_type', 'props']) AS f, unnest([event_type, props]) AS v FROM events) WHERE v IS NULL OR trim(v) = ''", "events")
def _(e):
    return V.validate_required(e, c("event_id"), ["event_type", "props"])


@query("validate_ranges", "SELECT o_orderkey AS \"index\", 'o_totalprice' AS field, 'Value is above maximum 300000.0' AS message, o_totalprice::VARCHAR AS value FROM orders WHERE o_totalprice > 300000", "orders")
def _(o):
    return V.validate_ranges(o.select("o_orderkey", F.col("o_totalprice")), c("o_orderkey"), {"o_totalprice": (0.0, 300000.0)})


@query("validate_types", "SELECT c_custkey AS \"index\", 'c_name' AS field, 'Expected number' AS message, c_name AS value FROM customer WHERE try_cast(c_name AS DOUBLE) IS NULL AND c_name IS NOT NULL", "customer")
def _(x):
    return V.validate_types(x, c("c_custkey"), {"c_name": "number"})


@query("validate_urls", "SELECT page_id AS \"index\", 'url' AS field, 'Invalid URL' AS message, url AS value FROM pages WHERE url <> '' AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:\\S')", PAGES)
def _(p):
    return V.validate_urls(p, c("page_id"), ["url"])


@query("validate_emails", "SELECT s_suppkey AS \"index\", 's_name' AS field, 'Invalid email address' AS message, s_name AS value FROM supplier WHERE s_name <> '' AND NOT regexp_matches(s_name, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')", "supplier")
def _(s):
    return V.validate_emails(s, c("s_suppkey"), ["s_name"])


@query("validate_references", "SELECT l_orderkey AS \"index\", 'l_partkey' AS field, 'File not found' AS message, l_partkey::VARCHAR AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)", "lineitem", "part")
def _(l, p):
    return V.validate_references(l, c("l_orderkey"), "l_partkey", p.filter("p_size <= 25").select(c("p_partkey").cast("string").alias("path")))


# --- quality --------------------------------------------------------------------------------------------------
@query("score_by_length", """SELECT doc_id, CASE WHEN n < 500 AND n > 5000 THEN 5 WHEN n > 5000 THEN 5 WHEN n < 500 THEN greatest(1, floor(n / 500.0::DOUBLE * 5 + 0.5)::INT) WHEN n > 100 AND n < 10000 THEN 10 WHEN n < 50 THEN 6 WHEN n > 50000 THEN 7 ELSE 10 END::INT AS score,
CASE WHEN n < 500 THEN 'Length ' || n || ' below minimum 500' WHEN n > 5000 THEN 'Length ' || n || ' exceeds maximum 5000' WHEN n > 100 AND n < 10000 THEN 'Optimal length' WHEN n < 50 THEN 'Very short content' WHEN n > 50000 THEN 'Very long content' ELSE 'Good length' END AS reason
FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)""", DOCS)
def _(d):
    return d.select("doc_id", T.length_score(c("text"), 500, 5000).alias("q")).select("doc_id", "q.score", "q.reason")


METRICS = r"""SELECT doc_id, ls AS length_score, rs AS readability_score, ds AS diversity_score, fs AS format_score, floor(ls * 0.3::DOUBLE + rs * 0.25::DOUBLE + ds * 0.25::DOUBLE + fs * 0.2::DOUBLE + 0.5::DOUBLE)::INT AS overall FROM (
SELECT doc_id, (CASE WHEN n < 50 THEN 3 WHEN n < 100 THEN 5 WHEN n < 200 THEN 7 WHEN n > 10000 THEN 6 ELSE 10 END)::INT AS ls,
(CASE WHEN m < 10 THEN 4 WHEN m > 50 THEN 5 ELSE 10 END)::INT AS rs,
greatest(1, least(10, floor(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END * 20 + 0.5)))::INT AS ds,
greatest(1, 10 - CASE WHEN contains(t, chr(10) || chr(10) || chr(10) || chr(10)) THEN 2 ELSE 0 END - CASE WHEN regexp_matches(t, '[^\x20-\x7E\s\x{00A0}-\x{024F}]') THEN 1 ELSE 0 END - CASE WHEN contains(t, '  ') THEN 1 ELSE 0 END - CASE WHEN k > 0 AND NOT regexp_matches(t, '[.!?]\z') THEN 1 ELSE 0 END)::INT AS fs
FROM (SELECT *, CASE WHEN k > 0 THEN n / k::DOUBLE ELSE 0 END AS m FROM (SELECT doc_id, t, length(t) AS n, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_matches(x, '\S'))) AS k, regexp_extract_all(lower(t), '\w+') AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))"""


def _metrics(d):
    return d.select("doc_id", T.quality_metrics(c("text")).alias("q")).select("doc_id", "q.length_score", "q.readability_score", "q.diversity_score", "q.format_score", "q.overall")


query("quality_metrics", METRICS, DOCS)(_metrics)


@query("filter_by_quality", f"SELECT doc_id FROM ({METRICS}) WHERE overall >= 7", DOCS)
def _(d):
    return _metrics(d).filter("overall >= 7").select("doc_id")


@query("quality_distribution", f"SELECT bucket, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('1-3'), ('4-5'), ('6-7'), ('8-9'), ('10')) b(bucket) LEFT JOIN (SELECT CASE WHEN overall <= 3 THEN '1-3' WHEN overall <= 5 THEN '4-5' WHEN overall <= 7 THEN '6-7' WHEN overall <= 9 THEN '8-9' ELSE '10' END AS bucket, count(*) AS n FROM ({METRICS}) GROUP BY 1) USING (bucket)", DOCS)
def _(d):
    return A.quality_distribution(_metrics(d), "overall")


@query("top_quality", f"SELECT doc_id, overall FROM ({METRICS}) ORDER BY overall DESC, doc_id LIMIT 20", DOCS)
def _(d):
    return _metrics(d).orderBy(F.desc("overall"), "doc_id").limit(20).select("doc_id", "overall")


@query("combine_quality", f"SELECT doc_id, greatest(1, least(10, floor((overall * 2.0::DOUBLE + quality * 10 * 1.0::DOUBLE) / 3.0::DOUBLE + 0.5::DOUBLE)::INT)) AS score FROM ({METRICS}) JOIN labels USING (doc_id)", DOCS, LABELS)
def _(d, l):
    return _metrics(d).join(l, "doc_id").select("doc_id", A.combined_quality([c("overall"), c("quality") * 10], [2.0, 1.0]).alias("score"))


@query("valid_content", r"SELECT doc_id FROM documents WHERE length(trim(text)) BETWEEN 50 AND 10000 AND len(regexp_extract_all(trim(text), '\w')) / length(trim(text))::DOUBLE >= 0.3::DOUBLE", DOCS)
def _(d):
    return d.filter(T.is_valid_content(c("text"), 50, 10000)).select("doc_id")


@query("relevance_keyword", "SELECT doc_id, least((contains(t, 'the')::INT + contains(t, 'ation')::INT + CASE WHEN contains(t, 'the ation') THEN 2 ELSE 0 END) / 2.0::DOUBLE, 1.0::DOUBLE) AS relevance FROM (SELECT doc_id, lower(text) AS t FROM documents)", DOCS)
def _(d):
    return d.select("doc_id", T.relevance(c("text"), "the ation").alias("relevance"))


STOP = ["the", "and", "of", "to", "in", "is", "that", "it", "for", "was", "with", "as", "be", "by", "this"]
_TOK = "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains(" + repr(STOP) + ", w))"


@query("overlap_score", f"""SELECT doc_id, CASE WHEN len(q) = 0 THEN 0.0 ELSE list_sum(list_transform(q, lambda w: CASE WHEN list_contains(t, w) THEN 2 WHEN list_contains(s, w) THEN 1 ELSE 0 END)) / (len(q) * 2.0::DOUBLE) END AS score
FROM (SELECT doc_id, {_TOK.format(x="substr(text, 1, 40)")} AS q, {_TOK.format(x="substr(text, 20, 60)")} AS t, {_TOK.format(x="text")} AS s FROM documents)""", DOCS)
def _(d):
    return d.select("doc_id", T.overlap_score(F.substring("text", 1, 40), F.substring("text", 20, 60), c("text"), STOP).alias("score"))


@query("token_estimate", "SELECT source, sum(ceil(length(text) / 4.0::DOUBLE))::BIGINT AS tokens FROM documents GROUP BY 1", DOCS)
def _(d):
    return d.groupBy("source").agg(F.sum(T.token_estimate(c("text"))).alias("tokens"))


@query("profanity_flag", f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(T.PROFANITY)}') AS profane FROM documents", DOCS)
def _(d):
    return d.select("doc_id", T.contains_profanity(c("text")).alias("profane"))


@query("mask_values", "SELECT c_custkey, CASE WHEN length(c_name) <= 6 THEN '***' ELSE substr(c_name, 1, 3) || '...' || right(c_name, 3) END AS masked FROM customer", "customer")
def _(x):
    return x.select("c_custkey", T.mask_value(c("c_name")).alias("masked"))


@query("claims", r"SELECT doc_id, len(list_filter(list_concat(regexp_extract_all(text, '[A-Z][^.!?]*?(?:is|are|was|were|will|can|has|have|had)[^.!?]*'), regexp_extract_all(text, '[^.!?]*\d+[^.!?]*')), lambda x: length(x) > 10 AND length(x) < 200))::BIGINT AS n FROM documents", DOCS)
def _(d):
    return d.select("doc_id", F.size(T.claims(c("text"))).cast("long").alias("n"))


query("remove_boilerplate", None, DOCS)(lambda d: d.select("doc_id", T.remove_boilerplate(c("text")).alias("text")))
query("math_filter", None, DOCS)(lambda d: M.math_filter(d, "text").select("doc_id"))


@query("clean_record", r"SELECT doc_id, nullif(lower(trim(regexp_replace(text, '\r\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))), '') AS text, nullif(lower(trim(lang)), '') AS lang FROM documents", DOCS)
def _(d):
    return clean_record(d.select("doc_id", "text", "lang"), lowercase=True)


@query("text_helpers", r"SELECT doc_id, regexp_replace(text, '<[^>]*>', '', 'g') AS no_tags, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one_space, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short FROM documents", DOCS)
def _(d):
    return d.select("doc_id", T.strip_html_tags(c("text")).alias("no_tags"), T.normalize_whitespace(c("text")).alias("one_space"), T.truncate(c("text"), 100).alias("short"))


# --- pages, questions, tags -----------------------------------------------------------------------------------
TITLE = "substr(string_split(text, chr(10))[1], 1, 60)"
AS_PAGES = f"SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'ftp://x' ELSE 'https://h.example/a/' || doc_id END AS source_url, CASE WHEN doc_id % 13 = 0 THEN '' ELSE {TITLE} END AS title, text FROM documents"
REASON = r"""CASE WHEN NOT starts_with(source_url, 'http') THEN 'invalid_url' WHEN length(trim(title)) < 3 THEN 'invalid_title' WHEN text = '' THEN 'missing_text' WHEN length(trim(text)) < 500 THEN 'text_too_short' WHEN length(trim(text)) > 8000 THEN 'text_too_long' WHEN len(regexp_extract_all(trim(text), '\w')) / length(trim(text))::DOUBLE < 0.3::DOUBLE THEN 'low_word_ratio' END"""


def _as_pages(d):
    return d.select(c("doc_id").alias("id"), F.when(c("doc_id") % 11 == 0, "ftp://x").otherwise(F.concat(F.lit("https://h.example/a/"), c("doc_id").cast("string"))).alias("source_url"), F.when(c("doc_id") % 13 == 0, "").otherwise(F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 60)).alias("title"), "text")


def _reasons(d):
    return _as_pages(d).select("id", G.page_reason(c("source_url"), c("title"), c("text"), 500, 8000).alias("reason"))


query("page_filter_reasons", f"SELECT id, {REASON} AS reason FROM ({AS_PAGES})", DOCS)(_reasons)


@query("filter_reason_counts", f"SELECT {REASON} AS reason, count(*) AS n FROM ({AS_PAGES}) GROUP BY 1", DOCS)
def _(d):
    return _reasons(d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("decision_summary_rollup", f"SELECT stage, action, count(*) AS n FROM (SELECT CASE WHEN id % 2 = 0 THEN 'filter' ELSE 'clean' END AS stage, CASE WHEN {REASON} IS NULL THEN 'keep' ELSE 'drop' END AS action FROM ({AS_PAGES})) GROUP BY ROLLUP (stage, action)", DOCS)
def _(d):
    log = _reasons(d).select(F.when(c("id") % 2 == 0, "filter").otherwise("clean").alias("stage"), F.when(c("reason").isNull(), "keep").otherwise("drop").alias("action"))
    return A.decision_summary(log)


@query("deterministic_qa", rf"""SELECT doc_id, 'What is ' || trim(regexp_replace(regexp_replace(title, '\s*[-|]\s*.*', '', 'g'), '\s+', ' ', 'g')) || '?' AS instruction,
coalesce(list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda p: trim(p, ' ' || chr(10) || chr(9) || chr(13))), lambda p: length(p) > 50)[1], substr(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 1, 500) || CASE WHEN length(text) > 500 THEN '...' ELSE '' END) AS output FROM (SELECT doc_id, {TITLE} AS title, text FROM documents)""", DOCS)
def _(d):
    title = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 60)
    return d.select("doc_id", T.question_pair(title, c("text")).alias("q")).select("doc_id", "q.instruction", "q.output")


query("template_instruct", None, DOCS)(lambda d: G.text_instruct(_as_pages(d)))
query("template_qa", None, DOCS)(lambda d: G.text_qa(_as_pages(d)))
query("template_conversation", None, DOCS)(lambda d: G.text_conversation(_as_pages(d)).select("id", F.to_json("messages").alias("messages")))
query("template_raw_extract", None, DOCS)(lambda d: G.raw_extract(_as_pages(d)))

SEGMENTS = f"SELECT page_id, list_transform(list_filter(string_split(path, '/'), lambda s: length(s) > 2 AND NOT contains(s, '.')), lambda s: regexp_replace(s, '[-_]', ' ', 'g')) AS s FROM ({URL_PARTS})"


@query("extract_tags_url", f"SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(s, lambda x: lower(x)))), '|') AS tags FROM ({SEGMENTS})", PAGES)
def _(p):
    return p.filter(U.is_url(c("url"))).select("page_id", F.array_join(F.array_sort(G.url_tags(F.lit(""), c("url"))), "|").alias("tags"))


@query("infer_label", f"SELECT page_id, CASE WHEN len(s) > 0 THEN array_to_string(s[-2:], ' ') ELSE 'uncategorized' END AS label FROM ({SEGMENTS})", PAGES)
def _(p):
    return p.filter(U.is_url(c("url"))).select("page_id", G.label_from_context(c("url"), F.lit("")).alias("label"))


JUNK_SQL = "'" + "|".join(G.JUNK) + "'"


@query("junk_assets", f"SELECT page_id, (size < 5000 OR regexp_matches(name, '\\.(svg|ico|cur)$') OR (ends_with(name, '.gif') AND size < 50000) OR regexp_matches(name, {JUNK_SQL}) OR regexp_matches(lower(url), {JUNK_SQL})) AS junk FROM (SELECT page_id, url, length(html) * 5 AS size, lower(regexp_extract(url, '([^/]*)$', 1)) AS name FROM pages)", PAGES)
def _(p):
    return p.select("page_id", G.junk_asset(U.base_name(c("url")), c("url"), F.length("html") * 5, F.lit("")).alias("junk"))


@query("link_assets_pages", f"""WITH k AS ({LINK_KEY}), parts AS (SELECT page_id, path FROM ({URL_PARTS})),
a AS (SELECT p.page_id AS asset_id, CASE WHEN p.page_id % 3 = 0 THEN k.key ELSE 'other.example' || parts.path END AS akey, parts.path AS apath FROM pages p JOIN k USING (page_id) JOIN parts USING (page_id)),
bykey AS (SELECT key, max(page_id) AS page FROM k GROUP BY key), bypath AS (SELECT path, min(page_id) AS page FROM parts WHERE path <> '/' GROUP BY path)
SELECT asset_id, coalesce(bykey.page, bypath.page) AS page_id FROM a LEFT JOIN bykey ON a.akey = bykey.key LEFT JOIN bypath ON a.apath = bypath.path""", PAGES)
def _(p):
    good = p.filter(U.is_url(c("url")))
    pages = good.select("page_id", c("url").alias("source_url"), F.lit("t").alias("title"), F.lit("x").alias("text"))
    assets = good.select(c("page_id").alias("asset_id"), F.when(c("page_id") % 3 == 0, c("url")).otherwise(F.concat(F.lit("http://other.example"), U.path(c("url")))).alias("source_page_url"))
    return G.link_assets(assets, pages).select("asset_id", c("page.page_id").alias("page_id"))


@query("manifest_upsert", """WITH b AS (SELECT url, page_id, 0 AS src FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT url, page_id, 1 FROM pages WHERE page_id % 3 = 0 OR page_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src DESC, page_id DESC) AS k, min(src * 1000000000 + page_id) OVER (PARTITION BY url) AS f FROM b)
SELECT 'asset_' || row_number() OVER (ORDER BY f) AS asset_id, url, page_id FROM r WHERE k = 1""", PAGES)
def _(p):
    rows = p.select("url", "page_id")
    return G.merge_manifests(rows.filter("page_id % 3 <> 0"), rows.filter("page_id % 3 = 0 or page_id % 2 = 0"), "url", "page_id").select("asset_id", "url", "page_id")


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", DOCS, LABELS)
def _(d, l):
    return G.unprocessed(d, l, "doc_id").select("doc_id")


@query("label_join", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)", DOCS, LABELS)
def _(d, l):
    return d.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


query("html_records", None, PAGES)(H.html_records)
query("html_pages", None, PAGES)(lambda p: H.extract_pages(p).select("page_id", "source_url", "title", "text", F.array_join("links", " ").alias("links"), F.array_join("files", " ").alias("files")))


# --- field maps, flattening, unions ---------------------------------------------------------------------------
@query("field_map_template", "SELECT c_name || ' of ' || n_name AS who,  'balance ' || printf('%.2f', c_acctbal) AS note FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer", "nation")
def _(x, n):
    rows = x.join(n, c("c_nationkey") == c("n_nationkey")).select(F.struct("c_name", F.format_string("%.2f", "c_acctbal").alias("c_acctbal")).alias("c"), F.array("n_name").alias("n"))
    return P.apply_field_map(rows, {"who": "{{c.c_name}} of {{ n[0] }}", "note": "balance {{c.c_acctbal}}"})


@query("flatten_records", "SELECT o_orderkey AS \"o.key\", o_orderstatus AS \"o.status\", '[\"' || o_orderpriority || '\"]' AS tags FROM orders", "orders")
def _(o):
    return P.flatten(o.select(F.struct(c("o_orderkey").alias("key"), c("o_orderstatus").alias("status")).alias("o"), F.array("o_orderpriority").alias("tags")))


@query("union_missing_columns", "SELECT doc_id, lang, NULL::DOUBLE AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality::DOUBLE FROM labels", DOCS, LABELS)
def _(d, l):
    return d.select("doc_id", "lang").unionByName(l.select("doc_id", c("quality").cast("double").alias("quality")), allowMissingColumns=True)


@query("except_filtered", "SELECT doc_id FROM documents WHERE NOT coalesce(n_chars > 1000, false)", DOCS)
def _(d):
    return d.join(V.filter_by_criteria(d, "n_chars", {"greaterThan": 1000}).select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels", DOCS, LABELS)
def _(d, l):
    return d.select("doc_id").intersect(l.select("doc_id"))


# --- samples and splits ---------------------------------------------------------------------------------------
def _split_sql(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT doc_id, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' WHEN p < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER ({part}ORDER BY md5('{SEED}:' || doc_id)) - 1 AS p, count(*) OVER ({part}) AS n FROM documents)"


@query("split_hash", _split_sql(""), DOCS)
def _(d):
    return S.split(d.select("doc_id"), S.hash_order(c("doc_id"), SEED))


@query("stratified_split", _split_sql("lang"), DOCS)
def _(d):
    return S.stratified_split(d.select("doc_id", "lang"), c("lang"), S.hash_order(c("doc_id"), SEED)).select("doc_id", "split")


@query("split_ordered", "SELECT doc_id, CASE WHEN p < floor(n * 0.5::DOUBLE) THEN 'train' WHEN p < floor(n * 0.5::DOUBLE) + floor(n * 0.3::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)", DOCS)
def _(d):
    return S.split(d.select("doc_id"), c("doc_id"), (0.5, 0.3, 0.2), numeric=True)


query("split_xorshift", None, DOCS)(lambda d: S.split_compatible(d.select("doc_id"), [c("doc_id")], SEED))


@query("sample_random", f"SELECT doc_id FROM documents ORDER BY md5('{SEED}:' || doc_id) LIMIT 100", DOCS)
def _(d):
    return S.sample(d, 100, c("doc_id"), SEED).select("doc_id")


@query("sample_stratified", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id)) AS r, dense_rank() OVER (ORDER BY source) - 1 AS g, (SELECT count(DISTINCT source) FROM documents) AS k FROM documents) WHERE r <= 105 // k + CASE WHEN g < 105 % k THEN 1 ELSE 0 END", DOCS)
def _(d):
    return S.sample_stratified(d.select("doc_id", "source"), "source", 105, c("doc_id"), SEED).select("doc_id")


@query("sample_proportional", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id)) AS r, count(*) OVER (PARTITION BY source) AS s, count(*) OVER () AS n FROM documents) WHERE r <= floor(200.0::DOUBLE * s / n)", DOCS)
def _(d):
    return S.sample_stratified(d.select("doc_id", "source"), "source", 200, c("doc_id"), SEED, "proportional").select("doc_id")


@query("balance_by_field", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 50", DOCS)
def _(d):
    return S.balance(d, "lang", 50, [c("doc_id")]).select("doc_id")


@query("evenly_spaced_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) WHERE p IN (SELECT floor(i * (SELECT count(*) FROM documents) / 50.0::DOUBLE) FROM range(50) r(i))", DOCS)
def _(d):
    return S.evenly_spaced(d.select("doc_id"), c("doc_id"), 50)


@query("browse_search_sort_page", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(lower(c_custkey::VARCHAR), '1') OR contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1') ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 25", "customer")
def _(x):
    return I.browse(x.select("c_custkey", "c_name", "c_mktsegment", F.struct("c_acctbal").alias("s")).drop("s").join(x.select("c_custkey", "c_acctbal"), "c_custkey").filter(F.lower(F.concat_ws("|", c("c_custkey").cast("string"), "c_name", "c_mktsegment")).contains("1")), None, "-c_acctbal", 2, 25, ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


@query("browse_search", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '7') OR contains(s_suppkey::VARCHAR, '7') OR contains(s_nationkey::VARCHAR, '7') ORDER BY s_suppkey LIMIT 500", "supplier")
def _(s):
    return I.browse(s.select("s_suppkey", "s_name", "s_nationkey"), "7", "s_suppkey", 1, 500).select("s_suppkey")


# --- profiles -------------------------------------------------------------------------------------------------
def _stat(field: str, kind: str, v: str) -> str:
    return f"SELECT '{field}' AS field, '{kind}' AS kind, count({field}) AS non_null, count(*) - count({field}) AS nulls, min({v})::DOUBLE AS least, max({v})::DOUBLE AS most, round(avg({v}), 6) AS mean FROM documents"


@query("field_statistics", " UNION ALL ".join([_stat("doc_id", "number", "doc_id"), _stat("text", "string", "length(text)"), _stat("lang", "string", "length(lang)"), _stat("n_chars", "number", "n_chars")]), DOCS)
def _(d):
    return A.field_statistics(d.select("doc_id", "text", "lang", "n_chars")).withColumn("mean", F.round("mean", 6))


@query("dataset_info", f"SELECT split, count(*) AS num_examples, sum(length(text))::BIGINT AS num_bytes FROM ({_split_sql('')}) JOIN documents USING (doc_id) GROUP BY ROLLUP (split)", DOCS)
def _(d):
    return A.dataset_info(S.split(d.select("doc_id", "text"), S.hash_order(c("doc_id"), SEED)), F.length("text"))


@query("group_by_type", "SELECT CASE WHEN regexp_matches(url, '\\.(jpg|jpeg|png|gif|webp|bmp|svg)([?#].*)?$') THEN 'image' WHEN regexp_matches(url, '\\.(pdf|doc|docx|txt)([?#].*)?$') THEN 'document' ELSE 'other' END AS type, count(*) AS n FROM pages GROUP BY 1", PAGES)
def _(p):
    t = U.file_type(F.lower("url"))
    return p.groupBy(F.when(t.isin("image", "document"), t).otherwise("other").alias("type")).agg(F.count(F.lit(1)).alias("n"))


# --- training formats -----------------------------------------------------------------------------------------
PAIRS = "SELECT a.conv_id, a.turn, a.text AS instruction, b.text AS output FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"


def _pairs(t):
    a, b = t.filter("role = 'user'").select("conv_id", "turn", c("text").alias("instruction")), t.filter("role = 'assistant'").select("conv_id", (c("turn") - 1).alias("turn"), c("text").alias("output"))
    return a.join(b, ["conv_id", "turn"])


query("format_alpaca", f"SELECT instruction, '' AS input, output FROM ({PAIRS}) WHERE trim(instruction) <> '' AND trim(output) <> ''", TURNS)(lambda t: C.alpaca(_pairs(t)))
query("format_raw", f"SELECT instruction AS prompt, output AS completion FROM ({PAIRS})", TURNS)(lambda t: C.raw(_pairs(t)))


@query("format_chatml", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id", TURNS)
def _(t):
    return C.chatml(t).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("messages"))


@query("format_sharegpt", "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS conversations FROM conversations GROUP BY conv_id", TURNS)
def _(t):
    return C.sharegpt(t).select("conv_id", F.array_join(F.transform("conversations", lambda m: F.concat_ws(": ", m["from"], m["value"])), "\n").alias("conversations"))


@query("format_oasst", "SELECT conv_id || '_' || k AS message_id, lag(conv_id || '_' || k) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'prompter' END AS role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) WHERE trim(coalesce(text, '')) <> ''", TURNS)
def _(t):
    return C.oasst(t)


BOXES = "SELECT p_partkey AS k, 'img_' || (p_partkey % 500) || '.jpg' AS image, p_brand AS label, [p_size::DOUBLE, (p_partkey % 40) * 2.0::DOUBLE, p_size + 5.0::DOUBLE, 10.0::DOUBLE] AS bbox FROM part"


def _boxes(p):
    return p.select(c("p_partkey").alias("k"), F.concat(F.lit("img_"), (c("p_partkey") % 500).cast("string"), F.lit(".jpg")).alias("image"), c("p_brand").alias("label"), F.array(c("p_size").cast("double"), (c("p_partkey") % 40) * F.lit(2.0), c("p_size") + F.lit(5.0), F.lit(10.0)).alias("bbox"), F.lit(641).alias("width"), F.lit(479).alias("height"))


IMAGES = f"SELECT image, row_number() OVER (ORDER BY f) AS image_id FROM (SELECT image, min(k) AS f FROM ({BOXES}) GROUP BY image)"
CATEGORIES = f"SELECT label, row_number() OVER (ORDER BY f) AS category_id FROM (SELECT label, min(k) AS f FROM ({BOXES}) GROUP BY label)"
query("format_coco_images", IMAGES, "part")(lambda p: C.coco(_boxes(p), "k")[0].select("image", c("image_id").cast("long").alias("image_id")))
query("format_coco_categories", CATEGORIES, "part")(lambda p: C.coco(_boxes(p), "k")[1].select("label", c("category_id").cast("long").alias("category_id")))
query("format_coco_annotations", f"SELECT k, image_id, category_id, (bbox[3] * bbox[4])::DOUBLE AS area FROM ({BOXES}) JOIN ({IMAGES}) USING (image) JOIN ({CATEGORIES}) USING (label)", "part")(
    lambda p: C.coco(_boxes(p), "k")[2].select("k", c("image_id").cast("long").alias("image_id"), c("category_id").cast("long").alias("category_id"), "area")
)
query("format_yolo_labels", f"SELECT image, string_agg(printf('%d %.6f %.6f %.6f %.6f', cid, (bbox[1] + bbox[3] / 2) / 641, (bbox[2] + bbox[4] / 2) / 479, bbox[3] / 641, bbox[4] / 479), chr(10) ORDER BY k) AS labels FROM ({BOXES}) JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cid FROM (SELECT DISTINCT label FROM ({BOXES}))) USING (label) GROUP BY image", "part")(
    lambda p: C.yolo(_boxes(p), "k")
)


@query("filename_collision", r"SELECT page_id, CASE WHEN k > 0 THEN substr(n, 1, length(n) - length(e)) || '_' || k || e ELSE n END AS file_name FROM (SELECT page_id, n, lower(regexp_extract(n, '(\.[^./\\]+)$', 1)) AS e, row_number() OVER (PARTITION BY page_id % 3, n ORDER BY page_id) - 1 AS k FROM (SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS n FROM pages))", PAGES)
def _(p):
    return C.collision_names(p, c("page_id") % 3, "url", "page_id").select("page_id", "file_name")


PART_LABELS = ["Brand#11", "Brand#25", "brand 33", "Brand#4"]


@query("fuzzy_label", "WITH l(k, v) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(PART_LABELS)) + ") SELECT p_partkey, coalesce(arg_min(v, k) FILTER (WHERE x = lower(v)), arg_min(v, k) FILTER (WHERE contains(x, lower(v)) OR contains(lower(v), x)), CASE WHEN min(levenshtein(x, lower(v))) <= greatest(3.0::DOUBLE, length(any_value(x)) / 2.0::DOUBLE) THEN arg_min(v, levenshtein(x, lower(v)) * 100 + k) END, 'Brand#11') AS label FROM (SELECT p_partkey, lower(trim(p_brand)) AS x FROM part), l GROUP BY p_partkey", "part")
def _(p):
    return p.select("p_partkey", T.fuzzy_label(c("p_brand"), PART_LABELS).alias("label"))


@query("language_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang", DOCS)
def _(d):
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# --- events: windows (an extension) ---------------------------------------------------------------------------
@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", "events")
def _(e):
    return E.tumbling(e, "ts", "1 hour", ["event_type"]).select(c("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s", "events")
def _(e):
    return E.sessions(e, "ts", "30 minutes", ["user_id"]).select("user_id", c("session_window.start").alias("start"), "n")


# --- flagship -------------------------------------------------------------------------------------------------
@query("flagship_alpaca", f"""WITH m AS ({METRICS}), u AS ({FIRST.format(keys="text")}), g AS (SELECT d.doc_id, d.text, m.overall FROM documents d JOIN u USING (doc_id) JOIN m USING (doc_id) WHERE m.overall >= 6 AND trim(d.text) <> ''),
s AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id)) - 1 AS p, count(*) OVER () AS n FROM g)
SELECT doc_id, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' WHEN p < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split, 'Summarize ' || substr(text, 1, 40) AS instruction, '' AS input, substr(text, 1, 1000) AS output FROM s""", DOCS)
def _(d):
    first = D.dedupe_exact(d.filter(F.trim("text") != ""), [c("doc_id")], ["text"])
    good = first.withColumn("q", T.quality_metrics(c("text"))).filter("q.overall >= 6").select("doc_id", "text")
    rows = S.split(good, S.hash_order(c("doc_id"), SEED))
    return rows.select("doc_id", "split", F.concat(F.lit("Summarize "), F.substring("text", 1, 40)).alias("instruction"), F.lit("").alias("input"), F.substring("text", 1, 1000).alias("output"))
