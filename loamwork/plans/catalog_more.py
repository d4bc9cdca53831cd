"""Further queries over the test tables: assets, clean-up, scalars and formats, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions import scalars as X
from loamwork.functions import urls as U
from loamwork.functions.text import TAG_STOP_WORDS, js_trim
from loamwork.operators import assets as A
from loamwork.operators import cleanup as L
from loamwork.operators import dedupe as D
from loamwork.operators import formats as C
from loamwork.operators import pages as G
from loamwork.operators import predicate as V
from loamwork.plans.catalog import DOCS, PAGES, SEGMENTS, URL_RE, query

c = F.col
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
NAME = "regexp_extract(url, '([^/]*)$', 1) || '-' || page_id || '.' || (CASE page_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' WHEN 2 THEN 'svg' ELSE 'mp4' END)"
STATUS = "CASE WHEN page_id % 5 = 0 THEN 'failed' ELSE 'completed' END"
ASSETS = f"""SELECT 'asset_' || page_id AS id, {NAME} AS file_name, {STATUS} AS status, CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'files/' || page_id END AS local_path,
CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'Image/png' ELSE 'video' END AS file_type, length(html) * 3 AS size, url AS source_url, {TITLE} AS source_page_title, '' AS alt_text FROM pages"""


def assets_of(p: DataFrame) -> DataFrame:
    """Pages read as a manifest's assets."""
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "PNG", "svg", "mp4"))), (c("page_id") % 4 + 1).cast("int"))
    return p.select(
        F.concat(F.lit("asset_"), c("page_id").cast("string")).alias("id"),
        F.concat(F.regexp_extract("url", r"([^/]*)\z", 1), F.lit("-"), c("page_id").cast("string"), F.lit("."), ext).alias("file_name"),
        F.when(c("page_id") % 5 == 0, "failed").otherwise("completed").alias("status"),
        F.when(c("page_id") % 7 != 0, F.concat(F.lit("files/"), c("page_id").cast("string"))).alias("local_path"),
        F.element_at(F.array(*map(F.lit, ("image", "Image/png", "video"))), (c("page_id") % 3 + 1).cast("int")).alias("file_type"),
        (F.length("html") * 3).alias("size"), c("url").alias("source_url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("source_page_title"), F.lit("").alias("alt_text"),
    )


JUNK = "'" + "|".join(A.JUNK) + "'"
ASSET_REASON = f"""CASE WHEN status <> 'completed' THEN 'failed_status: ' || status WHEN local_path IS NULL THEN 'missing_local_path'
WHEN size < 5000 OR regexp_matches(lower(file_name), '\\.(svg|ico|cur)$') OR (ends_with(lower(file_name), '.gif') AND size < 50000) OR regexp_matches(lower(file_name), {JUNK}) OR regexp_matches(lower(source_url), {JUNK}) THEN 'junk_pattern_matched' END"""


@query("asset_decision_log", f"SELECT id AS record_id, 'filter' AS stage, CASE WHEN r IS NULL THEN 'keep' ELSE 'drop' END AS action, coalesce(r, 'passed_all_filters') AS reason FROM (SELECT id, {ASSET_REASON} AS r FROM ({ASSETS}))", PAGES)
def _(p):
    a = assets_of(p)
    return A.decision_log(a, "id", "filter", A.asset_reason(a))


@query("assets_kept", f"SELECT id FROM ({ASSETS}) WHERE ({ASSET_REASON}) IS NULL", PAGES)
def _(p):
    return A.filter_assets(assets_of(p)).select("id")


@query("transform_stats", f"SELECT count(*) AS seen, count(*) FILTER (WHERE r IS NULL) AS kept, count(r) AS dropped, count(*) FILTER (WHERE r IS NULL) / count(*)::DOUBLE AS rate FROM (SELECT {ASSET_REASON} AS r FROM ({ASSETS}))", PAGES)
def _(p):
    a = assets_of(p)
    return A.transform_stats(A.decision_log(a, "id", "filter", A.asset_reason(a)))


@query("valid_assets", f"SELECT id, '/base/' || local_path AS path FROM ({ASSETS}) WHERE status = 'completed' AND local_path IS NOT NULL AND contains(lower(file_type), 'image')", PAGES)
def _(p):
    return A.asset_paths(A.valid_assets(assets_of(p), ["image"]), "/base")


@query("asset_by_id", f"SELECT id, file_name FROM ({ASSETS}) WHERE id = 'asset_17'", PAGES)
def _(p):
    return A.asset_by_id(assets_of(p), "asset_17").select("id", "file_name")


TAG_WORDS = "(" + ", ".join(f"'{w}'" for w in X.MANIFEST_STOP_WORDS) + ")"
PATH = f"regexp_extract(url, '{URL_RE}', 3)"
TAGS = f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(
list_filter(list_transform(flatten(list_transform(list_filter(string_split({PATH}, '/'), lambda s: length(s) > 2), lambda s: string_split_regex(regexp_replace(s, '\\.[^/.]+$', ''), '[-_\\s]+'))), lambda w: trim(lower(w))), lambda w: length(w) > 2 AND w NOT IN {TAG_WORDS} AND regexp_full_match(w, '[a-z0-9]+')),
list_filter(string_split(lower(regexp_extract(url, '{URL_RE}', 2)), '.'), lambda w: length(w) > 2 AND w NOT IN {TAG_WORDS})),
list_filter(string_split_regex(regexp_replace(lower({TITLE}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN {TAG_WORDS})))), '|') AS tags FROM pages WHERE regexp_matches(url, '{URL_RE}')"""


@query("manifest_tags", TAGS, PAGES)
def _(p):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.filter(c("url").rlike(URL_RE)).select("page_id", F.array_join(X.manifest_tags(title, c("url")), "|").alias("tags"))


@query("assets_by_tag", f"SELECT page_id FROM ({TAGS}) WHERE len(list_filter(string_split(tags, '|'), lambda t: contains(t, 'exam'))) > 0", PAGES)
def _(p):
    rows = p.filter(c("url").rlike(URL_RE)).select("page_id", X.manifest_tags(F.regexp_extract("html", "<title>([^<]*)</title>", 1), c("url")).alias("tags"))
    return A.assets_by_tag(rows, "EXAM").select("page_id")


_SNIPPET = "html"
for _pattern, _plain in X.SNIPPET:
    _SNIPPET = f"regexp_replace({_SNIPPET}, '{_pattern}', '{_plain.replace(chr(39), chr(39) * 2).replace('$1', chr(92) + '1')}', 'g')"


@query("clean_snippet", f"SELECT page_id, md5(trim({_SNIPPET})) AS snippet FROM pages", PAGES)
def _(p):
    return p.select("page_id", F.md5(X.clean_snippet(c("html")).cast("binary")).alias("snippet"))


_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{'|'.join(parts)}') THEN '{label}'" for parts, label in X.PATH_LABELS)
_FOLDER = r"regexp_extract(lower(url), '([^/]+)/+[^/]*/*$', 1)"


@query("label_from_path", f"SELECT page_id, {_LABEL} WHEN {_FOLDER} <> '' AND {_FOLDER} NOT IN ('downloads', 'images') THEN regexp_replace({_FOLDER}, '[-_]', ' ', 'g') ELSE 'unknown' END AS label FROM pages", PAGES)
def _(p):
    return p.select("page_id", X.label_from_path(c("url")).alias("label"))


@query("prompt_hash", """SELECT p_partkey, CASE WHEN h < 0 THEN '-' ELSE '' END || lower(to_base(abs(h), 36)) AS hash FROM (SELECT p_partkey,
list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name || p_type, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (h * 31 + x + 2147483648 + 137438953472) % 4294967296 - 2147483648) AS h FROM part)""", "part")
def _(p):
    return p.select("p_partkey", X.prompt_hash(F.concat("p_name", "p_type")).alias("hash"))


_BOT = "CASE " + " ".join(f"WHEN contains(lower(html), '{part}') THEN '{reason}'" for part, reason in X.ANTI_BOT) + " WHEN regexp_matches(html, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}]') THEN 'RTL text detected (likely bot redirect page)' WHEN contains(html, 'noscript') AND contains(html, 'meta') AND contains(html, 'refresh') THEN 'Noscript/refresh meta tag detected' END"


@query("anti_bot", f"SELECT page_id, {_BOT} AS reason FROM pages", PAGES)
def _(p):
    return p.select("page_id", X.anti_bot_reason(c("html")).alias("reason"))


@query("spider_urls", r'''SELECT page_id, CASE WHEN length(url) <= 2000 AND NOT regexp_matches(url, '\\u[0-9a-fA-F]{4}') AND NOT contains(url, repeat('"', 3)) THEN replace(replace(url, '\', '\\'), '"', '\"') END AS url FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '\u00e9' WHEN 1 THEN 'a\b"c' WHEN 2 THEN '' ELSE repeat('"', 3) END AS url FROM pages)''', PAGES)
def _(p):
    odd = F.element_at(F.array(F.lit("\\u00e9"), F.lit('a\\b"c'), F.lit(""), F.lit('"""')), (c("page_id") % 4 + 1).cast("int"))
    return p.select("page_id", X.spider_url(F.concat("url", odd)).alias("url"))


_LANGS = ", ".join(f"('{code}', '{name.lower()}')" for code, *names in X.LANGUAGES for name in (code, *names))


@query("resolve_language", f"SELECT doc_id, min(code) AS code FROM documents LEFT JOIN (VALUES {_LANGS}) v(code, name) ON name = lower(lang) GROUP BY doc_id", DOCS)
def _(d):
    return d.select("doc_id", X.resolve_language(F.concat(F.lit(" "), F.upper("lang"))).alias("code"))


@query("pixel_boxes", "SELECT event_id, floor(coalesce(x, 0) / 100 * 640 + 0.5)::BIGINT AS x, greatest(0.0, least(1.0, coalesce(nullif(value, 0), 0.5)))::DOUBLE AS confidence FROM (SELECT event_id, value, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (value % 100) END AS x FROM events)", "events")
def _(e):
    x = F.when(c("event_id") % 9 != 0, c("value") % 100)
    box = X.box_from_percent(x, F.lit(0.0), F.lit(50.0), F.lit(50.0), F.lit(640), F.lit(480))
    return e.select("event_id", F.get(box, F.lit(0)).alias("x"), X.clamp_confidence(c("value")).alias("confidence"))


QA_NAME = r"trim(regexp_replace(regexp_replace(regexp_replace(file_name, '\.[^/.]+$', ''), '[-_]', ' ', 'g'), '\d+$', ''))"


@query("vision_qa", rf"""SELECT id, '<image>' || chr(10) || 'What plant is shown in this image?' AS first, CASE WHEN told THEN 'This appears to be ' || name || '.' WHEN subject <> '' THEN 'This image is from ' || subject || '.' ELSE 'This appears to be a plant.' END AS answer, CASE WHEN subject <> '' THEN 4 ELSE 2 END AS turns
FROM (SELECT *, CASE WHEN told THEN name WHEN length(site) > 2 THEN site ELSE source_page_title END AS subject FROM (SELECT *, length(name) > 2 AND NOT regexp_matches(name, '(?i)^image|img|pic|photo|screenshot$') AS told FROM (SELECT *, {QA_NAME} AS name, trim(string_split_regex(source_page_title, '[|–-]')[1]) AS site FROM ({ASSETS}))))
WHERE local_path IS NOT NULL""", PAGES)
def _(p):
    rows = A.vision_qa(assets_of(p).filter("local_path is not null"), "Plant")
    turn = lambda k: F.get("conversations", F.lit(k))["value"]
    return rows.select("id", turn(0).alias("first"), turn(1).alias("answer"), F.size("conversations").alias("turns"))


@query("segmentation_masks", "SELECT 'a' || page_id AS id, 'm' || k || '.png' AS mask_file, CASE WHEN page_id % 3 = 0 THEN 'own' ELSE 'l' || k END AS label FROM pages, range(0, 2) t(k)", PAGES)
def _(p):
    mask = lambda k: F.struct(F.lit(f"m{k}.png").alias("mask_file"), F.lit(f"l{k}").alias("label"), F.array(F.lit(0.0)).alias("bbox"), F.lit(1.0).alias("confidence"))
    rows = p.select(F.concat(F.lit("a"), c("page_id").cast("string")).alias("id"), F.lit("x").alias("local_path"), F.when(c("page_id") % 3 == 0, "own").otherwise("").alias("label"), F.array(mask(0), mask(1)).alias("masks"))
    return A.segmentation(rows).select("id", "mask_file", "label")


@query("unsupported_files", f"SELECT lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) AS extension, count(*) AS n FROM ({ASSETS}) WHERE lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) NOT IN ('.jpg', '.png') GROUP BY 1", PAGES)
def _(p):
    return A.unsupported_breakdown(assets_of(p), "file_name", [".jpg", ".png"])


@query("image_file_reasons", "SELECT id, CASE WHEN regexp_matches(lower(file_name), '\\.(svg|ico|cur)$') THEN 'junk extension (' || regexp_extract(lower(file_name), '(\\.[^./]+)$', 1) || ')' " + " ".join(f"WHEN regexp_matches(lower(file_name), '{j}') THEN 'junk pattern ({j})'" for j in A.JUNK) + f" WHEN size < 5000 THEN 'too small (' || size || ' < 5000 bytes)' END AS reason FROM ({ASSETS})", PAGES)
def _(p):
    return assets_of(p).select("id", A.image_reason(c("file_name"), c("size")).alias("reason"))


@query("generation_metrics", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures, avg(value) FILTER (WHERE event_type <> 'error') AS mean_ms, '{\"error\":' || count(*) FILTER (WHERE event_type = 'error') || '}' AS errors FROM events", "events")
def _(e):
    return A.generation_metrics(e.select((c("event_type") != "error").alias("ok"), c("value").alias("ms"), c("event_type").alias("error")))


@query("verdict_summary", "SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS nsfw, count(*) FILTER (WHERE event_id % 11 = 0) AS minors, avg(value) AS confidence, avg(value / 2) AS relevance FROM events", "events")
def _(e):
    return A.verdict_summary(e.select((c("event_id") % 3 == 0).alias("nsfw"), (c("event_id") % 11 == 0).alias("minors"), c("value").alias("confidence"), (c("value") / 2).alias("relevance")))


@query("detection_counts", "SELECT count(DISTINCT l_orderkey) AS images, count(DISTINCT l_returnflag) AS classes, count(*) AS annotations FROM lineitem", "lineitem")
def _(i):
    return A.detection_counts(i, "l_orderkey", "l_returnflag")


@query("distinct_labels", "SELECT arg_min(trim(event_type), event_id) AS label FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END AS event_type FROM events) GROUP BY lower(trim(event_type))", "events")
def _(e):
    mixed = e.select("event_id", F.when(c("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type")).alias("label"))
    return A.distinct_labels(mixed, "label", "event_id")


@query("first_downloads", "SELECT url, arg_min('f' || (page_id % 3), page_id) AS format FROM pages GROUP BY url", PAGES)
def _(p):
    files = F.array(F.struct("url", F.concat(F.lit("f"), (c("page_id") % 3).cast("string")).alias("format")))
    return A.first_downloads(p.select("page_id", files.alias("files")), "files", "page_id")


@query("enriched_entries", "SELECT 'entry_' || page_id || '_5' AS id, url AS source_url, 'now' AS scraped_at, page_id % 2 AS depth FROM pages", PAGES)
def _(p):
    return A.enrich(p.withColumn("depth", c("page_id") % 2), "page_id", 5, "now").select("id", "source_url", "scraped_at", "depth")


CLEAN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM (SELECT doc_id, text, lang, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE source END AS source FROM documents)) WHERE r = 1"


def _cleaned(d: DataFrame):
    rows = d.select("doc_id", "text", "lang", F.when(c("doc_id") % 10 == 0, " ").otherwise(c("source")).alias("source"))
    return L.run_cleanup(rows, [c("doc_id")], dedupe=True, dedupe_fields=["text"], validate=True, required=["source"], least=1200, threshold=10.0)


@query("run_cleanup", f"SELECT doc_id FROM ({CLEAN}) WHERE trim(source) <> '' AND length(text) >= 1200 AND length(text) <= 50000", DOCS)
def _(d):
    return _cleaned(d)[0].select("doc_id")


@query("run_cleanup_stats", f"""WITH d AS ({CLEAN}) SELECT 'dedupe' AS stage, (SELECT count(*) FROM documents) AS seen, (SELECT count(*) FROM documents) - (SELECT count(*) FROM d) AS removed
UNION ALL SELECT 'validate', (SELECT count(*) FROM d), (SELECT count(*) FROM d WHERE trim(source) = '' OR source IS NULL)
UNION ALL SELECT 'quality', (SELECT count(*) FROM d WHERE trim(source) <> ''), (SELECT count(*) FROM d WHERE trim(source) <> '' AND (length(text) < 1200 OR length(text) > 50000))""", DOCS)
def _(d):
    return _cleaned(d)[1].select("stage", "seen", "removed")


@query("validate_and_transform", "SELECT event_id, try_cast(v AS BIGINT) AS v FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'x' WHEN event_id % 4 = 1 THEN NULL ELSE event_id::VARCHAR END AS v FROM events) WHERE v IS NULL OR try_cast(v AS BIGINT) IS NOT NULL", "events")
def _(e):
    rows = e.select("event_id", F.when(c("event_id") % 4 == 0, "x").when(c("event_id") % 4 != 1, c("event_id").cast("string")).alias("v"))
    return L.validate_and_transform(rows, {"v": "integer"}, ["event_id"])


@query("record_hash_fields", "SELECT doc_id, sha256(to_json({'lang': lang, 'source': source})) AS hash FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL", DOCS)
def _(d):
    return d.filter("lang is not null and source is not null").select("doc_id", D.record_hash(d, ["source", "lang"]).alias("hash"))


@query("llava_rows", "SELECT p_partkey || '.png' AS image, '<image>' || chr(10) || p_name AS question, p_type AS answer FROM part", "part")
def _(p):
    rows = C.llava(p.select(F.concat(c("p_partkey").cast("string"), F.lit(".png")).alias("image"), c("p_name").alias("question"), c("p_type").alias("answer")))
    turn = lambda k: F.get("conversations", F.lit(k))["value"]
    return rows.select("image", turn(0).alias("question"), turn(1).alias("answer"))


@query("csv_image_rows", "SELECT p_brand, p_partkey || '.png' AS image, 'images/' || p_partkey || '.png' AS image_path FROM part", "part")
def _(p):
    return C.csv_images(p.select("p_brand", F.concat(F.lit("in/"), c("p_partkey").cast("string"), F.lit(".png")).alias("image")), exclude=[]).withColumn("image", F.substring("image", 4, 99))


@query("validate_dates", "SELECT event_id AS index, d AS value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events) WHERE d = 'soon'", "events")
def _(e):
    rows = e.select("event_id", F.when(c("event_id") % 3 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("d"))
    return V.validate_dates(rows, c("event_id"), ["d"]).select("index", "value")


@query("trimmed_records", "SELECT doc_id, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS h FROM documents", DOCS)
def _(d):
    return d.select("doc_id", F.md5(js_trim(c("text")).cast("binary")).alias("h"))


_WORDS = f"string_split_regex({TITLE}, '[\\s|—\\-:,]+')"
_STOP = "(" + ", ".join(f"'{w}'" for w in TAG_STOP_WORDS) + ")"


@query("page_tags", f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(s, lambda x: lower(x)),
list_filter(list_transform({_WORDS}, lambda w: lower(trim(w))), lambda w: length(w) > 3 AND w NOT IN {_STOP})[1:5]))), '|') AS tags FROM ({SEGMENTS}) JOIN pages USING (page_id)""", PAGES)
def _(p):
    return p.filter(U.is_url(c("url"))).select("page_id", F.array_join(F.array_sort(G.url_tags(F.regexp_extract("html", "<title>([^<]*)</title>", 1), c("url"))), "|").alias("tags"))


@query("page_labels", f"SELECT page_id, CASE WHEN len(w) > 0 THEN array_to_string(w[1:3], ' ') ELSE 'uncategorized' END AS label FROM (SELECT page_id, list_filter({_WORDS}, lambda w: length(w) > 3) AS w FROM pages)", PAGES)
def _(p):
    return p.select("page_id", G.label_from_context(F.lit("http://h.example/"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("label"))
