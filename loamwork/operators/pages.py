"""Scraped pages and assets: filters with reasons, links between them, and the templates that make records of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork.functions import text as T
from loamwork.functions import urls as U
from loamwork.operators.sample import place_by_number

# Parts of names that mark an asset as junk, and extensions that do.
JUNK = [
    "icon", "logo", "favicon", "loading", "spinner", "avatar", "badge", "banner", "ad[_-]", "tracking", "pixel", "beacon",
    "analytics", "social", "share", "like", "tweet", "facebook", "instagram", "linkedin", "pinterest", "thumb", "thumbnail",
    "placeholder", "dummy", "sample", "test", "temp", "cache",
]
JUNK_EXTENSIONS = [".svg", ".ico", ".cur"]


def page_reason(url: Column, title: Column, text: Column, least: int = 50, most: int = 10000) -> Column:
    """Why a page is refused, the first reason that holds; null for a good page."""
    t = T.js_trim(F.coalesce(text, F.lit("")))
    n = F.length(t)
    words = T.count_matches(t, r"\w") / F.greatest(n, F.lit(1)).cast("double")
    return (
        F.when(~F.coalesce(url.startswith("http"), F.lit(False)), "invalid_url")
        .when(F.length(T.js_trim(F.coalesce(title, F.lit("")))) < 3, "invalid_title")
        .when(F.coalesce(text, F.lit("")) == "", "missing_text")
        .when(n < least, "text_too_short")
        .when((n > most) if most > 0 else F.lit(False), "text_too_long")
        .when(words < F.lit(0.3), "low_word_ratio")
    )


def junk_asset(name: Column, url: Column, size: Column, alt: Column) -> Column:
    pattern = "(?i)" + "|".join(JUNK)
    n = F.lower(F.coalesce(name, F.lit("")))
    ext = U.file_extension(n)
    hit = lambda c: F.coalesce(c.rlike(pattern), F.lit(False))
    return (size < 5000) | ext.isin(JUNK_EXTENSIONS) | (n.endswith(".gif") & (size < 50000)) | hit(n) | hit(url) | hit(alt)


def link_assets(assets: DataFrame, pages: DataFrame) -> DataFrame:
    """Each asset with its page: equal URL but for scheme, www, query and last slash (the last such page), else the
    first page with the same path.  A left join; pages are made unique by key before, so no asset is repeated."""
    keyed = pages.select(U.link_key(F.col("source_url")).alias("_key"), U.path(F.col("source_url")).alias("_path"), "page_id", "title", "text")
    by_key = keyed.groupBy("_key").agg(F.max_by(F.struct("page_id", "title", "text"), "page_id").alias("_a"))
    by_path = keyed.filter("_path != '/'").groupBy("_path").agg(F.min_by(F.struct("page_id", "title", "text"), "page_id").alias("_b"))
    rows = assets.withColumn("_key", U.link_key(F.col("source_page_url"))).withColumn("_path", U.path(F.col("source_page_url")))
    joined = rows.join(by_key, "_key", "left").join(by_path, "_path", "left")
    return joined.select(*assets.columns, F.coalesce("_a", "_b").alias("page"))


def asset_context(alt: Column, text: Column, title: Column, around: int = 200) -> Column:
    """struct(surrounding, hint): the text around the alt text's first place, and the title with the text's start."""
    at = F.position(F.lower(alt), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    near = F.when((at > 0) & (F.length(alt) > 0), F.substring(text, start, at - start + F.length(alt) + around))
    return F.struct(near.alias("surrounding"), F.concat_ws(". ", title, F.substring(text, 1, 500)).alias("hint"))


def merge_manifests(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: the newest row of each key at the place where the key first stood (by the number order), ids renumbered."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(key)
    latest = both.withColumn("_first", F.min(F.struct("_src", order)).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_src"), F.desc(order)))).filter("_rank = 1")
    firsts = latest.withColumns({"_from": F.col("_first._src"), "_at": F.col("_first").getField(order)}).drop("_first", "_rank", "_src")
    placed = place_by_number(firsts, F.col("_at"), "_place", major=F.col("_from"))
    return placed.withColumn("asset_id", F.concat(F.lit("asset_"), (F.col("_place") + 1).cast("string"))).drop("_from", "_at", "_place")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def url_tags(title: Column, url: Column) -> Column:
    """Path segments and up to five title words over three letters that are no stop words, in order, once each."""
    words = F.filter(F.transform(T.title_words(title), lambda w: F.lower(F.trim(w))), lambda w: (F.length(w) > 3) & ~w.isin(T.TAG_STOP_WORDS))
    return F.array_distinct(F.concat(F.transform(U.path_words(url), F.lower), F.slice(words, 1, 5)))


def label_from_context(url: Column, title: Column, target: str | None = None) -> Column:
    """The last two path segments, else three title words over three letters, else the target, else 'uncategorized'."""
    segments = U.path_words(url)
    words = F.slice(F.filter(T.title_words(F.coalesce(title, F.lit(""))), lambda w: F.length(w) > 3), 1, 3)
    last = F.when(F.size(segments) > 1, F.slice(segments, -2, 2)).otherwise(segments)
    return F.when(F.size(segments) > 0, F.array_join(last, " ")).when(F.size(words) > 0, F.array_join(words, " ")).otherwise(target or "uncategorized")


def _good_pages(pages: DataFrame, least: int, most: int) -> DataFrame:
    return pages.filter(page_reason(F.col("source_url"), F.col("title"), F.col("text"), least, most).isNull()).withColumn("text", T.remove_boilerplate(F.col("text")))


def raw_extract(pages: DataFrame, least: int = 50, most: int = 10000) -> DataFrame:
    good = _good_pages(pages, least, most)
    return good.filter(T.is_valid_content(F.col("text"), least, most)).select("id", "source_url", "title", "text")


def text_instruct(pages: DataFrame, least: int = 50, most: int = 10000) -> DataFrame:
    good = _good_pages(pages, least, most)
    out = good.select("id", F.concat(F.lit("Summarize "), F.col("title")).alias("instruction"), F.lit("").alias("input"), F.substring("text", 1, 1000).alias("output"))
    return out.filter((F.length("instruction") > 5) & (F.length("output") > 50))


def text_qa(pages: DataFrame, least: int = 50, most: int = 10000) -> DataFrame:
    good = _good_pages(pages, least, most).select("id", T.question_pair(F.col("title"), F.col("text")).alias("q"))
    return good.select("id", "q.instruction", F.lit("").alias("input"), "q.output").filter((F.length(F.trim("instruction")) > 10) & (F.length(F.trim("output")) > 20))


def text_conversation(pages: DataFrame, least: int = 50, most: int = 10000) -> DataFrame:
    good = _good_pages(pages, least, most)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    out = good.select("id", F.array(turn("user", F.concat(F.lit("Tell me about "), F.col("title"))), turn("assistant", F.substring("text", 1, 1000))).alias("messages"))
    return out.filter(F.forall("messages", lambda m: F.length(m["content"]) > 10))


def image_captioning(assets: DataFrame) -> DataFrame:
    return assets.select("id", F.col("local_path").alias("image"), F.coalesce("alt_text", F.lit("")).alias("caption")).filter(F.length(F.trim("caption")) > 5)


def image_classification(assets: DataFrame, target: str | None = None, threshold: float = 0.5) -> DataFrame:
    label = label_from_context(F.col("source_url"), F.col("source_page_title"), target)
    rows = assets.select("id", F.col("local_path").alias("image"), label.alias("label"))
    score = F.when(F.lower("label").contains((target or "").lower()), 0.8).otherwise(0.3) if target else F.lit(0.5)
    scored = rows.withColumn("relevance", score)
    return scored.filter(F.col("relevance") >= threshold) if target else scored


def audio_classification(assets: DataFrame, target: str | None = None) -> DataFrame:
    return assets.select("id", F.col("local_path").alias("audio"), label_from_context(F.col("source_url"), F.col("source_page_title"), target).alias("label"))


def object_detection(assets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each detected object of enough confidence; an image without any gets a box of the whole image."""
    whole = F.array(F.struct(F.lit("object").alias("label"), F.array(*[F.lit(float(v)) for v in (0, 0, 640, 480)]).alias("bbox"), F.lit(1.0).alias("confidence")))
    found = F.when(F.size(F.coalesce("objects", F.array().cast(assets.schema["objects"].dataType))) > 0, F.col("objects")).otherwise(whole)
    return assets.select("id", F.col("local_path").alias("image"), F.explode(found).alias("o")).filter(F.col("o.confidence") >= threshold).select("id", "image", "o.label", "o.bbox", "o.confidence")


TEMPLATES = {
    "raw-extract": raw_extract, "text-instruct": text_instruct, "text-qa": text_qa, "text-conversation": text_conversation, "image-captioning": image_captioning,
    "image-classification": image_classification, "audio-classification": audio_classification, "object-detection": object_detection,
}
