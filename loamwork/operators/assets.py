"""Assets of a manifest: filters with a decision log, look-ups, image files, and counts of what a transform did."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.urls import file_extension
from loamwork.operators.pages import JUNK, JUNK_EXTENSIONS, junk_asset

IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg", ".ico", ".cur"]


def asset_reason(assets: DataFrame, exclude_junk: bool = True) -> Column:
    """Why an asset goes, the first reason that holds; null for one that stays."""
    out = F.when(~F.coalesce(F.col("status") == "completed", F.lit(False)), F.concat(F.lit("failed_status: "), F.coalesce("status", F.lit("undefined"))))
    out = out.when(F.coalesce("local_path", F.lit("")) == "", "missing_local_path")
    if exclude_junk:
        out = out.when(F.coalesce(junk_asset(F.col("file_name"), F.col("source_url"), F.col("size"), F.col("alt_text")), F.lit(False)), "junk_pattern_matched")
    return out


def filter_assets(assets: DataFrame, exclude_junk: bool = True) -> DataFrame:
    return assets.filter(asset_reason(assets, exclude_junk).isNull())


def decision_log(rows: DataFrame, key: str, stage: str, reason: Column, passed: str = "passed_all_filters") -> DataFrame:
    """record_id, stage, action (keep or drop) and reason of each row: what is written beside a result as JSON lines."""
    why = rows.select(F.col(key).cast("string").alias("record_id"), F.lit(stage).alias("stage"), reason.alias("_reason"))
    return why.select("record_id", "stage", F.when(F.col("_reason").isNull(), "keep").otherwise("drop").alias("action"), F.coalesce("_reason", F.lit(passed)).alias("reason"))


def valid_assets(assets: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Completed assets with a local path, of a type that holds one of the kinds."""
    good = assets.filter((F.col("status") == "completed") & (F.coalesce("local_path", F.lit("")) != ""))
    return good.filter(F.lower("file_type").rlike("|".join(kinds))) if kinds else good


def asset_paths(assets: DataFrame, base: str) -> DataFrame:
    """id and path below a folder of completed assets; an absolute path stays."""
    path = F.when(F.col("local_path").startswith("/"), F.col("local_path")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.col("local_path")))
    return valid_assets(assets).select("id", path.alias("path"))


def assets_by_tag(assets: DataFrame, tag: str) -> DataFrame:
    return assets.filter(F.exists("tags", lambda t: F.lower(t).contains(tag.lower())))


def asset_by_id(assets: DataFrame, key: str) -> DataFrame:
    return assets.filter(F.col("id") == key).limit(1)


def image_size(content: Column) -> Column:
    """Kind, width and height from a file's header: PNG, JPEG, WebP, GIF and BMP; nulls for any other."""

    @F.pandas_udf("struct<kind:string,width:long,height:long>")
    def read(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_size(b) for b in contents], columns=["kind", "width", "height"]).astype({"width": "Int64", "height": "Int64"})

    return read(content)


def _size(b: bytes | None) -> tuple[str | None, int | None, int | None]:
    none = (None, None, None)
    if not b or len(b) < 24:
        return none
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return ("png", *struct.unpack(">II", b[16:24]))
    if b[:4] == b"GIF8":
        return ("gif", *struct.unpack("<HH", b[6:10]))
    if b[:2] == b"BM" and len(b) >= 26:
        width, height = struct.unpack("<ii", b[18:26])
        return "bmp", width, abs(height)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return _webp_size(b)
    return _jpeg_size(b) if b[:2] == b"\xff\xd8" else none


def _webp_size(b: bytes):
    if b[12:16] == b"VP8X" and len(b) >= 30:
        return "webp", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if b[12:16] == b"VP8L" and len(b) >= 25:
        n = int.from_bytes(b[21:25], "little")
        return "webp", (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1
    if b[12:16] == b"VP8 " and len(b) >= 30:
        return "webp", int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF
    return None, None, None


def _jpeg_size(b: bytes):
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            at += 1
        elif b[at + 1] in (0xFF, 0x01, *range(0xD0, 0xDA)):  # fill bytes and marks without a length
            at += 1 if b[at + 1] == 0xFF else 2
        elif 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return "jpeg", width, height
        else:
            at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None, None, None


def image_reason(name: Column, size: Column, remove_junk: bool = True, least_size: int | None = None, dims: Column | None = None, least: tuple[int, int] | None = None) -> Column:
    """Why an image file goes: a junk extension, a junk name, too few bytes, too small; null for one that stays."""
    n = F.lower(name)
    out = F.when(F.lit(False), "")
    if remove_junk:
        out = out.when(file_extension(n).isin(JUNK_EXTENSIONS), F.concat(F.lit("junk extension ("), file_extension(n), F.lit(")")))
        for part in JUNK:
            out = out.when(n.rlike(part), f"junk pattern ({part})")
    bound = 5000 if remove_junk and least_size is None else least_size
    if bound is not None:
        words = ("too small (", "") if least_size is None else ("below min size (", "")
        out = out.when(size < bound, F.concat(F.lit(words[0]), size.cast("string"), F.lit(f" < {bound} bytes)")))
    if least is not None and dims is not None:
        small = (dims["width"] < least[0]) | (dims["height"] < least[1])
        out = out.when(small, F.concat(F.lit("below min dimensions ("), dims["width"].cast("string"), F.lit("x"), dims["height"].cast("string"), F.lit(f" < {least[0]}x{least[1]})")))
    return out


def unsupported_breakdown(names: DataFrame, name: str, supported: list[str]) -> DataFrame:
    """extension and n of files of no supported extension, most first."""
    ext = F.coalesce(F.nullif(file_extension(F.col(name)), F.lit("")), F.lit("none"))
    return names.select(ext.alias("extension")).filter(~F.col("extension").isin(supported)).groupBy("extension").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension")


def transform_stats(log: DataFrame) -> DataFrame:
    """One row of a decision log: records seen, kept, dropped, and the share kept."""
    kept = F.count_if(F.col("action") == "keep")
    seen = F.count(F.lit(1))
    return log.agg(seen.alias("seen"), kept.alias("kept"), (seen - kept).alias("dropped"), F.coalesce(kept / F.nullif(seen, F.lit(0)), F.lit(0.0)).alias("rate"))


def generation_metrics(results: DataFrame) -> DataFrame:
    """One row of results (ok, ms, error): total, successes, failures, mean time of the successes, failures by kind as JSON."""
    kinds = results.filter("not ok").groupBy(F.coalesce("error", F.lit("unknown")).alias("e")).agg(F.count(F.lit(1)).alias("k"))
    by = kinds.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "k"))))).alias("errors"))  # kinds of errors are few
    ok = F.count_if("ok")
    return results.agg(F.count(F.lit(1)).alias("total"), ok.alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.avg(F.when(F.col("ok"), F.col("ms"))).alias("mean_ms")).crossJoin(by)  # one row each


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """One row of image verdicts (nsfw, minors, confidence, relevance)."""
    return verdicts.agg(F.count_if("nsfw").alias("nsfw"), F.count_if("minors").alias("minors"), F.avg("confidence").alias("confidence"), F.avg("relevance").alias("relevance"))


def detection_counts(boxes: DataFrame, image: str = "image", label: str = "label") -> DataFrame:
    return boxes.agg(F.count_distinct(image).alias("images"), F.count_distinct(label).alias("classes"), F.count(F.lit(1)).alias("annotations"))


def distinct_labels(labels: DataFrame, label: str, order: str) -> DataFrame:
    """The first spelling of each label, whatever its case and outer blanks, by first sight."""
    key = F.lower(F.trim(label))
    return labels.filter(F.trim(label) != "").groupBy(key.alias("_key")).agg(F.min(F.struct(order, F.trim(label).alias("label"))).alias("_f")).select("_f.label")


def first_downloads(items: DataFrame, files: str, order: str) -> DataFrame:
    """Each URL of the items' files (array of url, format) once, with the format that came first."""
    rows = items.select(order, F.posexplode(files).alias("_at", "_f")).filter(F.coalesce("_f.url", F.lit("")) != "")
    return rows.groupBy("_f.url").agg(F.min(F.struct(order, "_at", F.col("_f.format").alias("format"))).alias("_m")).select("url", "_m.format")


def enrich(items: DataFrame, index: str, stamp: int, at: str) -> DataFrame:
    """Items with id, source_url, scraped_at, depth and source_chain; what an item has of its own stays."""
    own = lambda name, value: F.coalesce(F.col(name), value) if name in items.columns else value
    return items.withColumns({
        "id": own("id", F.concat(F.lit("entry_"), F.col(index).cast("string"), F.lit(f"_{stamp}"))), "source_url": own("source_url", F.coalesce("url", F.lit(""))),
        "scraped_at": own("scraped_at", F.lit(at)), "depth": own("depth", F.lit(0)), "source_chain": own("source_chain", F.array().cast("array<string>")),
    })


def vision_qa(assets: DataFrame, target: str | None = None) -> DataFrame:
    """image and conversations: an image's questions and answers in turn, the image token before the first; one row an image."""
    from loamwork.functions.scalars import contextual_qa

    qa = contextual_qa(F.col("file_name"), F.col("source_page_title"), F.col("alt_text"), F.col("source_url"), target)
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    turns = F.flatten(F.transform(qa, lambda x, k: F.array(turn("human", F.concat(F.when(k == 0, "<image>\n").otherwise(""), x["question"])), turn("gpt", x["answer"]))))
    first = assets.groupBy("local_path").agg(F.min("id").alias("id"))  # the same image once
    return assets.join(first, ["local_path", "id"]).select("id", F.col("local_path").alias("image"), turns.alias("conversations"))


def segmentation(assets: DataFrame, label: str | None = None) -> DataFrame:
    """A row for each mask of an image (masks: array of mask_file, label, bbox, confidence); a label of the image's own overrides."""
    rows = assets.select("id", F.col("local_path").alias("image"), *([F.col("label").alias("_own")] if "label" in assets.columns else [F.lit(label).alias("_own")]), F.explode("masks").alias("m"))
    return rows.select("id", "image", "m.mask_file", F.coalesce(F.nullif(F.col("_own"), F.lit("")), F.col("m.label")).alias("label"), "m.bbox", "m.confidence")
