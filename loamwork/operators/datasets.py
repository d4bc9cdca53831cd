"""Vision and audio formats with their files, masks as polygons, and data sets with splits."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.urls import file_extension
from loamwork.operators.formats import FORMATS, class_folder, class_index, coco
from loamwork.operators.profile import features_of, size_category
from loamwork.operators.sample import split as split_rows

# Extensions that folders of images and of audio take.
IMAGES = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp"]
AUDIO = [".mp3", ".wav", ".flac", ".ogg", ".m4a", ".aac"]


def image_folder(df: DataFrame, path: str = "image", label: str = "label", order: str = "id", extensions: list[str] | None = None) -> DataFrame:
    """A row for each file of a known extension: file_name below its class's folder, source path, label, and the record's other
    columns, which go to metadata.csv."""
    known = df.filter(file_extension(F.col(path)).isin(extensions or IMAGES))
    placed = class_folder(known, path, label, order)
    rest = [c for c in df.columns if c not in (path, label, order)]
    return placed.select(F.concat_ws("/", "folder", "file_name").alias("file_name"), F.col(path).alias("source"), F.col(label).alias("label"), *rest)


def audio_folder(df: DataFrame, path: str = "audio", label: str = "label", order: str = "id") -> DataFrame:
    return image_folder(df, path, label, order, AUDIO)


def folder_metadata(rows: DataFrame, path: str) -> None:
    """metadata.csv of an image or audio folder: everything but the source paths."""
    rows.drop("source").write.option("header", True).option("escape", '"').csv(path)


def coco_seg(df: DataFrame, order: str, image: str = "image", label: str = "label", box: str = "bbox") -> tuple[DataFrame, DataFrame, DataFrame]:
    """As coco, with each annotation's mask_file; its area is the record's own, else width times height."""
    images, categories, notes = coco(df, order, image, label, box)
    more = df.select(order, F.col("mask_file"), *([F.col("area").cast("double").alias("_own")] if "area" in df.columns else [F.lit(None).cast("double").alias("_own")]))
    return images, categories, notes.join(more, order).withColumn("area", F.coalesce("_own", "area")).drop("_own")


def polygon_of(mask: np.ndarray, tolerance: float = 1.0) -> list[float]:
    """The outline of a mask as x, y in shares of its size: boundary pixels by angle around their centre, thinned so that no
    pixel left out lies farther than the tolerance from the line."""
    inside = np.pad(mask.astype(bool), 1)
    core = inside[1:-1, 1:-1]
    edge = core & ~(inside[:-2, 1:-1] & inside[2:, 1:-1] & inside[1:-1, :-2] & inside[1:-1, 2:])
    y, x = np.nonzero(edge)
    if len(x) < 3:
        return []
    points = np.stack([x, y], axis=1).astype(float)
    centre = points.mean(axis=0)
    points = points[np.lexsort((np.hypot(*(points - centre).T), np.arctan2(*(points - centre).T[::-1])))]
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    open_runs = [(0, len(points) - 1)]
    while open_runs:
        a, b = open_runs.pop()
        if b - a < 2:
            continue
        line = points[b] - points[a]
        off = points[a + 1 : b] - points[a]
        length = np.hypot(*line)
        far = np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]) / length if length else np.hypot(*off.T)
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            open_runs += [(a, a + 1 + k), (a + 1 + k, b)]
    kept = points[keep]
    return (kept / np.array([mask.shape[1], mask.shape[0]])).ravel().round(6).tolist() if len(kept) >= 3 else []


def mask_polygons(df: DataFrame, mask: str = "mask", width: str = "width", height: str = "height", tolerance: float = 1.0) -> DataFrame:
    """df with polygon: the outline of a mask given as height x width bytes, a byte over 0 being inside; [] where there is none."""

    @F.pandas_udf("array<double>")
    def outline(masks: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([polygon_of(np.frombuffer(m, np.uint8).reshape(h, w) > 0, tolerance) if m is not None and len(m) == w * h else [] for m, w, h in zip(masks, widths, heights)])

    return df.withColumn("polygon", outline(mask, width, height))


def yolo_seg(df: DataFrame, order: str, image: str = "image", label: str = "label", polygon: str = "polygon") -> DataFrame:
    """image and its label lines: class and the points of a polygon of three points or more."""
    good = df.filter(F.size(polygon) >= 6)
    points = F.array_join(F.transform(polygon, lambda v: F.format_string("%.6f", v)), " ")
    rows = good.join(class_index(good, label), label).select(image, order, F.concat_ws(" ", F.col("class_id").cast("string"), points).alias("line"))
    return rows.groupBy(image).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("labels"))


def speech_text(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """audio, text and duration of records with both, an audio extension and, if the known files (path) are given, a file."""
    columns = ["audio", "text", *(["duration"] if "duration" in df.columns else [])]
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = df.select(*columns).filter(~blank("audio") & ~blank("text") & file_extension(F.col("audio")).isin(AUDIO))
    return rows if known is None else rows.join(known.select(F.col("path").alias("audio")).distinct(), "audio", "left_semi")


def llava_turns(df: DataFrame, image: str = "image", conversations: str = "conversations") -> DataFrame:
    """Records that bring conversations of {from, value}: roles named as llava has them, the image token put before the first question."""
    names = F.create_map(*[F.lit(x) for pair in (("user", "human"), ("human", "human"), ("assistant", "gpt"), ("gpt", "gpt"), ("system", "system")) for x in pair])
    named = F.transform(conversations, lambda t: F.struct(F.coalesce(F.try_element_at(names, F.lower(t["from"])), t["from"]).alias("from"), t["value"].alias("value")))
    first = lambda ts: F.coalesce(F.array_min(F.filter(F.transform(ts, lambda t, k: F.when(t["from"] == "human", k)), lambda k: k.isNotNull())), F.lit(-1))
    marked = F.transform(named, lambda t, k: F.when((k == first(named)) & ~t["value"].contains("<image>"), F.struct(t["from"].alias("from"), F.concat(F.lit("<image>\n"), t["value"]).alias("value"))).otherwise(t))
    return df.select(image, marked.alias("conversations"))


def chat_messages(df: DataFrame, key: str, messages: str = "messages", system: str | None = None) -> DataFrame:
    """Records whose messages are ready ({role, content}): roles mapped, empty ones dropped, a system prompt first where none is."""
    names = F.create_map(*[F.lit(x) for pair in (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant")) for x in pair])
    mapped = F.transform(messages, lambda m: F.struct(F.coalesce(F.try_element_at(names, F.lower(m["role"])), m["role"]).alias("role"), m["content"].alias("content")))
    kept = F.filter(mapped, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) != "")
    if system:
        prompt = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
        kept = F.when(F.exists(kept, lambda m: m["role"] == "system"), kept).otherwise(F.concat(prompt, kept))
    return df.select(key, kept.alias("messages")).filter(F.size("messages") > 0)


def write_dataset(df: DataFrame, path: str, order: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), by: list[str] | None = None, kind: str = "parquet") -> DataFrame:
    """A data set in a folder for each split (parquet or json), and its dataset_info as one row of JSON; gives (split, rows)."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"no data set of {kind!r}")
    done = split_rows(df, order, ratios, by)
    done.write.partitionBy("split").format(kind).save(f"{path}/data")
    counts = df.sparkSession.read.format(kind).load(f"{path}/data").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    found = {r["split"]: r["rows"] for r in counts.collect()}  # three at most
    info = {"features": features_of(df.schema), "splits": {k: {"name": k, "num_examples": n} for k, n in sorted(found.items())}, "size_category": size_category(sum(found.values()))}
    df.sparkSession.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.text(f"{path}/dataset_info")
    return counts


def read_dataset(spark: SparkSession, path: str, split: str | None = None, kind: str = "parquet") -> DataFrame:
    rows = spark.read.format(kind).load(f"{path}/data")
    return rows if split is None else rows.filter(F.col("split") == split).drop("split")


for _name, _category, _fn in (("coco-seg", "vision", coco_seg), ("yolo-seg", "vision", yolo_seg), ("imagefolder", "vision", image_folder), ("audiofolder", "audio", audio_folder), ("speech-text", "audio", speech_text), ("datasetdict", "hub", write_dataset), ("parquet", "hub", write_dataset)):
    FORMATS.register(_name, _category, _fn)
