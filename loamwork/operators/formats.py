"""Training formats as (DataFrame, options) -> DataFrame, and a registry of them.

Chats are built by collecting a conversation's messages with their order; a conversation is one training row, so
its messages are meant to be together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork.functions.text import first_truthy
from loamwork.functions.urls import base_name, file_extension
from loamwork.operators.sample import place_by_number

# Names of roles in chats, and what they become.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
SHAREGPT = {"user": "human", "assistant": "gpt", "system": "system"}
OASST = {"user": "prompter", "human": "prompter", "assistant": "assistant", "gpt": "assistant", "system": "prompter"}


def _column(df: DataFrame, *names: str) -> Column:
    """The first name that holds something; '' for none."""
    return first_truthy(*[F.col(n) for n in names if n in df.columns]) if any(n in df.columns for n in names) else F.lit("")


def role_of(role: Column, names: dict[str, str]) -> Column:
    out = role
    for k, v in names.items():
        out = F.when(F.lower(role) == k, v).otherwise(out)
    return out


def alpaca(df: DataFrame, default_input: str = "", include_empty_input: bool = True) -> DataFrame:
    """instruction, input, output; rows without an instruction or output go."""
    given = _column(df, "input")
    value = F.when(given == "", default_input).otherwise(given)
    if not include_empty_input:
        value = F.nullif(value, F.lit(""))
    out = df.select(_column(df, "instruction").alias("instruction"), value.alias("input"), _column(df, "output").alias("output"))
    return out.filter((F.trim("instruction") != "") & (F.trim("output") != ""))


def raw(df: DataFrame) -> DataFrame:
    return df.select(_column(df, "prompt", "instruction", "input").alias("prompt"), _column(df, "completion", "output", "response").alias("completion"))


def _turns(df: DataFrame, conversation: str, turn: str, role: Column, text: str, names: tuple[str, str]) -> DataFrame:
    message = F.struct(F.col(turn).alias("_turn"), role.alias(names[0]), F.col(text).alias(names[1]))
    ordered = F.array_sort(F.collect_list(message))
    return df.groupBy(conversation).agg(F.transform(ordered, lambda m: F.struct(m[names[0]].alias(names[0]), m[names[1]].alias(names[1]))).alias("turns"))


def chatml(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str | None = None) -> DataFrame:
    """messages of {role, content} by conversation; a system prompt comes first where a conversation has none."""
    out = _turns(df, conversation, turn, role_of(F.col(role), ROLES), text, ("role", "content"))
    messages = F.col("turns")
    if system:
        messages = F.when(F.get(messages, F.lit(0))["role"] == "system", messages).otherwise(F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), messages))
    return out.select(conversation, messages.alias("messages"))


def sharegpt(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversations of {from, value}."""
    return _turns(df, conversation, turn, role_of(F.col(role), SHAREGPT), text, ("from", "value")).select(conversation, F.col("turns").alias("conversations"))


def oasst(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """message_id, parent_id, role, text: each message answers the one before; empty texts go, their places stay."""
    w = W.partitionBy(conversation).orderBy(turn)
    named = df.withColumn("message_id", F.concat(F.col(conversation).cast("string"), F.lit("_"), (F.row_number().over(w) - 1).cast("string")))
    kept = named.filter(F.coalesce(F.trim(text), F.lit("")) != "")
    return kept.select("message_id", F.lag("message_id").over(w).alias("parent_id"), role_of(F.col(role), OASST).alias("role"), F.col(text).alias("text"))


def llava(df: DataFrame) -> DataFrame:
    """image and conversations with the image token before the first question."""
    ask, answer = _column(df, "instruction", "question", "prompt"), _column(df, "output", "answer", "response")
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return df.select("image", F.array(turn("human", F.concat(F.lit("<image>\n"), ask)), turn("gpt", answer)).alias("conversations"))


def first_seen_ids(df: DataFrame, key: str, order: str, name: str, start: int) -> DataFrame:
    """A dense id for each key in order of first sight, order being a number.  The ranking is over distinct keys alone."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    return place_by_number(firsts, F.col("_first"), name).withColumn(name, F.col(name).cast("int") + start).drop("_first")


def coco(df: DataFrame, order: str, image: str = "image", label: str = "label", box: str = "bbox") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, categories, annotations) with ids in order of first sight; area is width times height."""
    images = first_seen_ids(df, image, order, "image_id", 1)
    categories = first_seen_ids(df, label, order, "category_id", 1)
    sized = df.groupBy(image).agg(F.min_by("width", order).alias("width"), F.min_by("height", order).alias("height")).join(images, image) if {"width", "height"} <= set(df.columns) else images
    b = lambda k: F.get(box, F.lit(k)).cast("double")
    notes = df.join(images, image).join(categories, label)
    return sized, categories, notes.select(F.col(order), "image_id", "category_id", F.col(box), (b(2) * b(3)).alias("area"))


def class_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Classes in order of name, from 0: classes are a dimension, few beside the rows."""
    return df.select(label).distinct().filter(F.col(label).isNotNull()).withColumn("class_id", F.row_number().over(W.orderBy(label)) - 1)


def yolo(df: DataFrame, order: str, image: str = "image", label: str = "label", box: str = "bbox") -> DataFrame:
    """image and its label lines: class and centre, width and height in shares of the image, six decimals."""
    b = lambda k: F.get(box, F.lit(k)).cast("double")
    big = F.array_max(F.transform(box, lambda x: x.cast("double"))) > 1
    shares = [(b(0) + b(2) / 2) / F.col("width"), (b(1) + b(3) / 2) / F.col("height"), b(2) / F.col("width"), b(3) / F.col("height")]
    values = [F.when(big, s).otherwise(b(k)) for k, s in enumerate(shares)]
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("class_id"), *values)
    rows = df.join(class_index(df, label), label).select(image, order, line.alias("line"))
    return rows.groupBy(image).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("labels"))


def collision_names(df: DataFrame, folder: Column, path: str, order: str) -> DataFrame:
    """file_name, made unique within a folder by _1, _2, ... before the extension."""
    name = base_name(F.col(path))
    ext = file_extension(name)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    tail = F.substring(name, F.length(stem) + 1, F.length(ext))
    k = F.row_number().over(W.partitionBy(folder, name).orderBy(order)) - 1
    return df.withColumn("file_name", F.when(k > 0, F.concat(stem, F.lit("_"), k.cast("string"), tail)).otherwise(name))


def class_folder(df: DataFrame, path: str, label: str, order: str) -> DataFrame:
    """folder (the label, made safe) and file_name of image or audio folders."""
    folder = F.lower(F.regexp_replace(F.coalesce(F.col(label).cast("string"), F.lit("unknown")), r"[^A-Za-z0-9_-]", "_"))
    return collision_names(df.withColumn("folder", folder), F.col("folder"), path, order)


def csv_images(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    keep = [c for c in (include or df.columns) if c not in (exclude or [])]
    return df.select(*keep, F.concat(F.lit("images/"), base_name(F.col("image"))).alias("image_path"))


class Registry:
    """Named formats; a later registration replaces an earlier one."""

    def __init__(self):
        self._formats: dict[str, tuple[str, Callable]] = {}

    def register(self, name: str, category: str, fn: Callable) -> None:
        self._formats[name] = (category, fn)

    def unregister(self, name: str) -> bool:
        return self._formats.pop(name, None) is not None

    def get(self, name: str) -> Callable:
        if name not in self._formats:
            raise KeyError(f"unknown format {name!r}; known: {', '.join(self.names())}")
        return self._formats[name][1]

    def has(self, name: str) -> bool:
        return name in self._formats

    def names(self) -> list[str]:
        return sorted(self._formats)

    def by_category(self, category: str) -> list[str]:
        return sorted(n for n, (c, _) in self._formats.items() if c == category)

    def clear(self) -> None:
        self._formats.clear()

    def count(self) -> int:
        return len(self._formats)


FORMATS = Registry()
for _name, _category, _fn in (
    ("alpaca", "text", alpaca), ("raw", "text", raw), ("chatml", "text", chatml), ("sharegpt", "text", sharegpt), ("oasst", "text", oasst),
    ("llava", "vision", llava), ("coco", "vision", coco), ("yolo", "vision", yolo), ("csv-images", "vision", csv_images),
):
    FORMATS.register(_name, _category, _fn)
