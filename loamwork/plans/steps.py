"""A pipeline of JSON steps as one DataFrame plan: each step maps the data it is given to the next."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.paths import apply_field_map, flatten
from loamwork.functions.text import fold_newlines, js_trim
from loamwork.operators.dedupe import dedupe_exact
from loamwork.operators.formats import FORMATS
from loamwork.operators.predicate import filter_by_expression, remove_empty
from loamwork.sources.io import read_any, synthetic, write_any

TYPES = ("generate", "import", "clean", "filter", "map", "export", "format")


def clean_record(df: DataFrame, trim: bool = True, lowercase: bool = False) -> DataFrame:
    """Texts with plain newlines, trimmed and perhaps in lower case; column names trimmed; empty texts null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "string":
            c = fold_newlines(c)
            c = js_trim(c) if trim else c
            c = F.nullif(F.lower(c) if lowercase else c, F.lit(""))
        out.append(c.alias(f.name.strip()))
    return df.select(*out)


def parse(text: str) -> list[dict]:
    config = json.loads(text)
    steps = config.get("steps")
    if not isinstance(steps, list) or not steps:
        raise ValueError("a pipeline needs steps")
    for k, step in enumerate(steps):
        if step.get("type") not in TYPES:
            raise ValueError(f"step {k}: unknown type {step.get('type')!r}")
    return steps


def run(spark: SparkSession, config: str) -> DataFrame:
    data: DataFrame | None = None
    for k, step in enumerate(parse(config)):
        kind, o = step["type"], step.get("options", {})
        if kind == "generate":
            data = synthetic(spark, o.get("kind", "person"), int(o.get("count", 10)), int(o.get("seed", 0)))
            continue
        if kind == "import" or (data is None and "input" in o):
            data = read_any(spark, o["input"], o.get("type", "auto"))
            if kind == "import":
                continue
        if data is None:
            raise ValueError(f"step {k} has no data: start with generate or import")
        if kind == "clean":
            data = remove_empty(clean_record(data, lowercase=bool(o.get("lowercase", False))))
            if o.get("dedupe", True):
                data = dedupe_exact(data, [F.monotonically_increasing_id()], o.get("fields"))
        elif kind == "filter":
            data = filter_by_expression(data, o["where"])
        elif kind == "map":
            data = apply_field_map(data, o["fields"])
        elif kind == "format":
            data = FORMATS.get(o["format"])(data, **o.get("settings", {}))
        else:
            write_any(flatten(data) if o.get("flatten") else data, o["output"], o.get("type", "auto"))
    return data
