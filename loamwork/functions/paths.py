"""Dot paths with array indices (a.b[0].c) and field-map templates, compiled to Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def field(df: DataFrame, path: str) -> Column:
    """The value at a path; null where any step is missing, whatever the rows hold."""
    column, kind = None, df.schema
    for name, index in _STEP.findall(path):
        if index:
            if not isinstance(kind, ArrayType):
                return F.lit(None).cast("string")
            column, kind = F.get(column, F.lit(int(index))), kind.elementType
        else:
            if not isinstance(kind, StructType) or name not in kind.fieldNames():
                return F.lit(None).cast("string")
            column = F.col(f"`{name}`") if column is None else column.getField(name)
            kind = kind[name].dataType
    return F.lit(None).cast("string") if column is None else column


def set_field(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with the value at a path of struct fields, made where they are missing."""
    first, *rest = path.split(".")
    if not rest:
        return df.withColumn(first, value)
    if first in df.columns and isinstance(df.schema[first].dataType, StructType) and rest[0] in df.schema[first].dataType.fieldNames() or first in df.columns and len(rest) == 1:
        return df.withColumn(first, F.col(first).withField(".".join(rest), value))
    made = value
    for name in reversed(rest[1:]):
        made = F.struct(made.alias(name))
    if first in df.columns:
        return df.withColumn(first, F.col(first).withField(rest[0], made))
    return df.withColumn(first, F.struct(made.alias(rest[0])))


def render(df: DataFrame, template: str) -> Column:
    """The template with each {{path}} replaced by its value as text; missing values are empty."""
    out, at = [], 0
    for m in re.finditer(r"\{\{\s*([^}]+?)\s*\}\}", template):
        if m.start() > at:
            out.append(F.lit(template[at : m.start()]))
        value = field(df, m.group(1))
        out.append(F.coalesce(value.cast("string"), F.lit("")))
        at = m.end()
    if at < len(template) or not out:
        out.append(F.lit(template[at:]))
    return F.concat(*out)


def apply_field_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Only the mapped fields, all texts; an empty map leaves df as it is."""
    return df.select(*[render(df, t).alias(name) for name, t in mapping.items()]) if mapping else df


def parse_field_map(text: str) -> dict[str, str]:
    """k:v,k:v with each v taken as a template."""
    return dict(pair.split(":", 1) for pair in text.split(",") if ":" in pair)


def flatten(df: DataFrame) -> DataFrame:
    """Struct members as columns named a.b; arrays and maps as JSON texts; empty structs vanish."""

    def walk(kind: StructType, prefix: list[str]):
        for f in kind.fields:
            at = [*prefix, f.name]
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, at)
            else:
                column = F.col(".".join(f"`{x}`" for x in at))
                yield (F.to_json(column) if f.dataType.typeName() in ("array", "map") else column).alias(".".join(at))

    return df.select(*walk(df.schema, []))
