"""Profiles: field statistics, schemas, dataset information, quality distribution, decision summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType


def field_statistics(df: DataFrame) -> DataFrame:
    """A row for each column: field, kind, non_null, nulls, and least, most and mean of lengths (texts) or values (numbers).

    One aggregate over all columns, then turned into rows.
    """
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text, number = isinstance(f.dataType, StringType), f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")
        v = (F.length(c) if text else c).cast("double") if text or number else F.lit(None).cast("double")
        kind = "string" if text else "number" if number else f.dataType.typeName()
        parts.append(F.struct(F.lit(f.name).alias("field"), F.lit(kind).alias("kind"), F.count(c).alias("non_null"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def dataset_info(df: DataFrame, size: Column, split: str = "split") -> DataFrame:
    """Rows and bytes of each split, and of all under null: a rollup."""
    return df.withColumn("_size", size.cast("long")).rollup(split).agg(F.count(F.lit(1)).alias("num_examples"), F.coalesce(F.sum("_size"), F.lit(0)).alias("num_bytes"))


def quality_distribution(scores: DataFrame, score: str) -> DataFrame:
    """Counts of five buckets of scores, zeros included."""
    names = ["1-3", "4-5", "6-7", "8-9", "10"]
    s = F.col(score)
    bucket = F.when(s <= 3, names[0]).when(s <= 5, names[1]).when(s <= 7, names[2]).when(s <= 9, names[3]).otherwise(names[4])
    one = scores.agg(*[F.count_if(bucket == n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n")) for n in names])).alias("b")).select("b.*")


def combined_quality(scores: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean, rounded, between 1 and 10; 0 for no scores."""
    weights = weights or [1.0] * len(scores)
    if not scores:
        return F.lit(0)
    total = sum((s * F.lit(float(w)) for s, w in zip(scores, weights)), F.lit(0.0))
    return F.greatest(F.lit(1), F.least(F.lit(10), F.floor(total / F.lit(float(sum(weights))) + F.lit(0.5)).cast("int")))


def decision_summary(log: DataFrame) -> DataFrame:
    """Counts by stage and action, by stage, and of all: a rollup of a decision log."""
    return log.rollup("stage", "action").agg(F.count(F.lit(1)).alias("n"))


def features_of(kind: DataType):
    """A Spark type as a feature description of training-data hubs."""
    names = {"string": "string", "integer": "int32", "long": "int64", "float": "float32", "double": "float64", "boolean": "bool", "binary": "binary"}
    if isinstance(kind, StructType):
        return {f.name: features_of(f.dataType) for f in kind.fields}
    if isinstance(kind, ArrayType):
        return {"_type": "Sequence", "feature": features_of(kind.elementType)}
    return {"_type": "Value", "dtype": names.get(kind.typeName(), "string")}


def number_kind(df: DataFrame, column: str) -> str:
    """int32, int64, float32 or float64: the narrowest that holds every value."""
    v = F.col(f"`{column}`").cast("double")
    r = df.agg(F.bool_and(v == F.floor(v)).alias("whole"), F.min(v).alias("a"), F.max(v).alias("b"), F.bool_and(F.abs(v - v.cast("float").cast("double")) <= 1e-7 * F.abs(v)).alias("single")).first()
    if r["whole"]:
        return "int32" if -(2**31) <= r["a"] and r["b"] < 2**31 else "int64"
    return "float32" if r["single"] else "float64"


def size_category(n: int) -> str:
    for most, name in ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"), (10_000_000, "1M<n<10M")):
        if n < most:
            return name
    return "n>10M"


def dataset_card(df: DataFrame, name: str, split: str | None = None) -> str:
    """A README with front matter and a table of splits, from one aggregate."""
    counts = {r[0]: r[1] for r in df.groupBy(split).count().collect()} if split else {"train": df.count()}
    rows = "\n".join(f"| {k} | {v} |" for k, v in sorted(counts.items()))
    return f"---\npretty_name: {name}\nsize_categories:\n- {size_category(sum(counts.values()))}\n---\n\n# {name}\n\n| split | rows |\n|---|---|\n{rows}\n\n```json\n{json.dumps(features_of(df.schema), indent=2)}\n```\n"
