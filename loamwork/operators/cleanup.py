"""The clean-up of a data set as one plan, with counts of what each stage removed; and schemas that validate and convert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.paths import field
from loamwork.functions.text import length_score
from loamwork.operators.dedupe import dedupe_by_url, dedupe_exact
from loamwork.operators.predicate import is_empty

STAGES = ["dedupe", "validate", "validate-files", "quality", "filter-empty"]
# Names of the field that holds a record's content, best first.
CONTENT_FIELDS = ["content", "text", "body", "output", "response", "answer", "description", "message"]


def run_cleanup(
    df: DataFrame, order: list[Column], dedupe: bool = False, dedupe_fields: list[str] | None = None, required: list[str] | None = None, validate: bool = False,
    files: list[str] | None = None, known_files: DataFrame | None = None, least: int | None = None, most: int | None = None, threshold: float | None = None, empty: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(data, stats).  Stages, each only if asked for: dedupe (by URL if a field's name holds 'url'), required fields, file
    references, quality by length, empty values.

    A row is judged by every stage before it goes, so the counts need no second pass over the data: duplicates are found
    first, by one window, and the other stages are columns.  stats has a row for each stage that ran, in order: stage,
    seen, removed.
    """
    rows, before = df, []
    if dedupe:
        urls = [f for f in dedupe_fields or [] if "url" in f]
        rows = dedupe_by_url(df, urls[0], order) if urls else dedupe_exact(df, order, dedupe_fields)
        before.append(("dedupe", df, rows))
    tests: list[tuple[str, Column]] = []
    if validate and required:
        tests.append(("validate", reduce(lambda a, b: a & b, (~is_empty(field(rows, f), True) for f in required))))
    if files and known_files is not None:
        for f in files:
            rows = rows.join(known_files.select(F.col("path").alias(f"_file_{f}")).distinct(), F.col(f) == F.col(f"_file_{f}"), "left")
        tests.append(("validate-files", reduce(lambda a, b: a & b, (is_empty(F.col(f)) | F.col(f"_file_{f}").isNotNull() for f in files))))
    content = next((c for c in CONTENT_FIELDS if c in df.columns), None)
    if (least or most) and threshold and content:
        tests.append(("quality", length_score(F.col(content), least, most)["score"] >= threshold))
    if empty and required:
        tests.append(("filter-empty", reduce(lambda a, b: a & b, (~is_empty(field(rows, f)) for f in required))))
    judged = rows
    fails = F.lit(None).cast("int")
    for k in reversed(range(len(tests))):
        fails = F.when(~F.coalesce(tests[k][1], F.lit(False)), F.lit(k)).otherwise(fails)
    judged = judged.withColumn("_fails", fails)
    data = judged.filter("_fails is null").select(*df.columns)
    counts = judged.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_fails") == k).alias(f"k{k}") for k in range(len(tests))])
    seen = F.col("n")
    parts = []
    for k, (name, _) in enumerate(tests):
        parts.append(F.struct(F.lit(STAGES.index(name)).alias("at"), F.lit(name).alias("stage"), seen.alias("seen"), F.col(f"k{k}").alias("removed")))
        seen = seen - F.col(f"k{k}")
    empty_stats = "at int, stage string, seen long, removed long"
    stats = counts.select(F.explode(F.array(*parts)).alias("s")).select("s.*") if parts else df.sparkSession.createDataFrame([], empty_stats)
    for name, old, new in before:
        both = old.agg(F.count(F.lit(1)).alias("seen")).crossJoin(new.agg(F.count(F.lit(1)).alias("_left")))  # one row each
        stats = both.select(F.lit(STAGES.index(name)).alias("at"), F.lit(name).alias("stage"), "seen", (F.col("seen") - F.col("_left")).alias("removed")).union(stats)
    return data, stats


def validate_and_transform(df: DataFrame, types: dict[str, str], required: list[str] | None = None) -> DataFrame:
    """Rows whose columns can be read as the given types (string, number, integer, boolean), converted; a required column must
    hold something.  Columns that are not named stay."""
    kinds = {"string": "string", "number": "double", "integer": "long", "boolean": "boolean"}
    unknown = set(types.values()) - set(kinds)
    if unknown:
        raise ValueError(f"unknown types: {sorted(unknown)}")
    read = {c: F.col(f"`{c}`").try_cast(kinds[t]) for c, t in types.items()}
    good = [F.col(f"`{c}`").isNull() | v.isNotNull() for c, v in read.items()] + [~is_empty(F.col(f"`{c}`"), True) for c in required or []]
    return df.filter(reduce(lambda a, b: a & b, good, F.lit(True))).withColumns(read)


def json_schema(df: DataFrame) -> dict:
    """A JSON schema of the records: types of the columns; required are those without a null."""
    names = {"string": "string", "integer": "integer", "long": "integer", "double": "number", "float": "number", "boolean": "boolean", "array": "array", "struct": "object"}
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(str(k)) for k, c in enumerate(df.columns)], F.count(F.lit(1)).alias("n")).first()
    return {"type": "object", "properties": {f.name: {"type": names.get(f.dataType.typeName(), "string")} for f in df.schema.fields}, "required": [c for k, c in enumerate(df.columns) if nulls["n"] and nulls[str(k)] == 0]}


