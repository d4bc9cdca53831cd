"""Criteria with and/or/not, and record validators that give error rows.

Logic is two-valued: a missing value makes a criterion false, so its negation is true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.paths import field
from loamwork.functions.text import js_number, js_trim


def criterion(value: Column, spec: dict) -> Column:
    """All of exists, equals, contains, matches, greaterThan, lessThan and in that the spec names, for one value."""
    text = value.cast("string")
    tests = {
        "exists": lambda x: value.isNotNull() if x else value.isNull(),
        "equals": lambda x: value == F.lit(x),
        "contains": lambda x: F.lower(text).contains(str(x).lower()),
        "matches": lambda x: text.rlike(x),
        "greaterThan": lambda x: js_number(text) > float(x),
        "lessThan": lambda x: js_number(text) < float(x),
        "in": lambda x: value.isin(list(x)),
    }
    unknown = set(spec) - set(tests)
    if unknown:
        raise ValueError(f"unknown criteria: {sorted(unknown)}")
    parts = [F.coalesce(tests[k](v), F.lit(False)) for k, v in spec.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def expression(df: DataFrame, tree: dict) -> Column:
    """{"and": [...]}, {"or": [...]}, {"not": ...} or {"field": path, criteria...}; an empty and holds, an empty or does not."""
    if "and" in tree:
        return reduce(lambda a, b: a & b, (expression(df, t) for t in tree["and"]), F.lit(True))
    if "or" in tree:
        return reduce(lambda a, b: a | b, (expression(df, t) for t in tree["or"]), F.lit(False))
    if "not" in tree:
        return ~expression(df, tree["not"])
    return criterion(field(df, tree["field"]), {k: v for k, v in tree.items() if k != "field"})


def filter_by_criteria(df: DataFrame, path: str, spec: dict) -> DataFrame:
    return df.filter(criterion(field(df, path), spec))


def filter_by_expression(df: DataFrame, tree: dict) -> DataFrame:
    return df.filter(expression(df, tree))


def is_empty(value: Column, trim: bool = False) -> Column:
    text = value.cast("string")
    return value.isNull() | ((js_trim(text) if trim else text) == "")


def remove_empty(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """With fields: rows where each holds something; without: rows where any column does."""
    if fields:
        return df.filter(reduce(lambda a, b: a & b, (~is_empty(field(df, f)) for f in fields)))
    return df.filter(reduce(lambda a, b: a | b, (~is_empty(F.col(f"`{c}`")) for c in df.columns)))


def errors(df: DataFrame, index: Column, checks: list[tuple[str, Column, str]]) -> DataFrame:
    """A row (index, field, message, value) for each failed check; checks are (path, failed, message)."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(index.cast("long").alias("index"), F.lit(path).alias("field"), F.lit(message).alias("message"), field(df, path).cast("string").alias("value"))) for path, bad, message in checks]
    return df.select(F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e")).select("e.*")


def validate_required(df: DataFrame, index: Column, fields: list[str], trim: bool = True) -> DataFrame:
    return errors(df, index, [(f, is_empty(field(df, f), trim), f"Required field '{f}' is missing or empty") for f in fields])


def validate_ranges(df: DataFrame, index: Column, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    checks = []
    for f, (low, high) in ranges.items():
        v = field(df, f)
        n = js_number(v.cast("string"))
        checks.append((f, v.isNotNull() & n.isNull(), "Value is not a number"))
        if low is not None:
            checks.append((f, n < low, f"Value is below minimum {low}"))
        if high is not None:
            checks.append((f, n > high, f"Value is above maximum {high}"))
    return errors(df, index, checks)


EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*:\S"


def validate_emails(df: DataFrame, index: Column, fields: list[str]) -> DataFrame:
    return errors(df, index, [(f, ~is_empty(field(df, f)) & ~field(df, f).rlike(EMAIL), "Invalid email address") for f in fields])


def validate_urls(df: DataFrame, index: Column, fields: list[str]) -> DataFrame:
    return errors(df, index, [(f, ~is_empty(field(df, f)) & ~field(df, f).rlike(URL), "Invalid URL") for f in fields])


def validate_dates(df: DataFrame, index: Column, fields: list[str], kind: str = "iso") -> DataFrame:
    bad = (lambda v: js_number(v.cast("string")).isNull()) if kind == "timestamp" else (lambda v: v.cast("string").try_cast("timestamp").isNull())
    return errors(df, index, [(f, ~is_empty(field(df, f)) & bad(field(df, f)), "Invalid date") for f in fields])


def validate_types(df: DataFrame, index: Column, types: dict[str, str]) -> DataFrame:
    """Text columns against string, number, boolean, date, email or url; nulls pass."""
    tests = {
        "string": lambda v: F.lit(False), "number": lambda v: v.cast("string").try_cast("double").isNull(),
        "boolean": lambda v: ~F.lower(v.cast("string")).isin("true", "false"), "date": lambda v: v.cast("string").try_cast("timestamp").isNull(),
        "email": lambda v: ~v.cast("string").rlike(EMAIL), "url": lambda v: ~v.cast("string").rlike(URL),
    }
    return errors(df, index, [(f, field(df, f).isNotNull() & tests[t](field(df, f)), f"Expected {t}") for f, t in types.items()])


def validate_references(df: DataFrame, index: Column, path: str, files: DataFrame, name: str = "path") -> DataFrame:
    """Rows whose file, where given, is not among the listed files: an anti-join."""
    value = field(df, path).cast("string")
    rows = df.select(index.cast("long").alias("index"), value.alias("value")).filter(~is_empty(F.col("value")))
    listed = files.select(F.col(name).alias("value")).distinct()
    return rows.join(listed, "value", "left_anti").select("index", F.lit(path).alias("field"), F.lit("File not found").alias("message"), "value")


def report(df: DataFrame, found: DataFrame, shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """(one row of total, invalid and valid rows; the first errors, at most ``shown``)."""
    bad = found.agg(F.countDistinct("index").alias("invalid"))
    counts = df.agg(F.count(F.lit(1)).alias("total")).join(F.broadcast(bad), F.lit(True))
    return counts.select("total", "invalid", (F.col("total") - F.col("invalid")).alias("valid")), found.orderBy("index", "field").limit(shown)
