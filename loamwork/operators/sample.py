"""Splits and samples that can be repeated: order by md5(seed:key), exact sizes.

Sizes come from counts, and each row's place from a rank within its hash bucket plus the counts of the buckets
before, so no global sort runs in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def place(df: DataFrame, key: Column, name: str = "_place", by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """df with each row's place (from 0) by a hexadecimal key, within the columns ``by`` if given.

    Rows are ranked inside buckets of the key's first digits; a table of 16 ** digits rows for each group adds the
    counts of the buckets before.
    """
    by = by or []
    rows = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    sizes = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by, F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    joined = rows.join(before, [*by, "_bucket"]) if not by else _null_safe(rows, before, [*by, "_bucket"])
    rank = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_key"))
    return joined.withColumn(name, F.col("_before") + rank - 1).drop("_key", "_bucket", "_before")


def place_by_number(df: DataFrame, number: Column, name: str = "_place", then: list[Column] | None = None, major: Column | None = None) -> DataFrame:
    """df with each row's place (from 0) in the order of major, number and then; nulls first.

    Buckets are ranges of the numbers between approximate quantiles, about as many rows each, so no task sorts the table;
    a table of the buckets' counts, which are set by spark.sql.shuffle.partitions, gives what stands before each.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_number", number).withColumn("_major", major if major is not None else F.lit(0))
    cuts = sorted(set(rows.select(F.col("_number").cast("double").alias("x")).approxQuantile("x", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col("_number"))) if cuts else F.lit(0)
    rows = rows.withColumn("_bucket", F.when(F.col("_number").isNull(), -1).otherwise(at))
    sizes = rows.groupBy("_major", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_major", "_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(W.partitionBy("_major", "_bucket").orderBy("_number", *(then or [])))
    return rows.join(F.broadcast(before), ["_major", "_bucket"]).withColumn(name, F.col("_before") + rank - 1).drop("_number", "_major", "_bucket", "_before")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 0.001:
        raise ValueError(f"ratios must not be negative and must sum to 1, not {ratios}")


def parse_ratios(text: str) -> tuple[float, float, float]:
    """'80:10:10' or '.8:.1:.1'; a sum over 50 means percent."""
    parts = [float(p) for p in text.split(":")]
    if len(parts) != 3:
        raise ValueError(f"three ratios are needed, not {text!r}")
    scale = 100.0 if sum(parts) > 50 else 1.0
    out = tuple(p / scale for p in parts)
    check_ratios(out)
    return out


def split(df: DataFrame, order: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), by: list[str] | None = None, numeric: bool = False) -> DataFrame:
    """df with split: floor(n * train) rows of train, floor(n * validation) of validation, the rest test, by the order: a
    hexadecimal key, or a number."""
    check_ratios(ratios)
    by = by or []
    if numeric and by:
        raise ValueError("classes are split by a hexadecimal key")
    placed = place_by_number(df, order) if numeric else place(df, order, by=by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    joined = _null_safe(placed, sizes, by) if by else placed.join(F.broadcast(sizes), F.lit(True))
    train = F.floor(F.col("_total") * F.lit(float(ratios[0])))
    valid = F.floor(F.col("_total") * F.lit(float(ratios[1])))
    return joined.withColumn("split", F.when(F.col("_place") < train, "train").when(F.col("_place") < train + valid, "validation").otherwise("test")).drop("_place", "_total")


def stratified_split(df: DataFrame, stratum: Column, order: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """split() within each class; a missing class is 'unknown'."""
    rows = df.withColumn("_class", F.coalesce(F.nullif(stratum.cast("string"), F.lit("")), F.lit("unknown")))
    return split(rows, order, ratios, by=["_class"]).drop("_class")


def sample(df: DataFrame, n: int, key: Column, seed: int | str) -> DataFrame:
    """n rows, or all if there are fewer."""
    return df.orderBy(hash_order(key, seed)).limit(n)


def evenly_spaced(df: DataFrame, number: Column, n: int) -> DataFrame:
    """The rows at floor(i * rows / n) in the order of a number, for i from 0 to n - 1."""
    total = df.count()
    at = df.sparkSession.range(n).select(F.floor(F.col("id") * F.lit(total) / F.lit(float(n))).alias("_place")).distinct()
    return place_by_number(df, number).join(F.broadcast(at), "_place").drop("_place")


def sample_stratified(df: DataFrame, stratum: str, n: int, key: Column, seed: int | str, allocation: str = "equal") -> DataFrame:
    """equal: n / groups rows of each group, one more of the first n % groups (by value), at most all, nothing moved
    on; proportional: each group's share of n, rounded down."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.count(F.lit(1)).alias("_groups"), F.sum("_size").alias("_rows"))
    ranked = sizes.withColumn("_g", F.row_number().over(W.orderBy(stratum)) - 1).join(F.broadcast(total), F.lit(True))
    equal = F.floor(F.lit(n) / F.col("_groups")) + (F.col("_g") < F.lit(n) % F.col("_groups")).cast("int")
    quota = equal if allocation == "equal" else F.floor(F.lit(float(n)) * F.col("_size") / F.col("_rows"))
    limits = ranked.select(stratum, quota.alias("_quota"))
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(key, seed)))
    return _null_safe(df.withColumn("_rank", rank).filter(F.col("_rank") <= n), limits, [stratum]).filter("_rank <= _quota").drop("_rank", "_quota")


def balance(df: DataFrame, column: str, most: int, order: list[Column]) -> DataFrame:
    """The first ``most`` rows of each value."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(column).orderBy(*order))).filter(F.col("_rank") <= most).drop("_rank")


def xorshift(seed: int):
    """The 32-bit generator with shifts 13, 17 and 5, as numbers in [0, 1); seed 0 stays at 0."""
    state = seed & 0xFFFFFFFF
    while True:
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        yield state / 4294967296


def xorshift_permutation(n: int, seed: int) -> np.ndarray:
    """Fisher and Yates's shuffle of range(n) by xorshift: sequential by nature, so for tables that fit the driver."""
    out, numbers = np.arange(n), xorshift(seed)
    for i in range(n - 1, 0, -1):
        j = int(next(numbers) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def split_compatible(df: DataFrame, order: list[Column], seed: int, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), most: int = 5_000_000) -> DataFrame:
    """Splits row for row like the sequential shuffle.  Only for at most ``most`` rows: the permutation is made on the driver."""
    check_ratios(ratios)
    n = df.count()
    if n > most:
        raise ValueError(f"the sequential shuffle takes at most {most} rows; split() takes any number")
    train, valid = int(n * ratios[0]), int(n * ratios[1])
    names = np.where(np.arange(n) < train, "train", np.where(np.arange(n) < train + valid, "validation", "test"))
    order_of = xorshift_permutation(n, seed)
    table = df.sparkSession.createDataFrame([(int(row), str(name)) for row, name in zip(order_of, names)], "_row long, split string")
    return df.withColumn("_row", (F.row_number().over(W.orderBy(*order)) - 1).cast("long")).join(table, "_row").drop("_row")
