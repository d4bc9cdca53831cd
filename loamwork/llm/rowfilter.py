"""A bit filter that keeps rows out of an exchange.

It has no false negatives: a row it refuses is surely not among the keys.  Its size follows the number of keys, 16
bits each, between 2 ** LEAST and 2 ** MOST bits (32 MB).  Past some 100 million keys it lets more and more rows
through, and the join that follows gives the same result at the cost of moving them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loamwork.llm.common import bounded_batches

LEAST, MOST = 20, 28
_BLOCK = 1 << 16


def place_of(columns: list[str], bits: np.ndarray) -> Column:
    """Where the filter has a row's bit."""
    return F.pmod(F.xxhash64(*columns), F.lit(8 * len(bits)))


def filter_of(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """The filter of the rows' columns.  Blocks of bits are gathered by Spark and meet at the driver; rows is read twice."""

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BLOCK, dtype=np.uint8)
        for b in batches:
            bits[b.column("at").to_numpy()] = 1
        yield pa.RecordBatch.from_pydict({"block": [key[0].as_py()], "bits": [np.packbits(bits).tobytes()]}, schema=pa.schema([("block", pa.int64()), ("bits", pa.binary())]))

    size = min(MOST, max(LEAST, math.ceil(math.log2(16 * max(1, rows.count())))))
    out = np.zeros((1 << size) // 8, dtype=np.uint8)
    place = place_of(columns, out)
    parts = rows.select(F.floor(place / _BLOCK).alias("block"), F.pmod(place, F.lit(_BLOCK)).alias("at")).distinct().groupBy("block").applyInArrow(gather, "block long, bits binary").toLocalIterator()
    for r in parts:
        out[r["block"] * _BLOCK // 8 : (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_be_in(rows: DataFrame, columns: list[str], bits: np.ndarray) -> DataFrame:
    """rows with _in: false only for rows that are surely not in the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def has(at: pd.Series) -> pd.Series:
        a = at.to_numpy()
        return pd.Series((shared.value[a >> 3] >> (7 - (a & 7)) & 1).astype(bool))

    return rows.withColumn("_in", has(place_of(columns, bits)))


def map_filtered(df: DataFrame, key: list[str], bits: np.ndarray, inside: bool, columns: list[str], fn: Callable[..., dict], schema: str) -> DataFrame:
    """map_rows() over the rows that pass the filter, or over the others, in one Python worker a task."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(bits)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(columns)).to_numpy()
            hits = np.flatnonzero((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) == inside)
            if len(hits):
                own = batch.take(pa.array(hits))
                yield pa.RecordBatch.from_pydict(fn(*(own.column(c).to_pylist() for c in columns)), schema=arrow)

    return df.select(*columns, place_of(key, bits).alias("_at")).mapInArrow(run, schema)


def anti_join(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """rows whose columns are not among the keys, of which only rows that pass the filter move."""
    split = may_be_in(rows, columns, filter_of(keys, columns))
    return split.filter("not _in").drop("_in").unionByName(split.filter("_in").drop("_in").join(keys, columns, "left_anti"))
