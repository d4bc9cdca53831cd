"""Shared helpers of the training-data operators.

Input convention: an operator reads the columns it names (``doc_id``, ``text``,
...) and ignores any others, whatever they are called; a null text counts as the
empty text unless the operator says otherwise; a null doc_id is kept as null.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in one Arrow batch handed to Python; with the byte bound below it limits a worker's memory.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small: texts may be long, and a worker holds a whole batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.isModifiable(_BATCH_BYTES):
        spark.conf.set(_BATCH_BYTES, str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, set as the context's checkpoint folder.

    Where that is unset (tests on one machine) a fresh local folder is set; a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loamwork-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that lost executors cost nothing.

    The shuffle files of the plan go as soon as it is written: else they lie there until the driver's next full garbage
    collection, and a query of many small steps leaves more of them, in blocks of the disk, than its data take.
    """
    conf = df.sparkSession.conf
    shared_folder(df.sparkSession)
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        alone = df.select("*")  # a plan of its own, so that nothing else reads its files
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return alone.checkpoint(eager=True)


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., dict], schema: str) -> DataFrame:
    """mapInArrow over the named columns: fn gets one list for each and returns lists by output column."""
    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(*(batch.column(c).to_pylist() for c in columns)), schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def crc32_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo modulus."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))
