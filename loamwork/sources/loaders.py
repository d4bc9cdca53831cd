"""Loaders that find out what they are given: sniffed JSON, folders of a task, manifests, previews, numbered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators.sample import place
from loamwork.sources.io import kind_of, read_any, resolve_folder


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """JSON records: one array if the first sign of the first file that is not blank is '[', else JSON lines."""
    starts = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at"))
    first = starts.groupBy("f").agg(F.min_by(F.substring(F.trim("value"), 1, 1), "at").alias("sign")).orderBy("f").first()
    return spark.read.json(path, multiLine=True) if first and first["sign"] == "[" else read_any(spark, path, "jsonl")


def read_numbered(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """JSON lines with file, line (from 1, blank lines counted) and record; a line that is no JSON has error instead.

    Lines are numbered by file: a file is split over tasks, whose lines are counted first, so no task gets them all.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    keyed = place(lines, F.lpad(F.hex("at"), 16, "0"), "_place", ["file"], digits=11)  # the task's number: eleven digits
    numbered = keyed.select("file", (F.col("_place") + 1 + start).cast("long").alias("line"), F.col("value").alias("record"))
    parsed = numbered.filter(F.trim("record") != "").withColumn("_v", F.try_parse_json("record"))
    return parsed.select("file", "line", F.when(F.col("_v").isNotNull(), F.col("record")).alias("record"), F.when(F.col("_v").isNull(), F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(": not JSON"))).alias("error"))


def load_task(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What a task's folder holds, by name: data (its best-known file), pages (scraped_data) and assets (manifest)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    has = lambda name: fs.exists(hadoop.Path(folder, name))
    out = {}
    for name, files in (("pages", ("scraped_data.jsonl", "scraped_data.json")), ("assets", ("manifest.jsonl", "asset_manifest.json", "manifest.json"))):
        if (found := next((f for f in files if has(f)), None)) is not None:
            rows = read_sniffed(spark, f"{folder.rstrip('/')}/{found}")
            out[name] = rows.select(F.explode("assets").alias("a")).select("a.*") if name == "assets" and "assets" in rows.columns else rows
    if (data := resolve_folder(spark, folder)) != folder:
        out["data"] = read_any(spark, data)
    if not out:
        raise ValueError(f"{folder!r} holds no data that is known")
    return out


def auto_load(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file, or of a folder's best-known file; JSON is sniffed."""
    at = resolve_folder(spark, path)
    return read_sniffed(spark, at) if kind_of(at) in ("json", "jsonl") else read_any(spark, at)


def preview(spark: SparkSession, path: str, rows: int = 10) -> tuple[DataFrame, int]:
    """The first rows of a file, and how many it has about: its bytes by those of the rows seen."""
    df = auto_load(spark, path)
    size = spark.read.format("binaryFile").load(resolve_folder(spark, path)).agg(F.sum("length")).first()[0] or 0
    seen = df.limit(rows).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*"))) + 1).alias("bytes")).first()
    return df.limit(rows), max(seen["n"], round(size * seen["n"] / seen["bytes"])) if seen["bytes"] else 0


def record_at(df: DataFrame, index: int, order: str) -> DataFrame:
    """The record at an index from 0."""
    return df.orderBy(order).offset(max(0, index)).limit(1)


def union_of_keys(records: DataFrame, text: str) -> DataFrame:
    """JSON object texts as one table with every key that any of them has, in order of name; values as texts."""
    parsed = records.select(F.from_json(text, "map<string,string>").alias("m"))
    keys = [r["k"] for r in parsed.select(F.explode(F.map_keys("m")).alias("k")).distinct().orderBy("k").toLocalIterator()]  # a table's columns
    return parsed.select(*[F.try_element_at("m", F.lit(k)).alias(k) for k in keys])
