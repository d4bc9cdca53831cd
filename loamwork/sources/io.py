"""Readers and writers by type or extension, directory conventions, previews, browsing and prune lists."""

from __future__ import annotations

import json
import os
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators.sample import place_by_number
from loamwork.sources.html import html_records

EXTENSIONS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xml": "xml", "xlsx": "xlsx", "txt": "txt", "html": "html", "htm": "html", "parquet": "parquet"}
# Names that stand for a folder's data, best first.
WELL_KNOWN = ["data.jsonl", "data.json", "dataset.jsonl", "dataset.json", "train.jsonl", "train.json", "output.jsonl", "output.json", "scraped_data.jsonl", "scraped_data.json", "data.csv", "data.parquet"]


def kind_of(path: str, kind: str = "auto") -> str:
    if kind != "auto":
        if kind not in EXTENSIONS.values():
            raise ValueError(f"unsupported type {kind!r}")
        return kind
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"no reader for {path!r}")
    return EXTENSIONS[ext]


def resolve_folder(spark: SparkSession, path: str) -> str:
    """The first well-known file of a folder, through Spark's own file system; a file stays itself."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        for name in WELL_KNOWN:
            if fs.exists(hadoop.Path(at, name)):
                return f"{path.rstrip('/')}/{name}"
    return path


def read_any(spark: SparkSession, path: str, kind: str = "auto", delimiter: str = ",", dialect: str = "quoted", row_tag: str = "row") -> DataFrame:
    """Records of a file or folder.

    csv: quoted (header, all texts, trimmed), typed (types inferred) or naive (lines split at the delimiter, quotes kept).
    json: an array or one object; jsonl: a bad line raises.  txt: line numbers over lines that are not blank.
    """
    kind = kind_of(path, kind)
    if kind == "csv" and dialect == "naive":
        lines = spark.read.text(path).filter(F.trim("value") != "")
        # the header is the first line of the first file, and only there a header
        lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
        header = lines.groupBy("_file").agg(F.min("_at").alias("_at"), F.min_by("value", "_at").alias("value")).orderBy("_file").first()
        names = [n.strip() for n in header["value"].split(delimiter)] if header else []
        parts = F.split("value", f"\\Q{delimiter}\\E")
        return lines.filter((F.col("_file") != (header["_file"] if header else "")) | (F.col("_at") != (header["_at"] if header else -1))).select(*[F.trim(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(names)]) if names else lines.select()
    if kind == "csv":
        reader = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        return reader.csv(path, inferSchema=dialect == "typed")
    if kind == "json":
        return spark.read.json(path, multiLine=True)
    if kind == "jsonl":
        return spark.read.json(path, mode="FAILFAST")
    if kind == "xml":
        return spark.read.format("xml").option("rowTag", row_tag).load(path)
    if kind == "txt":
        lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("_row", F.monotonically_increasing_id())
        return place_by_number(lines, F.col("_row")).select((F.col("_place") + 1).cast("int").alias("line"), F.trim("value").alias("text"))
    if kind == "html":
        pages = spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("page_id"), F.col("value").alias("html"))
        return html_records(pages)
    if kind == "xlsx":
        return read_xlsx(spark, path)
    return spark.read.parquet(path)


def _sheet_rows(content: bytes) -> list[list[str | None]]:
    import io

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{ns}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{ns}c"):
                letters = "".join(x for x in c.get("r", "A") if x.isalpha())
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                value = c.find(f"{ns}v")
                text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{ns}t")) or None
                cells[column - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of one workbook, its first row as header; all texts.  The file comes through Spark's reader."""
    rows = _sheet_rows(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    header, *body = rows or [[]]
    names = [str(h) if h is not None else f"column_{k + 1}" for k, h in enumerate(header)]
    return spark.createDataFrame([[*r, *[None] * (len(names) - len(r))][: len(names)] for r in body], ", ".join(f"`{n}` string" for n in names))


def write_any(df: DataFrame, path: str, kind: str = "auto", pretty: bool = False) -> None:
    """A folder of parts by type; json is one array, and so for small results only."""
    kind = kind_of(path, kind)
    if kind == "csv":
        df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "jsonl":
        df.write.json(path)
    elif kind == "json":
        rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).toLocalIterator()]
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False, indent=2 if pretty else None)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"no writer for {kind!r}")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split, so that readers of one prune the others."""
    df.write.partitionBy(split).parquet(path)


def for_columnar(df: DataFrame, preserve_nulls: bool = False) -> DataFrame:
    """Nested columns as JSON texts; unless nulls are preserved, they become '', 0 or false."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("struct", "array", "map"):
            c, kind = F.to_json(c), "string"
        if not preserve_nulls:
            empty = {"string": "", "boolean": False}.get(kind, 0)
            c = F.coalesce(c, F.lit(empty)) if kind in ("string", "boolean", "integer", "long", "double", "float", "short", "byte") else c
        out.append(c.alias(f.name))
    return df.select(*out)


def browse(df: DataFrame, search: str | None = None, sort: str | None = None, page: int = 1, page_size: int = 50, tie: list[str] | None = None) -> DataFrame:
    """One page of rows: rows where any column holds the term, whatever its case; by [-]column, nulls last either way."""
    if search:
        term = search.lower()
        found = F.lit(False)
        for c in df.columns:
            found = found | F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(term), F.lit(False))
        df = df.filter(found)
    if sort:
        name = sort.lstrip("-")
        df = df.orderBy(F.col(name).desc_nulls_last() if sort.startswith("-") else F.col(name).asc_nulls_last(), *(tie or []))
    size = min(500, max(1, page_size))
    return df.offset((max(1, page) - 1) * size).limit(size)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size and time of files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def prunable(files: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Files older than so many days; 0 means all."""
    return files if days == 0 else files.filter(F.col("modified") < (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)))


def magic_kind(content: Column) -> Column:
    """The kind of a file by its first bytes."""
    starts = lambda h, n: F.hex(F.substring(content, 1, n)) == h
    return (
        F.when(starts("25504446", 4), "pdf").when(starts("504B0304", 4), "zip").when(starts("89504E470D0A1A0A", 8), "png").when(starts("FFD8FF", 3), "jpeg")
        .when(starts("47494638", 4), "gif").when(starts("424D", 2), "bmp").when(starts("52494646", 4) & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
    )


WORDS = {"name": ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gus", "Hana"], "city": ["Arden", "Brook", "Crest", "Dale", "Elm", "Ford"], "noun": ["lamp", "chair", "table", "clock", "mug", "bag", "shelf"]}


def synthetic(spark: SparkSession, kind: str, n: int, seed: int = 0) -> DataFrame:
    """n made-up rows of person, address, company, product, text or lorem; the same for the same seed."""
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    number = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    if kind not in ("person", "address", "company", "product", "text", "lorem"):
        raise ValueError(f"nothing is made up of kind {kind!r}")
    rows = spark.range(n)
    if kind == "address":
        return rows.select("id", F.concat_ws(" ", number("no", 200).cast("string"), pick(WORDS["city"], "street"), F.lit("Street")).alias("street"), pick(WORDS["city"], "city").alias("city"))
    if kind == "company":
        return rows.select("id", F.concat_ws(" ", pick(WORDS["city"], "c"), pick(WORDS["noun"], "n"), F.lit("Ltd")).alias("name"))
    if kind == "product":
        return rows.select("id", pick(WORDS["noun"], "p").alias("name"), (number("price", 10000) / F.lit(100.0)).alias("price"))
    if kind in ("text", "lorem"):
        words = sum(WORDS.values(), [])
        return rows.select("id", F.array_join(F.array(*[F.lower(pick(words, f"w{k}")) for k in range(12)]), " ").alias("text"))
    return rows.select("id", pick(WORDS["name"], "first").alias("first_name"), pick(WORDS["city"], "last").alias("last_name"), (number("age", 60) + 18).alias("age"))
