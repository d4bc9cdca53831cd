"""Keep-first duplicates removal.  "First" is by an explicit order; Spark's own dropDuplicates has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork.functions.paths import field
from loamwork.functions.urls import clean_url, search_key


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each distinct key, nulls equal to each other.

    The ranking window keeps one row a task before the exchange (a limit of 1 on its rank), so hot keys stay cheap.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def record_hash(df: DataFrame, fields: list[str] | None = None) -> Column:
    """SHA-256 of the record's JSON with sorted keys; nulls are left out."""
    names = sorted(fields or df.columns)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).cast("binary"), 256)


def dedupe_exact(df: DataFrame, order: list[Column], fields: list[str] | None = None) -> DataFrame:
    """The first of equal records, or of records equal in the fields."""
    return keep_first(df, [field(df, f) for f in fields] if fields else [record_hash(df)], order)


def dedupe_by_url(df: DataFrame, url: str, order: list[Column], normalize: bool = True) -> DataFrame:
    """The first of each URL's normal form; rows without a URL go."""
    value = field(df, url)
    rows = df.filter(value.isNotNull() & (value != ""))
    return keep_first(rows, [clean_url(value) if normalize else value], order)


def dedupe_by_prefix(df: DataFrame, key: Column, order: list[Column], n: int = 24) -> DataFrame:
    """Compatible with keys cut to their first characters."""
    return keep_first(df, [F.substring(key, 1, n)], order)


def duplicate_groups(df: DataFrame, key: Column, index: Column) -> DataFrame:
    """key, size and indices (sorted) of each key of several rows."""
    rows = df.select(key.alias("key"), index.alias("index"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(several, "key").groupBy("key").agg(F.max("size").alias("size"), F.array_sort(F.collect_list("index")).alias("indices"))


def content_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def duplicate_content(df: DataFrame, text: str) -> DataFrame:
    """One row: total, rows in groups of several, and their share."""
    groups = df.groupBy(content_key(F.col(text)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))
    return sums.withColumn("rate", F.when(F.col("total") > 0, F.col("duplicates") / F.col("total").cast("double")).otherwise(F.lit(0.0)))


def merge_rank(hits: DataFrame, boost: float = 0.15) -> DataFrame:
    """Search hits (url, title, snippet, provider, score, _row) merged by URL and ranked.

    The score is the best one, plus the boost for each further provider, at most 1.  Title and snippet are the
    first hit's, replaced by longer ones of hits that beat the score so far.  Providers join in order of first
    sight.  Hits of one URL are few (a hit for each provider), so a fold over them is bounded.
    """
    hit = F.struct("_row", "title", "snippet", "provider", F.coalesce("score", F.lit(0.0)).alias("score"))
    groups = hits.groupBy(search_key(F.col("url")).alias("key")).agg(F.array_sort(F.collect_list(hit)).alias("h"), F.min_by("url", "_row").alias("url"))
    state = lambda t, s, b: F.struct(t.alias("title"), s.alias("snippet"), b.alias("score"))
    longer = lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)

    def fold(acc: Column, x: Column) -> Column:
        better = x["score"] > acc["score"]
        return state(F.when(better, longer(acc["title"], x["title"])).otherwise(acc["title"]), F.when(better, longer(acc["snippet"], x["snippet"])).otherwise(acc["snippet"]), F.when(better, x["score"]).otherwise(acc["score"]))

    first = F.get("h", F.lit(0))
    merged = F.aggregate(F.slice("h", F.lit(2), F.size("h")), state(first["title"], first["snippet"], first["score"]), fold)
    providers = F.array_distinct(F.transform(F.filter("h", lambda x: x["provider"].isNotNull()), lambda x: x["provider"]))
    out = groups.select("url", merged.alias("m"), providers.alias("p"))
    score = F.least(F.lit(1.0), F.col("m.score") + F.greatest(F.size("p") - 1, F.lit(0)) * F.lit(boost))
    return out.select("url", F.col("m.title").alias("title"), F.col("m.snippet").alias("snippet"), F.array_join("p", "+").alias("provider"), score.alias("score"))


def duplicates_of(df: DataFrame, key: Column, path: str) -> DataFrame:
    """Each row with the earlier paths of the same key (files of equal bytes): by a window over the key."""
    w = W.partitionBy("_key").orderBy(path).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_key", key).withColumn("duplicates_of", F.collect_list(path).over(w)).drop("_key")
