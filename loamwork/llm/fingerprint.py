"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

A text's five-word shingles are hashed once.  The upper bits of a hash choose one of the bins, and a bin keeps the
least of its hashes.  An empty bin takes the value of a full one by optimal densification: it tries the bins in an
order that is random but fixed for it, so equal sets fill alike.  Stored are the lowest ``BITS`` bits of each bin,
packed as hexadecimal digits.  Two fingerprints that agree in the share p of bins estimate the Jaccard likeness
(p - 2^-b) / (1 - 2^-b), as unlike bins agree by chance in one of 2^b.

``neighbours`` pairs each document with the next by falling doc_id without a global sort: doc_id ranges from
approximate quantiles are buckets, each bucket is ordered by itself, and its first row is also sent, as a
sentinel, to the bucket before.  The texts are exchanged once, by bucket; shingles, bins and fingerprints of a
bucket need no further exchange.  There are no hot keys: a bucket is a share of the rows, whatever they hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork.llm.common import documents, id_text

BINS = 256
BITS = 8
WIDTH = 5
#: Bins that an empty bin tries by table before it compares all full bins.
TRIES = 12
#: Buckets for each shuffle partition: more even shares of the rows.
BUCKETS_A_PARTITION = 4
_LEAST = -(1 << 63)
# rows that carry a document's own values through the shingles' aggregation, as bins below 0
_OWN = {"doc_id": -1, "n_chars": -2, "sha": -3, "sentinel": -7}


def words_of(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hash(words: Column, at: Column) -> Column:
    """The hash of the WIDTH words from a place on (fewer at the end)."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(WIDTH)])


def shingle_bins(rows: DataFrame, keys: list[str], text: str, own: dict[int, Column] | None = None) -> DataFrame:
    """keys, bin and the bin's least value; texts without words give bin null; own gives values under bins below 0."""
    own = own or {}
    first = min(own, default=0)
    n = F.size("_words")
    places = F.when(n > 0, F.sequence(F.lit(first), F.greatest(n - WIDTH, F.lit(0)))).otherwise(F.sequence(F.lit(first), F.lit(-1)) if first else F.lit(None).cast("array<int>"))
    exploded = rows.withColumn("_words", words_of(F.col(text))).withColumn("_at", F.explode_outer(places))
    h = shingle_hash(F.col("_words"), F.col("_at"))
    bits = int(math.log2(BINS))
    bin_, value = F.shiftrightunsigned(h, 64 - bits).cast("int"), h.bitwiseAND((1 << (64 - bits)) - 1)
    inside = F.col("_at") >= 0
    bin_ = F.when(inside, bin_).otherwise(F.col("_at"))
    value = F.when(inside, value)
    for at, column in own.items():
        value = value.when(F.col("_at") == at, column)
    return exploded.select(*keys, bin_.alias("bin"), value.alias("value")).groupBy(*keys, "bin").agg(F.min("value").alias("value"))


def densified(entries: Column) -> Column:
    """The lowest BITS bits of all bins, from the full bins as structs (bin, value); null for no full bin.

    An empty bin takes the first full one of its table of tries, else the full bin that hashes least with it.
    """
    # one foldable literal: thousands of literal nodes would slow the planner
    table = F.split(F.lit(",".join(str(_try(i, t)) for i in range(BINS) for t in range(TRIES))), ",").cast("array<int>")
    gap = lambda n: F.array_repeat(F.lit(None).cast("long"), n)

    def spread(full: Column) -> Column:
        before = lambda i: F.when(i == 0, -1).otherwise(F.get(full, i - 1)["bin"])
        return F.concat(F.flatten(F.transform(full, lambda e, i: F.concat(gap(e["bin"] - before(i) - 1), F.array(e["value"])))), gap(BINS - 1 - F.element_at(full, -1)["bin"]))

    def fill(full: Column, dense: Column, v: Column, i: Column) -> Column:
        last = F.array_min(F.transform(full, lambda e: F.struct(F.xxhash64(i, e["bin"]).alias("order"), e["value"].alias("value"))))["value"]
        return F.coalesce(v, *[F.get(dense, F.get(table, i * TRIES + t)) for t in range(TRIES)], last).bitwiseAND((1 << BITS) - 1).cast("int")

    signature = _bind(F.sort_array(entries), lambda full: _bind(spread(full), lambda dense: F.transform(dense, lambda v, i: fill(full, dense, v, i))))
    return F.when(F.size(entries) > 0, signature)


def _bind(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _try(i: int, t: int) -> int:
    """A fixed pseudo-random bin for an empty bin's try."""
    x = (i * 0x9E3779B97F4A7C15 + (t + 1) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x ^= x >> 31
    x = x * 0x94D049BB133111EB & ((1 << 64) - 1)
    return (x >> 33) % BINS


def packed(signature: Column) -> Column:
    """A signature as hexadecimal digits; the empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two signatures; 1 for two empty sets, 0 for an empty and another."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row.  A null text is empty; a text without words has the empty fingerprint;
    repeated rows each give a row; an empty table gives none; other columns are ignored."""
    rows = id_text(docs).withColumn("_row", F.monotonically_increasing_id())
    bins = shingle_bins(rows, ["_row"], "text", {-1: F.col("doc_id")})
    own = F.collect_list(F.when(F.col("bin") >= 0, F.struct("bin", "value")))
    # max() skips nulls: a null doc_id stays null
    return bins.groupBy("_row").agg(own.alias("e"), F.max(F.when(F.col("bin") == -1, F.col("value"))).alias("doc_id")).select("doc_id", packed(densified(F.col("e"))).alias("fingerprint"))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, by a coarse and a fine step."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    count = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = count(F.array(*[F.lit(b).cast("long") for b in bounds[::step]]))
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = (coarse - 1) * step
    return F.when(coarse == 0, 0).otherwise(at + count(F.slice(table, F.greatest(at, F.lit(0)) + 1, F.lit(step))))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text (the next row by falling doc_id, then text; after the last the first), sentinel, and
    the bucket and place that order the rows.  Sentinels repeat the first row of the following bucket.

    A null doc_id orders below all others.  The buckets' bounds and first rows' ids are what reaches the driver:
    their number is set by spark.sql.shuffle.partitions, not by the data.
    """
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("_key", F.coalesce("doc_id", F.lit(_LEAST)))
    buckets = BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select("_key").approxQuantile("_key", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))
    bounds = sorted({int(c) for c in cuts})
    rows = rows.withColumn("_bucket", _bucket(F.col("_key"), bounds))
    heads = {r["_bucket"]: r["k"] for r in rows.groupBy("_bucket").agg(F.max("_key").alias("k")).collect()}
    order = sorted(heads)
    # the first row of a bucket follows the last row of the next higher one; the very first follows the very last
    sends = spark.createDataFrame([(heads[b], order[(k + 1) % len(order)]) for k, b in enumerate(order)], "_key long, _to int")
    sent = rows.join(F.broadcast(sends), "_key", "left")  # at most one row a bucket
    targets = F.when(F.col("_to").isNull(), F.array("_bucket")).otherwise(F.array("_bucket", "_to"))
    both = sent.select("doc_id", "text", "_key", F.posexplode(targets).alias("sentinel", "bucket")).repartition("bucket")
    w = W.partitionBy("bucket").orderBy("sentinel", F.desc("_key"), "text")
    return both.select("doc_id", "text", F.lead("text").over(w).alias("next_text"), F.col("sentinel").cast("long").alias("sentinel"), "bucket", F.row_number().over(w).alias("place"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last half (rounded down) replaced by as much of the beginning of the next."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), half))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike it is to the edited and the next text."""
    rows = neighbours(docs).withColumn("_edited", edited(F.col("text"), F.col("next_text"))).withColumn("_sha", F.sha2(F.col("_edited").cast("binary"), 256))
    quarter = lambda k: F.conv(F.substring("_sha", 16 * k + 1, 16), 16, -10).cast("long")
    rows = rows.select("doc_id", "sentinel", F.length("text").cast("long").alias("n_chars"), *[quarter(k).alias(f"_sha{k}") for k in range(4)], "bucket", "place", F.posexplode(F.array("text", "_edited")).alias("kind", "_text"))
    own = {_OWN["doc_id"]: F.col("doc_id"), _OWN["n_chars"]: F.col("n_chars"), _OWN["sentinel"]: F.col("sentinel")} | {_OWN["sha"] - k: F.col(f"_sha{k}") for k in range(4)}
    bins = shingle_bins(rows, ["bucket", "place", "kind"], "_text", own)
    entries = lambda kind: F.collect_list(F.when((F.col("kind") == kind) & (F.col("bin") >= 0), F.struct("bin", "value")))
    value = lambda at: F.max(F.when((F.col("kind") == 0) & (F.col("bin") == at), F.col("value")))
    sha = [value(_OWN["sha"] - k).alias(f"_sha{k}") for k in range(4)]
    grouped = bins.groupBy("bucket", "place").agg(entries(0).alias("_e0"), entries(1).alias("_e1"), value(_OWN["doc_id"]).alias("doc_id"), value(_OWN["n_chars"]).alias("n_chars"), value(_OWN["sentinel"]).alias("sentinel"), *sha)
    signed = grouped.withColumns({"_own": densified(F.col("_e0")), "_new": densified(F.col("_e1"))}).drop("_e0", "_e1")
    followed = signed.withColumn("_next", F.lead("_own").over(W.partitionBy("bucket").orderBy("place"))).filter("sentinel = 0")
    digest = F.concat(*[F.lpad(F.lower(F.hex(f"_sha{k}")), 16, "0") for k in range(4)])
    return followed.select(
        "doc_id", "n_chars", digest.alias("edited_sha256"), packed(F.col("_own")).alias("fingerprint"), packed(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(documents(spark, sf_dir))
