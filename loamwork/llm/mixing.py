"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source that holds n of N documents and should make up the share w of a mix of T documents has the mean
repetition rate w * T / n.  Each document draws its number of copies from a Poisson distribution of that mean by
inverting the distribution function at a uniform number hashed from (seed, doc_id); so the draw needs no state,
is the same on a retried task, and does not change when other documents come or go.  Every document is exploded
into its copies, and the copies are dealt out and sorted by a hash of (seed, doc_id, copy): a global shuffle.

Only the counts of the sources named in the weights, and of all others together, reach the driver.
The hot source is no hot key anywhere: counts are summed before the exchange, and copies are dealt by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import documents

#: Production weights: shares of the mix by source.
WEIGHTS = {"src0": 0.10, "src1": 0.15, "src2": 0.10, "src3": 0.05}
#: The share of all other sources together, null included.
REST = 0.60
SEED = "mix-1"
#: A greater mean is split evenly over several draws, whose sum has the same Poisson distribution: a table of the
#: distribution function stays short, and the work grows with the copies made.
MAX_RATE = 1_000.0


def uniform(*parts: Column) -> Column:
    """52 bits of the md5 of the parts, colon-joined, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: float) -> list[float]:
    """The distribution function at 0, 1, 2, ... until it is 1 in double precision."""
    if rate == 0:
        return []
    steps, total, k = [], 0.0, 0
    log_p = -rate
    while total < 1 - 1e-15 and k < rate + 60 * math.sqrt(rate) + 60:
        total = min(1.0, total + math.exp(log_p))
        steps.append(total)
        k += 1
        log_p += math.log(rate) - math.log(k)
    return steps


def target_rates(docs: DataFrame, weights: dict[str, float], rest: float, total: float | None = None) -> dict[str | None, float]:
    """The mean repetition rate of each named source, and of all others under None.

    Shares of sources without documents go to the others in proportion.  With no documents all rates are 0.
    """
    if any(w < 0 for w in weights.values()) or rest < 0:
        raise ValueError("weights must not be negative")
    named = F.col("source").isin(list(weights)) if weights else F.lit(False)
    sizes = {r["s"]: r["n"] for r in docs.groupBy(F.when(named, F.col("source")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {s: (rest if s is None else weights[s]) for s in sizes}
    whole = sum(shares.values())
    total = sum(sizes.values()) if total is None else total
    return {s: shares[s] / whole * total / n if whole else 0.0 for s, n in sizes.items()}


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, rest: float = REST, total: float | None = None, seed: str = SEED) -> DataFrame:
    """Each row of docs as often as its draw says, with copy (1, 2, ...), in an order shuffled by hash.

    total is the expected number of rows of the mix (default: as many as docs has).  Rows that repeat a doc_id draw
    the same number; a null doc_id draws as the text "null"; a null source belongs to the rest; texts are carried
    as they are, null or empty.  An empty table gives no rows.  A column of docs named copy is replaced.  No rate is refused.
    """
    weights = WEIGHTS if weights is None else weights
    rates = target_rates(docs, weights, rest, total)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    named = F.coalesce(F.col("source").isin([s for s in rates if s is not None]), F.lit(False))

    draws = {source: max(1, math.ceil(rate / MAX_RATE)) for source, rate in rates.items()}

    def by_source(value) -> Column:
        """value(source) of each row's source; the rest's for any that is not named."""
        out = value(None)
        for source in rates:
            out = out if source is None else F.when(named & (F.col("source") == source), value(source)).otherwise(out)
        return out

    # one foldable literal a source: thousands of literal nodes would slow the planner
    def table(source: str | None) -> Column:
        steps = poisson_steps(rates.get(source, 0.0) / draws.get(source, 1))
        return F.split(F.lit(",".join(map(repr, steps))), ",").cast("array<double>") if steps else F.array().cast("array<double>")

    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  value is computed once

    def times(steps: Column) -> Column:
        drawn = lambda u: bind(u, lambda v: F.size(F.filter(steps, lambda step: v >= step)))
        first = drawn(uniform(F.lit(seed), key))
        if max(draws.values(), default=1) == 1:
            return first
        more = F.slice(F.sequence(F.lit(1), by_source(lambda source: F.lit(draws.get(source, 1)))), F.lit(2), F.lit(1 << 30))
        return F.aggregate(more, first, lambda total, k: total + drawn(uniform(F.lit(seed), F.lit("draw"), k.cast("string"), key)))

    spare = "_" * (1 + max(map(len, docs.columns)))  # no column of docs
    counted = docs.drop("copy").select("*", F.posexplode(F.array_repeat(F.lit(True), bind(by_source(table), times))).alias("copy", spare))
    out = counted.drop(spare).withColumn("copy", F.col("copy").cast("long") + 1)
    place = F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), key, F.col("copy")).cast("binary"))
    return out.repartition(place).sortWithinPartitions(place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(documents(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"))


def _sql() -> str:
    values = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in WEIGHTS.items())
    return f"""
WITH RECURSIVE w(s, share) AS (VALUES {values}),
g AS (SELECT d.*, coalesce(w.s, '') AS s, coalesce(w.share, {REST!r}::DOUBLE) AS share FROM documents d LEFT JOIN w ON d.source = w.s),
sizes AS (SELECT s, any_value(share) AS share, count(*) AS n FROM g GROUP BY s),
rates AS (SELECT s, share / sum(share) OVER () * sum(n) OVER () / n AS rate FROM sizes),
steps(s, rate, k, log_p, total) AS (
  SELECT s, rate, 0, -rate, exp(-rate) FROM rates WHERE rate > 0
  UNION ALL
  SELECT s, rate, k + 1, log_p + ln(rate) - ln(k + 1), least(1.0, total + exp(log_p + ln(rate) - ln(k + 1)))
  FROM steps WHERE total < 1 - 1e-15 AND k < rate + 60 * sqrt(rate) + 60),
u AS (SELECT doc_id, text, lang, source, n_chars, s, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM g),
times AS (SELECT *, (SELECT count(*) FROM steps WHERE steps.s = u.s AND u.u >= steps.total) AS t FROM u)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, t + 1)) AS copy FROM times
"""


ORACLE_SQL = _sql()
