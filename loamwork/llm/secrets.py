"""Secret scans: known patterns, and a battery of randomness tests over other tokens; DataFrame functions alone.

Positions come from splitting the text at a pattern: the pieces lie between the matches, so running sums of
lengths give each match's start in code points.  A text without a match is never split.

The battery looks at tokens of at least ``MIN_TOKEN`` characters that mix digits and letters, outside known
secrets.  A token with signs of both base-64 alphabets is cut at those of the one and, again, at those of the
other, and every part is a token of its own.  Each is read in the smallest encoding whose alphabet holds it, and tested against the null hypothesis
that its characters are drawn evenly and independently from that alphabet: chi-squared uniformity of the
alphabet (Wilson and Hilferty's normal form), runs above and below the middle, and serial correlation.  A token's
p-value is three times the least of the three (Bonferroni), at most 1.

A token that passes looks like a key.  Calling a token ordinary is a rejection; Benjamini and Hochberg's step-up
rule, over all tokens of all documents within a class of length, keeps the share of keys among the tokens called
ordinary under ``FDR``.  Short tokens give the tests little power, so classes of length are controlled apart and
below ``MIN_TOKEN`` nothing is tested.  The rule works on p-values rounded up to one of at most ``CELLS`` cells a
class; their counts are summed before they are exchanged, so what reaches the driver is bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import documents, shared_checkpoint

# The patterns of known secrets, as contracted, and how their kinds are named and listed.
ASSIGN_JAVA = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_JAVA = r"AKIA[A-Z0-9]{16,}"
HEX_JAVA = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
#: '=' is padding at a token's end and separates elsewhere.
TOKEN_JAVA = r"[A-Za-z0-9+/_-]{24,}(?:=++(?![A-Za-z0-9+/_-]))?"
#: Parts of a token that no one alphabet holds: in each base-64 alphabet, what only the other one has separates.
PARTS_JAVA = [r"[A-Za-z0-9+/]{24,}=*", r"[A-Za-z0-9_-]{24,}=*"]
MIN_TOKEN = 24
#: Least lengths of the classes of length.
CLASSES = [24, 32, 48, 64]
CELLS = 1000
#: Spans that are gathered, or replaced, one after the other; texts with more do so block by block.
BLOCK = 64
FDR = 0.05
#: Encodings: a name, the pattern of a whole token without its padding, and its alphabet.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("hex upper", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("upper", "[A-Z0-9]+", _DIGITS + _UPPER),
    ("lower", "[a-z0-9]+", _DIGITS + _LOWER),
    ("base62", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    ("base64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
]
_SPANS = "array<struct<kind:int,start:long,end:long,value:string>>"


def spans_of(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost matches that do not overlap, as structs (kind, start, end, value of the group)."""
    p = F.lit(pattern)
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x).cast("long"))
    values = F.regexp_extract_all(text, p, F.lit(group))
    parts = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("gap"), whole.alias("n"), values.alias("value"))
    empty = F.array().cast(_SPANS)
    start = lambda acc, x: acc["at"] + x["gap"]

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(F.lit(kind).alias("kind"), start(acc, x).alias("start"), (start(acc, x) + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct((start(acc, x) + x["n"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def gathered(parts: Column) -> Column:
        # an array grows by copying, so it grows within a block only; a block starts where the lengths before it end
        blocks = in_blocks(parts)
        return _bind(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["n"])), lambda lengths: F.flatten(F.transform(
            blocks, lambda b, k: F.aggregate(b, F.struct(F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0).cast("long"), lambda n, x: n + x).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
        )))

    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), _bind(parts, gathered)).otherwise(empty)


def _bind(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(values: Column) -> Column:
    """An array in arrays of at most BLOCK elements."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))


def known_spans(text: Column) -> Column:
    """The known secrets of a text by start, then kind."""
    assign = F.filter(spans_of(text, ASSIGN_JAVA, 0, 2), lambda s: F.length(s["value"]) >= 6)
    return F.sort_array(F.transform(F.concat(assign, spans_of(text, ACCESS_JAVA, 1), spans_of(text, HEX_JAVA, 2)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def _upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by a logistic form that is within 2e-4."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * F.pow(z, F.lit(3.0))))


def _body(value: Column) -> Column:
    return F.regexp_replace(value, "=+$", "")


def _encoding(value: Column, pick) -> Column:
    out = F.lit(None)
    for e in reversed(ENCODINGS):
        out = F.when(_body(value).rlike(f"^(?:{e[1]})$"), pick(e)).otherwise(out)
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def chi_squared_p(body: Column, x: Column, n: Column, size: Column) -> Column:
    """Upper tail of the chi-squared statistic of the alphabet's counts."""
    squares = _sum(F.transform(F.array_distinct(F.split(body, "")), lambda c: F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0))))
    statistic, df = size / n * squares - n, size - 1
    return _upper_tail((F.pow(statistic / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def runs_p(x: Column, n: Column, size: Column) -> Column:
    """Both tails of the number of runs above and below the alphabet's middle; all on one side: 2 ** (1 - n)."""
    side = F.transform(x, lambda v: (v >= size / 2).cast("double"))
    above = _sum(side)
    changes = _sum(F.zip_with(F.slice(side, F.lit(1), F.size(side) - 1), F.slice(side, F.lit(2), F.size(side) - 1), lambda a, b: F.abs(a - b)))
    mean = 1 + 2 * above * (n - above) / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return F.when(variance > 0, _two_sided((changes + 1 - mean) / F.sqrt(variance))).otherwise(F.pow(F.lit(2.0), 1 - n))


def serial_p(x: Column, n: Column) -> Column:
    """Both tails of the correlation of neighbouring characters; one character alone: 2 ** (1 - n)."""
    mean = _sum(x) / n
    spread = _sum(F.transform(x, lambda v: F.pow(v - mean, F.lit(2.0))))
    products = _sum(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - mean) * (b - mean)))
    return F.when(spread > 0, _two_sided((products / spread + 1 / n) * F.sqrt(n))).otherwise(F.pow(F.lit(2.0), 1 - n))


def tested_tokens(text: Column, known: Column) -> Column:
    """Candidate tokens with their encoding, class of length, and p-value as a cell: floor(-20 ln p)."""
    bodies = F.transform(candidate_tokens(text, known), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _body(s["value"]).alias("body"), _encoding(s["value"], lambda e: F.lit(e[0])).alias("encoding"), _encoding(s["value"], lambda e: F.lit(e[2])).alias("alphabet")))
    read = F.transform(
        F.filter(bodies, lambda t: t["alphabet"].isNotNull() & (F.length(t["body"]) >= MIN_TOKEN)),
        lambda t: t.withField("x", F.transform(F.split(t["body"], ""), lambda c: (F.position(c, t["alphabet"]) - 1).cast("double"))).withField("n", F.length(t["body"]).cast("double")).withField("size", F.length(t["alphabet"]).cast("double")),
    )

    def judged(t: Column) -> Column:
        p = F.least(chi_squared_p(t["body"], t["x"], t["n"], t["size"]), runs_p(t["x"], t["n"], t["size"]), serial_p(t["x"], t["n"])) * 3
        cell = F.least(F.lit(CELLS - 1), F.floor(-20 * F.ln(F.greatest(F.lit(1e-30), F.least(F.lit(1.0), p))))).cast("int")
        group = sum(((t["n"] >= least).cast("int") for least in CLASSES[1:]), F.lit(0))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), group.alias("group"), cell.alias("cell"))

    return F.transform(read, judged)


def candidate_tokens(text: Column, known: Column) -> Column:
    """Tokens for the battery: long, with a digit and a letter, one encoding, and clear of the known secrets."""

    def parts(s: Column) -> Column:
        moved = lambda x: F.struct(x["kind"].alias("kind"), (s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end"), x["value"].alias("value"))
        return F.array_distinct(F.concat(*(F.transform(spans_of(s["value"], pattern, 3), moved) for pattern in PARTS_JAVA)))

    both = lambda s: s["value"].rlike("[+/]") & s["value"].rlike("[_-]")
    tokens = F.flatten(F.transform(spans_of(text, TOKEN_JAVA, 3), lambda s: F.when(both(s), parts(s)).otherwise(F.array(s))))
    mixed = F.filter(tokens, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    return F.filter(mixed, lambda s: ~F.exists(known, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])))


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, known and tokens of each row.  A null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_known = docs.select(*keep, text.alias("_text"), known_spans(text).alias("_known"))
    return with_known.select(*keep, F.col("_known").alias("known"), tested_tokens(F.col("_text"), F.col("_known")).alias("tokens"))


def ordinary_cells(scan: DataFrame, fdr: float = FDR) -> list[int]:
    """For each class of length the least cell at which tokens are called ordinary (CELLS: none are)."""
    counts = scan.filter(F.size("tokens") > 0).select(F.explode("tokens").alias("t")).groupBy("t.group", "t.cell").agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for group in range(len(CLASSES)):
        own = sorted(((r["cell"], r["n"]) for r in counts if r["group"] == group), reverse=True)
        total, so_far, least = sum(n for _, n in own), 0, CELLS
        for cell, n in own:
            so_far += n
            if math.exp(-cell / 20) <= fdr * so_far / total:
                least = cell
        out.append(least)
    return out


def random_spans(tokens: Column, cells: list[int]) -> Column:
    """The tokens not called ordinary, without parts that lie in another one."""
    least = F.array(*map(F.lit, cells))
    keys = F.filter(tokens, lambda t: t["cell"] < F.get(least, t["group"]))
    within = lambda t, o: (o["start"] <= t["start"]) & (t["end"] <= o["end"]) & (o["end"] - o["start"] > t["end"] - t["start"])
    outer = F.filter(keys, lambda t: ~F.exists(keys, lambda o: within(t, o)))
    return F.transform(outer, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id and spans (start, kind, end; kind as an index into KINDS) of each row, by start, then kind.

    A null or empty text has no spans; repeated rows each give a row; an empty table gives none; other columns are
    ignored.  The scan, without texts, is checkpointed, as the false-discovery rule and the result both read it.
    """
    scan = shared_checkpoint(scanned(docs, ["doc_id"]))
    return scan.select(F.col("doc_id").cast("long").alias("doc_id"), F.sort_array(F.concat("known", random_spans(F.col("tokens"), ordinary_cells(scan, fdr)))).alias("spans"))


def redact(docs: DataFrame, marker: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """docs with every span in text replaced by the marker; texts without spans, null ones too, stay as they are.

    Spans that overlap become one marker.  All columns are kept; n_chars, where docs has it, follows the text.
    """
    scan = scanned(docs, [])
    cells = ordinary_cells(scan, fdr)
    text = F.coalesce(F.col("row.text"), F.lit(""))  # docs as one column, so that no name of its own can clash
    found = docs.select(F.struct(*docs.columns).alias("row")).withColumn("known", known_spans(text))
    found = found.withColumn("tokens", tested_tokens(text, F.col("known")))
    found = found.select("row", F.sort_array(F.concat("known", random_spans(F.col("tokens"), cells))).alias("spans"))

    def cut(spans: Column) -> Column:
        """The text in pieces: for each block of spans what stands from the end of those before it to its own, and the rest."""
        ends = lambda upto: F.coalesce(F.array_max(F.transform(upto, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))), F.lit(0).cast("long"))

        def piece(blocks: Column):
            def of(b: Column, k: Column) -> Column:
                zero = F.struct(ends(F.slice(blocks, F.lit(1), k)).alias("at"), F.lit("").alias("out"))
                return F.aggregate(b, zero, step, lambda acc: acc["out"])

            return F.concat(F.array_join(F.transform(blocks, of), ""), F.substring(text, (ends(blocks) + 1).cast("int"), F.length(text)))

        return _bind(in_blocks(spans), piece)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = (s["start"] >= acc["at"]) & (s["end"] > acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(marker))).otherwise(acc["out"]).alias("out"))

    out = found.select("row.*", F.when(F.size("spans") > 0, cut(F.col("spans"))).otherwise(F.col("row.text")).alias("_" * (1 + max(map(len, docs.columns)))))
    clean = F.col(out.columns[-1])
    n_chars = F.when(clean.isNotNull(), F.length(clean).cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[clean.alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
