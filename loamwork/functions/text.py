"""Text expressions: trimming, coercion, quality metrics, boilerplate, tags and question pairs, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that JavaScript's trim strips, as a regular expression class.
JS_SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Words that mark profanity wherever they occur.
PROFANITY = ["fuck", "shit", "damn", "bitch", "ass", "bastard", "crap", "dick", "piss"]
# Words that are no tags.
TAG_STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "day", "get",
    "has", "him", "his", "how", "man", "new", "now", "old", "see", "two", "way", "who", "boy", "did", "its", "let", "put",
    "say", "she", "too", "use", "that", "with", "have", "this", "will", "your", "from", "they", "know", "want", "been",
    "good", "much", "some", "time", "very", "when", "come", "here", "just", "like", "long", "make", "many", "over", "such",
    "take", "than", "them", "well", "were",
]
# Boilerplate, in the order in which it goes; \z is the end of the text.
BOILERPLATE = [
    r"(?is)choose which cookies.*?(?=\n\n|\n[A-Z]|\z)",
    r"(?is)accept all cookies.*?(?=\n\n|\z)",
    r"(?is)cookie consent.*?(?=\n\n|\z)",
    r"(?is)privacy settings.*?(?=\n\n|\z)",
    r"(?is)we use cookies.*?(?=\n\n|\z)",
    r"(?is)this website uses cookies.*?(?=\n\n|\z)",
    r"(?is)privacy policy.*?terms of (use|service).*?(?=\n\n|\z)",
    r"(?is)terms of (use|service).*?(?=\n\n|\z)",
    r"(?is)all rights reserved.*?\d{4}.*?(?=\n\n|\z)",
    r"(?i)copyright \x{00A9}?\s*\d{4}.*?all rights reserved",
    r"(?is)\x{00A9}\s*\d{4}.*?(?=\n\n|\z)",
    r"(?is)subscribe to our newsletter.*?(?=\n\n|\z)",
    r"(?is)sign up for our newsletter.*?(?=\n\n|\z)",
    r"(?is)join our mailing list.*?(?=\n\n|\z)",
    r"(?is)get the latest updates.*?(?=\n\n|\z)",
    r"(?is)stay connected.*?(?=\n\n|\z)",
    r"(?is)follow us on (?:twitter|facebook|instagram|linkedin|youtube|tiktok).*?(?=\n\n|\z)",
    r"(?is)connect with us.*?(?:twitter|facebook|instagram|linkedin).*?(?=\n\n|\z)",
    r"(?is)share this (?:article|post|page).*?(?=\n\n|\z)",
    r"(?is)share on (?:twitter|facebook|linkedin).*?(?=\n\n|\z)",
    r"(?im)\^\s*home\s*[/>\x{00BB}].*$",
    r"(?im)^\s*menu\s*$",
    r"(?im)^\s*search\s*$",
    r"(?im)^\s*skip to content\s*$",
    r"(?im)^\s*skip to main content\s*$",
    r"(?is)related (?:articles|posts|stories|content).*\z",
    r"(?is)you may also like.*\z",
    r"(?is)recommended for you.*\z",
    r"(?is)comments?\s*\(\d+\).*\z",
    r"(?is)leave a comment.*\z",
    r"(?is)add your comment.*\z",
    r"(?is)powered by.*?(?=\n\n|\z)",
    r"(?is)built with.*?(?=\n\n|\z)",
    r"(?is)made with.*?(love|\x{2665}).*?(?=\n\n|\z)",
]
# What goes where it first stands only.
BOILERPLATE_ONCE = "arXivLabs is a framework that allows collaborators"
#: One of these is in every text that any of the patterns matches; a text without them skips the patterns.
_BOILERPLATE_SIGNS = (
    "cookie|privacy|terms of|all rights|copyright|\\x{00A9}|newsletter|mailing list|latest updates|stay connected|follow us|connect with|share|home|menu|search|"
    "skip to|related|you may|recommended|comment|powered by|built with|made with|arxivlabs"
)


def bind(value: Column, use) -> Column:
    """use(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{JS_SPACE}+|{JS_SPACE}+\z", "")


def js_number(s: Column) -> Column:
    """JavaScript's Number() of a text: blank is 0, what cannot be read is null."""
    t = js_trim(s.cast("string"))
    return F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double"))


def truthy(s: Column) -> Column:
    return s.isNotNull() & (s.cast("string") != "")


def first_truthy(*values: Column) -> Column:
    """a || b || ... for texts; '' when none holds anything."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values], F.lit(""))


def utf16_length(s: Column) -> Column:
    return F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def token_estimate(s: Column) -> Column:
    return F.ceil(F.length(s) / F.lit(4.0)).cast("long")


def length_score(s: Column, least: int | None = None, most: int | None = None) -> Column:
    """struct(score, reason) by length, against optional bounds."""
    n = F.length(F.coalesce(s, F.lit("")))
    below = (n < least) if least is not None else F.lit(False)
    above = (n > most) if most is not None else F.lit(False)
    score = F.when(below, F.greatest(F.lit(1), round_half_up(n / F.lit(float(least or 1)) * F.lit(5.0)))).otherwise(F.lit(10))
    plain = F.when((n > 100) & (n < 10000), F.lit(10)).when(n < 50, F.lit(6)).when(n > 50000, F.lit(7)).otherwise(F.lit(10))
    plain_reason = F.when((n > 100) & (n < 10000), "Optimal length").when(n < 50, "Very short content").when(n > 50000, "Very long content").otherwise("Good length")
    below_reason = F.when(below, F.concat(F.lit("Length "), n.cast("string"), F.lit(f" below minimum {least}")))
    above_reason = F.when(above, F.concat(F.lit("Length "), n.cast("string"), F.lit(f" exceeds maximum {most}")))
    bad = below | above
    return F.struct(
        F.when(above, F.least(score, F.lit(5))).when(bad, score).otherwise(plain).cast("int").alias("score"),
        F.when(bad, F.concat_ws("; ", below_reason, above_reason)).otherwise(plain_reason).alias("reason"),
    )


def quality_metrics(s: Column) -> Column:
    """struct(length_score, readability_score, diversity_score, format_score, overall, reason)."""
    s = F.coalesce(s, F.lit(""))
    words = F.regexp_extract_all(F.lower(s), F.lit(r"\w+"), F.lit(0))
    sentences = F.size(F.filter(F.split(s, "[.!?]+"), lambda x: x.rlike(r"\S")))
    share = bind(words, lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w).cast("double")).otherwise(F.lit(0.0)))
    minus = lambda c, k: F.when(c, k).otherwise(0)
    odd = minus(s.contains("\n\n\n\n"), 2) + minus(s.rlike(r"[^\x20-\x7E\s\x{00A0}-\x{024F}]"), 1) + minus(s.contains("  "), 1)
    counts = F.struct(F.length(s).alias("n"), sentences.alias("sentences"), share.alias("share"), odd.alias("odd"), s.rlike(r"[.!?]\z").alias("ends"))
    return bind(bind(counts, _quality_scores), _quality)


def _quality_scores(c: Column) -> Column:
    n, sentences = c["n"], c["sentences"]
    length = F.when(n < 50, 3).when(n < 100, 5).when(n < 200, 7).when(n > 10000, 6).otherwise(10)
    mean = F.when(sentences > 0, n / sentences.cast("double")).otherwise(F.lit(0.0))
    readability = F.when(mean < 10, 4).when(mean > 50, 5).otherwise(10)
    diversity = F.greatest(F.lit(1), F.least(F.lit(10), round_half_up(c["share"] * F.lit(20.0))))
    form = F.greatest(F.lit(1), F.lit(10) - c["odd"] - F.when((sentences > 0) & ~c["ends"], 1).otherwise(0))
    return F.struct(length.cast("int").alias("length"), readability.cast("int").alias("readability"), diversity.cast("int").alias("diversity"), form.cast("int").alias("form"))


def _quality(v: Column) -> Column:
    overall = round_half_up(v["length"] * F.lit(0.3) + v["readability"] * F.lit(0.25) + v["diversity"] * F.lit(0.25) + v["form"] * F.lit(0.2))
    said = [F.when(v[k] < 7, F.concat(F.lit(f"{name}: "), v[k].cast("string"), F.lit("/10"))) for name, k in (("Length", "length"), ("Readability", "readability"), ("Diversity", "diversity"), ("Format", "form"))]
    reason = F.concat_ws(", ", *said)
    return F.struct(
        v["length"].alias("length_score"), v["readability"].alias("readability_score"), v["diversity"].alias("diversity_score"),
        v["form"].alias("format_score"), overall.alias("overall"), F.when(reason == "", "Good quality content").otherwise(reason).alias("reason"),
    )


def is_valid_content(s: Column, least: int, most: int = 0) -> Column:
    t = js_trim(F.coalesce(s, F.lit("")))
    n = F.length(t)
    ok = (n >= least) & (n > 0)
    if most > 0:
        ok = ok & (n <= most)
    return ok & (count_matches(t, r"\w") / n.cast("double") >= F.lit(0.3))


def relevance(s: Column, target: str) -> Column:
    """Share of the target's words (over two letters) that the text holds, plus all again for the whole phrase; at most 1."""
    words = [w for w in target.lower().split() if len(w) > 2]
    if not words:
        return F.lit(0.0)
    lower = F.lower(F.coalesce(s, F.lit("")))
    hits = sum((lower.contains(w).cast("int") for w in words), F.lit(0)) + F.when(lower.contains(target.lower()), len(words)).otherwise(0)
    return F.least(hits / F.lit(float(len(words))), F.lit(1.0))


def remove_boilerplate(s: Column) -> Column:
    bare = s
    for p in BOILERPLATE:
        bare = F.regexp_replace(bare, p, "")
    bare = F.regexp_replace(bare, rf"(?s)\A(.*?)(?i:{BOILERPLATE_ONCE})", "$1")
    s = F.when(s.rlike(f"(?i){_BOILERPLATE_SIGNS}"), bare).otherwise(s)
    return js_trim(F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def clean_title(title: Column) -> Column:
    return js_trim(F.regexp_replace(F.regexp_replace(title, r"\s*[-|]\s*.*", ""), r"\s+", " "))


def question_pair(title: Column, s: Column) -> Column:
    """struct(instruction, output): a question of the title, and the first paragraph of over 50 characters or the start."""
    return bind(s, lambda text: _question_pair(title, text))


def _question_pair(title: Column, s: Column) -> Column:
    paragraphs = F.filter(F.transform(F.split(s, r"\n\n+"), js_trim), lambda p: F.length(p) > 50)
    start = F.concat(F.substring(js_trim(s), 1, 500), F.when(F.length(s) > 500, "...").otherwise(""))
    return F.struct(F.concat(F.lit("What is "), clean_title(title), F.lit("?")).alias("instruction"), F.coalesce(F.get(paragraphs, F.lit(0)), start).alias("output"))


def title_words(title: Column) -> Column:
    return F.split(title, r"[\s|\x{2014}\-:,]+")


def contains_profanity(s: Column) -> Column:
    return F.coalesce(F.lower(s).rlike("|".join(PROFANITY)), F.lit(False))


def strip_html_tags(s: Column) -> Column:
    return F.regexp_replace(s, "<[^>]*>", "")


def normalize_whitespace(s: Column) -> Column:
    return js_trim(F.regexp_replace(s, r"\s+", " "))


def remove_special_chars(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\w\s]", "")


def truncate(s: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - len(suffix)), F.lit(suffix))).otherwise(s)


def field_name(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"[^a-zA-Z0-9_]", "_"), "_+", "_"))


def file_name(s: Column) -> Column:
    return F.substring(F.regexp_replace(s, r"[^A-Za-z0-9._-]", "_"), 1, 200)


def mask_value(s: Column) -> Column:
    return F.when(F.length(s) <= 6, "***").otherwise(F.concat(F.substring(s, 1, 3), F.lit("..."), F.right(s, F.lit(3))))


def fold_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


def claims(s: Column) -> Column:
    """Stretches between sentence ends that look like statements of fact: from a capital on with a verb of being or
    having after it, or with a digit.  Linear in the text: each stretch is looked at once."""
    parts = F.split(s, "[.!?]")
    stated = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"[A-Z][\s\S]*\z", 0)), lambda p: p.rlike("is|are|was|were|will|can|has|have|had"))
    return F.filter(F.concat(stated, F.filter(parts, lambda p: p.rlike("[0-9]"))), lambda c: (F.length(c) > 10) & (F.length(c) < 200))


def repair_json(s: Column) -> Column:
    """Reply text made parsable: thinking tags, fences, smart quotes and trailing commas go."""
    s = F.regexp_replace(s, r"(?is)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?s)^\s*```(?:json)?\s*|\s*```\s*\z", "")
    s = F.regexp_replace(F.regexp_replace(s, "[“”]", '"'), "[‘’]", "'")
    return F.trim(F.regexp_replace(s, r",\s*([}\]])", "$1"))


def overlap_score(query: Column, title: Column, snippet: Column, stop_words: list[str]) -> Column:
    """Query words found in the title count 2, else in the snippet 1, out of 2 a word."""
    stop = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    q, t, n = words(query), words(title), words(snippet)
    hits = F.aggregate(q, F.lit(0), lambda a, w: a + F.when(F.array_contains(t, w), 2).when(F.array_contains(n, w), 1).otherwise(0))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(hits / (F.size(q) * F.lit(2.0)))


def fuzzy_label(label: Column, labels: list[str]) -> Column:
    """The label meant: equal but for case, else the first that holds or is held, else the nearest by edit distance
    within max(3, half its length), else the first."""
    x = F.lower(F.trim(label))
    out = F.lit(labels[0])
    distance = F.array_sort(F.array(*[F.struct(F.levenshtein(x, F.lit(v.lower())).alias("d"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(labels)]))
    best = F.get(distance, F.lit(0))
    out = F.when(best["d"] <= F.greatest(F.lit(3.0), F.length(x) / F.lit(2.0)), best["v"]).otherwise(out)
    for v in reversed(labels):
        out = F.when(x.contains(v.lower()) | F.lit(v.lower()).contains(x), F.lit(v)).otherwise(out)
    for v in reversed(labels):
        out = F.when(x == v.lower(), F.lit(v)).otherwise(out)
    return out


def coco_to_yolo(box: Column, width: Column, height: Column) -> Column:
    """[x, y, w, h] in pixels as [centre x, centre y, w, h] in shares of the image."""
    b = lambda k: F.get(box, F.lit(k)).cast("double")
    return F.array((b(0) + b(2) / 2) / width, (b(1) + b(3) / 2) / height, b(2) / width, b(3) / height)


def yolo_to_coco(box: Column, width: Column, height: Column) -> Column:
    b = lambda k: F.get(box, F.lit(k)).cast("double")
    return F.array((b(0) - b(2) / 2) * width, (b(1) - b(3) / 2) * height, b(2) * width, b(3) * height)
