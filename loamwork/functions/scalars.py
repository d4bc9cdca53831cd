"""Scalars of scraping, prompts and labels, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions import urls as U

# Words that are no tags of a manifest.
MANIFEST_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "over", "for", "of", "with", "by", "is", "are", "was", "were",
    "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can",
    "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "my", "your", "his", "her", "its", "our",
    "their", "www", "com", "org", "net", "io", "co", "html", "htm", "php", "asp", "jsp", "index", "home", "page",
]
# What marks a page that stands in the way of a crawler, and the reason given, in order.
ANTI_BOT = [
    ("captcha", "CAPTCHA challenge detected"), ("robot", "Anti-bot protection (robot check) detected"), ("verify you are human", "Human verification required"),
    ("unusual traffic", "Unusual traffic detected (rate limited)"), ("select all squares", "Image CAPTCHA challenge detected"),
    ("recaptcha", "Google reCAPTCHA detected"), ("cf-browser-verification", "Cloudflare verification detected"), ("ddos protection", "DDoS protection active"),
    ("access denied", "Access denied by server"), ("blocked", "IP/user agent blocked"), ("security check", "Security check required"),
    ("please click here if", "Google redirect/bot detection page"), ("redirected", "Redirect page detected"), ("enable javascript", "JavaScript requirement detected"),
]
# What a snippet loses, in order: pattern and replacement.
SNIPPET = [
    (r"\[(web|image)_link\]", ""), (r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    ("&#8217;", "'"), ("&#8216;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
    (r"&#\d+;", ""), (r"\s+", " "),
]
# Parts of paths that tell a label, in order.
PATH_LABELS = [
    (("car", "auto", "vehicle"), "vehicle"), (("person", "people", "face"), "person"), (("animal", "pet"), "animal"), (("food", "meal"), "food"),
    (("building", "architecture"), "architecture"), (("nature", "landscape"), "nature"),
]
# Languages as code, name and own name.
LANGUAGES = [
    ("en", "English", "English"), ("es", "Spanish", "Español"), ("fr", "French", "Français"), ("de", "German", "Deutsch"), ("it", "Italian", "Italiano"),
    ("pt", "Portuguese", "Português"), ("zh", "Chinese", "中文"), ("ja", "Japanese", "日本語"), ("ko", "Korean", "한국어"), ("ar", "Arabic", "العربية"),
    ("hi", "Hindi", "हिन्दी"), ("ru", "Russian", "Русский"), ("nl", "Dutch", "Nederlands"), ("pl", "Polish", "Polski"), ("tr", "Turkish", "Türkçe"),
    ("vi", "Vietnamese", "Tiếng Việt"), ("th", "Thai", "ไทย"), ("sv", "Swedish", "Svenska"), ("da", "Danish", "Dansk"), ("fi", "Finnish", "Suomi"),
    ("nb", "Norwegian", "Norsk"), ("uk", "Ukrainian", "Українська"), ("cs", "Czech", "Čeština"), ("ro", "Romanian", "Română"), ("el", "Greek", "Ελληνικά"),
    ("he", "Hebrew", "עברית"), ("id", "Indonesian", "Bahasa Indonesia"), ("ms", "Malay", "Bahasa Melayu"), ("bn", "Bengali", "বাংলা"),
]


def manifest_tags(title: Column, url: Column) -> Column:
    """Words of the URL's path, parts of its host and words of the title: over two characters, no stop words, sorted, once each."""
    good = lambda w: (F.length(w) > 2) & ~w.isin(MANIFEST_STOP_WORDS)
    segments = F.filter(F.split(U.path(url), "/"), lambda s: F.length(s) > 2)
    pieces = F.flatten(F.transform(segments, lambda s: F.split(F.regexp_replace(s, r"\.[^/.]+\z", ""), r"[-_\s]+")))
    from_path = F.filter(F.transform(pieces, lambda w: F.trim(F.lower(w))), lambda w: good(w) & w.rlike("^[a-z0-9]+$"))
    from_host = F.filter(F.split(U.host(url), r"\."), good)
    from_title = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), good)
    of_url = F.when(U.is_url(url), F.concat(from_path, from_host)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(of_url, from_title)))


def clean_snippet(text: Column) -> Column:
    """A search snippet without link marks, with its commonest entities read and white space folded."""
    for pattern, plain in SNIPPET:
        text = F.regexp_replace(text, pattern, plain)
    return F.trim(text)


def label_from_path(path: Column, target: str = "") -> Column:
    """The label of the first telling part of a path, else its folder's name, else the target, else 'unknown'."""
    p = F.lower(path)
    folder = F.regexp_extract(p, r"([^/]+)/+[^/]*/*\z", 1)
    out = F.when((folder != "") & ~folder.isin("downloads", "images"), F.regexp_replace(folder, "[-_]", " ")).otherwise(target or "unknown")
    for parts, label in reversed(PATH_LABELS):
        out = F.when(p.rlike("|".join(parts)), label).otherwise(out)
    return out


def prompt_hash(text: Column) -> Column:
    """h = 31 h + c over UTF-16 units in 32 bits, signed, in base 36."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.length(units) / 4 - 1, F.lit(0)).cast("int")), lambda k: F.coalesce(F.conv(F.nullif(F.substring(units, 4 * k + 1, F.lit(4)), F.lit("")), 16, 10).cast("long"), F.lit(0)))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + (1 << 31), F.lit(1 << 32)) - (1 << 31))
    return F.concat(F.when(h < 0, "-").otherwise(""), F.lower(F.conv(F.abs(h).cast("string"), 10, 36)))


def box_from_percent(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in hundredths of an image as whole pixels, halves upwards; what is missing is 0."""
    pixels = lambda share, side: F.floor(F.coalesce(share, F.lit(0.0)) / 100 * side + 0.5).cast("long")
    return F.array(pixels(x, width), pixels(y, height), pixels(w, width), pixels(h, height))


def clamp_confidence(value: Column) -> Column:
    """Between 0 and 1; missing and 0 are 0.5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nullif(value.cast("double"), F.lit(0.0)), F.lit(0.5))))


def resolve_language(text: Column) -> Column:
    """The code of a language given by code, name or own name in any case; null for none."""
    names: dict[str, str] = {}
    for code, *more in LANGUAGES:
        for name in (code, *more):
            names.setdefault(name.lower(), code)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(text)))


def language_supported(code: Column, model_languages: dict[str, list[str]], model: str) -> Column:
    """Whether a model knows a language; a model that is not listed knows all."""
    return code.isin(model_languages[model]) if model in model_languages else F.lit(True)


def anti_bot_reason(html: Column) -> Column:
    """Why a page seems to be a barrier for crawlers, the first reason that holds; null for none."""
    low = F.lower(html)
    plain = html.contains("noscript") & html.contains("meta") & html.contains("refresh")
    out = F.when(html.rlike(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"), "RTL text detected (likely bot redirect page)").when(plain, "Noscript/refresh meta tag detected")
    for part, reason in reversed(ANTI_BOT):
        out = F.when(low.contains(part), reason).otherwise(out)
    return out


def spider_url(url: Column) -> Column:
    """A URL with backslashes and quotes escaped; null for one that is too long or holds what a spider must not be given."""
    bad = (F.length(url) > 2000) | url.contains("\0") | url.rlike(r"\\u[0-9a-fA-F]{4}") | url.contains('"""')
    return F.when(~bad, F.replace(F.replace(url, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))


def search_context(results: Column) -> Column:
    """Search results (array of title, url, content) as a numbered block of text; '' for none."""
    lines = F.transform(results, lambda r, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), r["title"], F.lit("\nURL: "), r["url"], F.lit("\n"), r["content"]))
    block = F.concat(F.lit("\n\n--- Web Search Context ---\n\n"), F.array_join(lines, "\n\n"), F.lit("\n\n--- End Context ---\n"))
    return F.when(F.size(results) > 0, block).otherwise("")


def batch_size(lengths: Column, most: int = 8000) -> Column:
    """How many of the first texts go into one request: all, halved until their lengths fit; one at least."""
    total = lambda n: F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + x)
    halves = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.greatest(F.lit(1), F.ceil(F.size(lengths) / F.pow(F.lit(2.0), k)).cast("int")))
    return F.coalesce(F.get(F.filter(halves, lambda n: total(n) <= most), F.lit(0)), F.lit(1))


def contextual_qa(file_name: Column, title: Column, alt: Column, url: Column, target: str | None = None) -> Column:
    """One or two questions with answers (array of question, answer) about an image, from its file name, else its site, else its
    page's title.  A name that starts with 'image', holds 'img', 'pic' or 'photo', or ends with 'screenshot' tells nothing."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(file_name, F.lit("")), r"\.[^/.]+\z", ""), "[-_]", " "), r"\d+\z", ""))
    page = F.coalesce(title, F.lit(""))
    site = F.trim(F.get(F.split(page, "[|–-]"), F.lit(0)))
    told = (F.length(name) > 2) & ~name.rlike(r"(?i)^image|img|pic|photo|screenshot\z")
    subject = F.when(told, name).when(F.length(site) > 2, site).otherwise(page)
    known = F.when(told, F.concat(F.lit("This appears to be "), name, F.lit("."))).when(subject != "", F.concat(F.lit("This image is from "), subject, F.lit("."))).otherwise("")
    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    none = F.filter(F.array(pair(F.lit(""), F.lit(""))), lambda _: F.lit(False))
    if target:
        t = target.lower()
        first = F.array(pair(F.lit(f"What {t} is shown in this image?"), F.when(known != "", known).otherwise(f"This appears to be a {t}.")))
        more = F.array(pair(F.lit(f"Can you describe this {t}?"), F.concat(F.lit("This is "), subject, F.lit("."))))
    else:
        host = F.coalesce(F.nullif(F.get(F.split(url, "/"), F.lit(2)), F.lit("")), F.lit("unknown source"))
        last = F.coalesce(F.nullif(alt, F.lit("")), F.concat(F.lit("An image from "), host, F.lit(".")))
        first = F.array(pair(F.lit("What is shown in this image?"), F.when(subject != "", known).otherwise(last)))
        more = F.array(pair(F.lit("What can you tell me about this image?"), F.concat(F.lit("This shows "), subject, F.lit("."))))
    return F.concat(first, F.when(subject != "", more).otherwise(none))
