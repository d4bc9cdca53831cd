"""URL normal forms, as Columns.  Texts that are no absolute URLs fall back to plainer forms; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):\/\/([^\/?#]+)([^?#]*)(\?[^#]*)?(#.*)?\z"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_URL), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    p = _part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def clean_url(url: Column) -> Column:
    """Without tracking parameters, fragment and trailing slashes; parameters sorted; lower case."""
    query = F.filter(F.split(F.substring(_part(url, 4), 2, 1 << 20), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    bare = F.regexp_replace(path(url), r"/+\z", "")
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise("")
    return F.when(is_url(url), F.lower(F.concat(_part(url, 1), F.lit("://"), _part(url, 2), F.when(bare == "", "/").otherwise(bare), tail))).otherwise(F.lower(F.trim(url)))


def search_key(url: Column) -> Column:
    """Host without www and path, in lower case, and the query as it is."""
    bare = F.regexp_replace(path(url), r"/+\z", "")
    plain = F.lower(F.regexp_replace(F.regexp_replace(url, r"^https?:\/\/(www\.)?", ""), r"/+\z", ""))
    return F.when(is_url(url), F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.lower(F.when(bare == "", "/").otherwise(bare)), _part(url, 4))).otherwise(plain)


def link_key(url: Column) -> Column:
    """Host without www and path without its last slash; no query."""
    key = F.regexp_replace(F.regexp_replace(F.concat(host(url), path(url)), r"/\z", ""), r"^www\.", "")
    return F.when(is_url(url), F.lower(key)).otherwise(F.regexp_replace(F.lower(url), r"/\z", ""))


def path_words(url: Column) -> Column:
    """Path segments of over two characters without a dot, dashes and underscores as spaces."""
    parts = F.filter(F.split(path(url), "/"), lambda s: (F.length(s) > 2) & ~s.contains("."))
    return F.when(is_url(url), F.transform(parts, lambda s: F.regexp_replace(s, "[-_]", " "))).otherwise(F.array().cast("array<string>"))


def file_extension(s: Column) -> Column:
    return F.lower(F.regexp_extract(s, r"(\.[^./\\]+)\z", 1))


def base_name(s: Column) -> Column:
    return F.regexp_extract(s, r"([^/\\]*)\z", 1)


def file_type(s: Column) -> Column:
    """image, video, audio, document, archive, data or other, by extension."""
    e = file_extension(F.regexp_replace(s, r"[?#].*\z", ""))
    kinds = {
        "image": [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg"],
        "video": [".mp4", ".webm", ".mov", ".avi", ".mkv"],
        "audio": [".mp3", ".wav", ".ogg", ".flac", ".m4a"],
        "document": [".pdf", ".doc", ".docx", ".txt"],
        "archive": [".zip", ".tar", ".gz", ".7z", ".rar"],
        "data": [".csv", ".json", ".jsonl", ".xml", ".xlsx", ".parquet"],
    }
    out = F.lit("other")
    for kind, extensions in kinds.items():
        out = F.when(e.isin(extensions), kind).otherwise(out)
    return out
