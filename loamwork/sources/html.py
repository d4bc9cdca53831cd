"""Records, text, links and files of HTML pages, by the standard library's parser, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "title"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.records: dict[str, list[dict]] = {"link": [], "image": [], "heading": [], "paragraph": []}
        self.open: list[tuple[str, dict, list[str]]] = []
        self.texts: list[str] = []
        self.title, self.skip = "", 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "img":
            self.records["image"].append({"src": a.get("src") or "", "alt": a.get("alt") or ""})
        if tag in _BLOCKS:
            self.open.append((tag, a, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is None:
            return
        _, a, parts = self.open.pop(at)
        text = "".join(parts).strip()
        if tag == "a":
            self.records["link"].append({"text": text, "href": a.get("href") or ""})
        elif tag == "title":
            self.title = text
        elif tag == "p" and text:
            self.records["paragraph"].append({"text": text})
        elif tag[0] == "h":
            self.records["heading"].append({"text": text, "level": int(tag[1])})

    def handle_data(self, data):
        if self.skip:
            return
        for _, _, parts in self.open:
            parts.append(data)
        if data.strip() and not any(tag == "title" for tag, _, _ in self.open):
            self.texts.append(data.strip())


def _parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def html_records(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, type, text, href, src, alt, level: links, then images, headings and paragraphs of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(pid, kind, r) for pid, html in zip(b.page_id, b.html) for kind, rs in _parse(html).records.items() for r in rs]
            rows = pd.DataFrame([{"page_id": pid, "type": kind, **{k: r.get(k) for k in ("text", "href", "src", "alt", "level")}} for pid, kind, r in out], columns=["page_id", "type", "text", "href", "src", "alt", "level"])
            rows.insert(1, "ordinal", rows.groupby("page_id").cumcount())
            yield rows.astype({"level": "Int32"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ordinal long, type string, text string, href string, src string, alt string, level int")


def extract_pages(pages: DataFrame, most_links: int = 50, most_text: int = 5000) -> DataFrame:
    """page_id, source_url, title, text, links and files of each page; links are absolute, once each, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, url, html in zip(b.page_id, b.url, b.html):
                p = _parse(html)
                base = url or ""
                links = list(dict.fromkeys(u for r in p.records["link"] if (u := urljoin(base, r["href"])).startswith("http")))
                files = list(dict.fromkeys(urljoin(base, r["src"]) for r in p.records["image"] if r["src"]))
                text = "\n\n".join(dict.fromkeys(t for t in p.texts if len(t) > 10))[:most_text]
                out.append((pid, url, p.title, text, links[:most_links], files[:most_links]))
            yield pd.DataFrame(out, columns=["page_id", "source_url", "title", "text", "links", "files"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, source_url string, title string, text string, links array<string>, files array<string>")
