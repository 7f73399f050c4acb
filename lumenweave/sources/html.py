"""Extraction of page fields from raw HTML with the standard library's tokenizer, batched through Arrow."""

from __future__ import annotations

import json
from html import escape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crawl import DIAGNOSTICS, EXTRACTED

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SKIPPED = ("javascript:", "mailto:", "tel:", "data:")
#: an open element of the first kind ends before a start tag of the second
_CLOSES = {"p": {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "form", "pre", "blockquote"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "head": {"body"}}


class _Page(HTMLParser):
    """Walks the tags once; text belongs to every element open around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.text: dict[str, list[str]] = {t: [] for t in ("title", *_HEADINGS)}
        self.headings: list[str] = []
        self.body: list[str] = []
        self.metas: list[tuple[dict, str]] = []
        self.links: list[list] = []
        self.images: list[dict] = []
        self.rel: list[dict] = []
        self.scripts: list[list] = []
        self.lang = self.base = None
        self.anchors: list[list] = []
        self.parts: list[str] = []

    def _flush(self):
        if not self.parts:
            return
        data, self.parts = "".join(self.parts), []
        around = set(self.open)
        for t in ("title", *_HEADINGS):
            if t == (self.open[-1] if t == "title" and self.open else t) and t in around:
                self.text[t].append(data)
        if around & set(_HEADINGS):
            self.headings.append(data)
        if "script" in around and self.scripts:
            self.scripts[-1][1].append(data)
        elif "head" not in around and not around & {"style", "script", "title"}:
            self.body.append(data)
        for a in self.anchors:
            a[1].append(data)

    def handle_data(self, data):
        self.parts.append(data)

    def handle_starttag(self, tag, attrs):
        self._flush()
        a: dict = {}
        for k, v in attrs:
            a.setdefault(k, "" if v is None else v)
        while self.open and tag in _CLOSES.get(self.open[-1], ()):
            self._close(self.open.pop())
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang")
        elif tag == "base" and self.base is None:
            self.base = a.get("href")
        elif tag == "meta":
            self.metas.append((a, "<meta" + "".join(f' {k}="{escape(v)}"' for k, v in a.items()) + ">"))
        elif tag == "link":
            self.rel.append(a)
        elif tag == "img":
            self.images.append(a)
        elif tag == "script":
            self.scripts.append([a, []])
        if tag == "a":
            self.anchors = [[a, []]]
            self.links.append(self.anchors[0])
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, tag):
        if tag == "a":
            self.anchors = []

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.open:
            while self.open:
                t = self.open.pop()
                self._close(t)
                if t == tag:
                    break

    def finish(self):
        self.close()
        self._flush()


def page_type(url: str, json_ld: list) -> str:
    if urlparse(url).path in ("", "/"):
        return "homepage"
    for kind, marks in (("product", ("/product/", "/p/")), ("about", ("/about",)), ("contact", ("/contact",))):
        if any(m in url for m in marks):
            return kind
    for obj in json_ld:
        kind = obj.get("@type") if isinstance(obj, dict) else None
        if isinstance(kind, str):
            if kind in ("Article", "NewsArticle", "BlogPosting"):
                return "article"
            if kind == "Product":
                return "product"
    return "unknown"


def extract(html: str, url: str, domains: list[str] | None = None) -> tuple[dict, dict]:
    """The extracted fields and the diagnostics of one page at ``url``; after an error what was found so far stays."""
    e = {"title": None, "meta_description": None, "language": None, "visible_text": "", "canonical": None, "page_type": "unknown"}
    e |= {k: [] for k in ("meta_robots", "h1s", "h2s", "h3s", "headings", "internal_links", "external_links", "detailed_internal_links", "detailed_external_links", "image_urls", "image_alts", "json_ld", "parsed_json_ld", "og_tags", "twitter_metadata", "date_candidates")}
    d = {"extraction_success": True, "extraction_errors": [], "malformed_jsonld_count": 0, "text_extraction_success": False, "html_size": len(html.encode("utf-8", "replace")), "visible_text_length": 0}
    try:
        p = _Page()
        p.feed(html)
        p.finish()
        e["title"] = p.text["title"][0] if p.text["title"] else None
        e["language"] = p.lang
        e |= {"h1s": p.text["h1"], "h2s": p.text["h2"], "h3s": p.text["h3"], "headings": p.headings}
        described = [m for m, _ in p.metas if "content" in m and (m.get("name") == "description" or m.get("property") == "og:description")]
        e["meta_description"] = described[0]["content"] if described else None
        e["meta_robots"] = [m["content"] for m, _ in p.metas if m.get("name") == "robots" and "content" in m]
        e["og_tags"] = [t for m, t in p.metas if m.get("property", "").startswith("og:")]
        e["twitter_metadata"] = [t for m, t in p.metas if m.get("name", "").startswith("twitter:")]
        e["image_urls"] = [i["src"] for i in p.images if "src" in i]
        e["image_alts"] = [i["alt"] for i in p.images if "alt" in i]
        e["canonical"] = next((r["href"] for r in p.rel if r.get("rel") == "canonical" and "href" in r), None)
        base = urljoin(url, p.base) if p.base else url
        own = domains or [urlparse(url).hostname or ""]
        for a, texts in p.links:
            href = a.get("href", "")
            if not href or href.startswith(_SKIPPED):
                continue
            to = urldefrag(urljoin(base, href.strip())).url
            at = urlparse(to)
            if at.scheme not in ("http", "https"):
                continue
            inside = any(at.hostname == x or (at.hostname or "").endswith("." + x) for x in own)
            e["detailed_internal_links" if inside else "detailed_external_links"].append({"url": to, "text": " ".join(texts).strip()})
        for k in ("internal", "external"):
            e[f"{k}_links"] = sorted({x["url"] for x in e[f"detailed_{k}_links"]})
        objects: list = []
        for a, texts in p.scripts:
            if a.get("type") != "application/ld+json" or not texts:
                continue
            raw = "".join(texts)
            e["json_ld"].append(raw)
            try:
                got = json.loads(raw)
            except ValueError:
                d["malformed_jsonld_count"] += 1
                continue
            graph = got.get("@graph") if isinstance(got, dict) else None
            objects += got if isinstance(got, list) else graph if isinstance(graph, list) else [got] if isinstance(got, dict) else []
        e["parsed_json_ld"] = [json.dumps(o, ensure_ascii=False) for o in objects]
        for prop, field in (("article:published_time", "published_time"), ("article:modified_time", "modified_time")):
            hit = [m["content"] for m, _ in p.metas if m.get("property") == prop and "content" in m]
            e["date_candidates"] += [{"value": hit[0], "source": "meta", "field": prop}] if hit and hit[0] else []
        for o in objects:
            for field in ("datePublished", "dateModified", "uploadDate"):
                if isinstance(o, dict) and isinstance(o.get(field), str):
                    e["date_candidates"].append({"value": o[field], "source": "json_ld", "field": field})
        e["visible_text"] = " ".join(t for t in (x.strip() for x in p.body) if t)
        d["visible_text_length"], d["text_extraction_success"] = len(e["visible_text"]), True
        e["page_type"] = page_type(url, objects)
    except Exception as x:  # noqa: BLE001  any failure is a diagnostic of the page
        d["extraction_success"] = False
        d["extraction_errors"].append(str(x))
    return e, d


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(url, final_url, content_type, raw_html, ...) with ``extracted`` and ``diagnostics``. What is not text/html, or has no HTML, is left empty."""

    @F.pandas_udf(f"struct<extracted: {EXTRACTED}, diagnostics: {DIAGNOSTICS}>")
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        got = [extract(h or "", u or "") for h, u in zip(html, url)]
        return pd.DataFrame({"extracted": [g[0] for g in got], "diagnostics": [g[1] for g in got]})

    html = F.when(F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False)), F.col("raw_html"))
    x = pages.withColumn("__x", run(html, F.coalesce("final_url", "url")))
    return x.withColumns({"extracted": F.col("__x.extracted"), "diagnostics": F.col("__x.diagnostics")}).drop("__x")
