"""Rules that look at one page: conditions and findings as Columns, evaluated in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.text import is_blank, strip
from ..functions.urls import defragment
from .catalog import finding, fire

X = "extracted."


def is_html() -> Column:
    return F.col("content_type").startswith("text/html")


def html_ok() -> Column:
    return (F.col("status_code") == 200) & is_html()


def page_kind() -> Column:
    return F.col("extracted.page_type")


def _simple(rule, source, field, when, observed):
    return rule, when, finding(rule, F.col("url"), observed, source=source, field=field)


def discoverability() -> list[tuple[str, Column, Column]]:
    title, robots, count = F.col(X + "title"), F.col(X + "meta_robots"), F.col("diagnostics.malformed_jsonld_count")
    length, chain, canonical = F.col("diagnostics.visible_text_length"), F.col("redirect_chain"), F.col(X + "canonical")
    says = lambda word: F.exists(robots, lambda r: F.lower(r).contains(word))
    text = lambda c: c.cast("string")
    return [
        _simple("AI-CRAWL-001", "status_code", "status_code", F.col("status_code").between(400, 499) & is_html(), text(F.col("status_code"))),
        _simple("AI-CRAWL-002", "status_code", "status_code", (F.col("status_code") >= 500) & is_html(), text(F.col("status_code"))),
        _simple("AI-ROBOTS-002", "meta_robots", "meta_robots", says("noindex"), F.lit("noindex directive present")),
        _simple("AI-ROBOTS-003", "meta_robots", "meta_robots", (page_kind() != "fragment") & says("nofollow"), F.lit("nofollow directive present")),
        _simple("AI-REDIRECT-001", "redirect_chain", "redirect_chain", F.size(chain) >= 2, F.array_join(chain, " -> ")),
        _simple("AI-CANONICAL-001", "extracted", "canonical", html_ok() & (canonical.isNull() | (canonical == "")), F.lit("No canonical tag found")),
        _simple("AI-LINK-004", "crawler", "depth", html_ok() & (F.col("depth") >= 4), text(F.col("depth"))),
        _simple("AI-HTML-001", "extracted", "h1s", html_ok() & (F.size(X + "h1s") == 0), F.lit("0 H1 tags found")),
        _simple("AI-META-001", "extracted", "title", html_ok() & title.isNull(), F.lit("None")),
        _simple("AI-META-002", "extracted", "title", html_ok() & title.isNotNull() & (strip(title) == ""), F.lit('""')),
        _simple("AI-META-003", "extracted", "meta_description", html_ok() & is_blank(F.col(X + "meta_description")), F.lit("None or empty")),
        _simple("AI-SCHEMA-001", "diagnostics", "malformed_jsonld_count", html_ok() & (count > 0), text(count)),
        _simple("AI-CONTENT-002", "diagnostics", "visible_text_length", html_ok() & (length > 0) & (length < 50), text(length)),
    ]


def engagement() -> list[tuple[str, Column, Column]]:
    own = defragment(F.coalesce(F.nullif("final_url", F.lit("")), "url"))
    outbound = F.size(F.array_distinct(F.filter(F.transform(X + "internal_links", defragment), lambda x: x != own)))
    total = F.size(X + "image_urls")
    named = F.size(F.filter(X + "image_alts", lambda a: ~is_blank(a)))
    nav = F.to_json(F.struct(page_kind().alias("page_type"), outbound.alias("outbound_internal_link_count")))
    media = F.to_json(F.struct(total.alias("total_images"), named.alias("images_with_alt"), (total - named).alias("images_missing_alt")))
    return [
        ("ENG-NAV-001", (F.col("status_code") == 200) & page_kind().isin("article", "product") & (outbound == 0), finding("ENG-NAV-001", F.col("url"), details=nav)),
        ("ENG-MEDIA-001", (F.col("status_code") == 200) & (total > 0) & (total > named), finding("ENG-MEDIA-001", F.col("url"), details=media)),
    ]


# --- freshness: over pages with ``dates`` (array of micros, status, value, source, field) and ``audit`` (micros) ---


def with_dates(pages: DataFrame, crawl: DataFrame) -> DataFrame:
    """Pages with parsed date candidates, parsed once, and their crawl's audit time.

    An audit time that cannot be read is an error: to take the present in its place would make results depend on the clock.
    """
    # the header is one row a crawl; Spark broadcasts it while it is small
    t = D.parse_date("crawled_at")
    audit = crawl.select("crawl_id", t["micros"].alias("audit"))
    p = pages.join(audit, "crawl_id").withColumn("audit", F.when(F.col("audit").isNull(), F.raise_error(F.lit("the crawl's time cannot be read"))).otherwise(F.col("audit")))
    found = F.col(X + "date_candidates")
    p = p.withColumn("__parsed", D.parse_dates(F.transform(found, lambda d: d["value"])))
    both = F.zip_with("__parsed", found, lambda a, b: F.struct(a["micros"].alias("micros"), a["status"].alias("status"), b["value"].alias("value"), b["source"].alias("source"), b["field"].alias("field")))
    return p.withColumn("dates", both).drop("__parsed")


def _first(part: str, source: str | None = None) -> Column:
    hit = F.filter("dates", lambda d: (d["status"] == "VALID") & F.lower(d["field"]).contains(part) & ((d["source"] == source) if source else F.lit(True)))
    return F.try_element_at(hit, F.lit(1))["micros"]


def freshness_pages() -> list[tuple[str, Column, Column]]:
    valid = F.filter("dates", lambda d: d["status"] == "VALID")
    best, audit = F.array_max(F.transform(valid, lambda d: d["micros"])), F.col("audit")
    pub, mod, meta, ld = _first("publish"), _first("modif"), _first("publish", "meta"), _first("publish", "json_ld")
    timely, product = page_kind().isin("article", "news"), page_kind().isin("product", "pricing")
    days = D.age_days(best, audit)
    return [
        _simple("FR-DATE-001", "extracted", "date_candidates", html_ok() & timely & (F.size(valid) == 0), F.lit("No valid date found")),
        _simple("FR-CONS-001", "extracted", "dates", html_ok() & ~D.valid_chronology(pub, mod), F.concat(F.lit("Published "), D.iso(pub), F.lit(" occurs > 24h after Modified "), D.iso(mod))),
        _simple("FR-CONS-002", "extracted", "dates", html_ok() & (meta != ld) & (D.utc_day(meta) != D.utc_day(ld)), F.concat(F.lit("Meta ("), D.iso(meta), F.lit(") and JSON-LD ("), D.iso(ld), F.lit(") differ significantly"))),
        _simple("FR-STALE-001", "extracted", "dates", html_ok() & timely & (days > 730), F.concat(F.lit("Age > 2 years: ("), D.iso(best), F.lit(")"))),
        _simple("FR-STALE-002", "extracted", "dates", html_ok() & product & (days > 1095), F.concat(F.lit("Age > 3 years: ("), D.iso(best), F.lit(")"))),
    ]


def freshness_dates() -> list[tuple[str, Column, Column]]:
    """Over one row a date, ``d``."""
    d, audit = F.col("d"), F.col("audit")
    make = lambda rule, observed: finding(rule, F.col("url"), observed, key=[F.col("url"), d["source"], d["field"]], source=d["source"], field=d["field"])
    quoted = lambda label: F.concat(F.lit(f"{label}: '"), F.coalesce(d["value"], F.lit("None")), F.lit("'"))
    future = F.concat(quoted("Future date"), F.lit(" (Normalized: "), D.iso(d["micros"]), F.lit(") vs Audit Time: "), D.iso(audit))
    return [
        ("FR-DATE-002", html_ok() & (d["status"] == "UNPARSEABLE"), make("FR-DATE-002", quoted("Unparseable format"))),
        ("FR-DATE-003", html_ok() & (d["status"] == "IMPOSSIBLE"), make("FR-DATE-003", quoted("Impossible date"))),
        ("FR-DATE-004", html_ok() & (d["status"] == "VALID") & D.is_future(d["micros"], audit), make("FR-DATE-004", future)),
    ]


def evaluate(pages: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Discoverability and engagement rules of one page, in one scan."""
    return fire(pages, *[(w, f) for r, w, f in [*discoverability(), *engagement()] if only is None or r in only])


def evaluate_freshness(dated: DataFrame, only: set[str] | None = None) -> DataFrame:
    pages = [(w, f) for r, w, f in freshness_pages() if only is None or r in only]
    dates = [(w, f) for r, w, f in freshness_dates() if only is None or r in only]
    out = fire(dated, *pages) if pages else None
    if dates:
        each = fire(dated.where(F.size("dates") > 0).select("*", F.explode("dates").alias("d")), *dates)
        out = each if out is None else out.union(each)
    return out
