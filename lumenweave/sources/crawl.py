"""The crawl data model as tables: ``crawl`` (one row a crawl), ``pages`` and ``unfetched``, keyed by crawl_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

_LINK = "struct<url: string, text: string>"
EXTRACTED = (
    "struct<title: string, meta_description: string, meta_robots: array<string>, language: string, visible_text: string, h1s: array<string>, h2s: array<string>,"
    f" h3s: array<string>, headings: array<string>, internal_links: array<string>, external_links: array<string>, detailed_internal_links: array<{_LINK}>, detailed_external_links: array<{_LINK}>,"
    " image_urls: array<string>, image_alts: array<string>, canonical: string, json_ld: array<string>, parsed_json_ld: array<string>, og_tags: array<string>,"
    " twitter_metadata: array<string>, date_candidates: array<struct<value: string, source: string, field: string>>, page_type: string>"
)
DIAGNOSTICS = "struct<extraction_success: boolean, extraction_errors: array<string>, malformed_jsonld_count: int, text_extraction_success: boolean, html_size: bigint, visible_text_length: int>"
PAGE = f"url string, final_url string, status_code int, content_type string, depth int, parent_url string, redirect_chain array<string>, crawl_status string, raw_html string, extracted {EXTRACTED}, diagnostics {DIAGNOSTICS}"
STATS = ("urls_discovered", "urls_scheduled", "requests_attempted", "responses_received", "html_pages_crawled", "successful_pages", "failed_pages", "robots_blocked", "duplicate_urls", "redirects", "non_html_responses")
CRAWL_STATS = f"struct<{', '.join(f'{s}: bigint' for s in STATS)}, crawl_duration: double>"
CRAWL_DIAGNOSTICS = (
    "struct<robots_txt_fetched: boolean, robots_txt_status: int, crawl_errors: array<string>, request_failures: bigint, extraction_failures: bigint, pages_discovered_not_fetched: bigint,"
    " robots_blocked_urls: bigint, crawl_termination_reason: string, configured_depth_limit: int, configured_page_limit: int>"
)
CRAWL = f"crawl_id string, seed_url string, crawled_at string, crawl_stats {CRAWL_STATS}, crawl_diagnostics {CRAWL_DIAGNOSTICS}, finish_reason string"
UNFETCHED = "crawl_id string, seq bigint, url string, reason string"


@dataclass
class Crawl:
    crawl: DataFrame
    pages: DataFrame
    unfetched: DataFrame


def complete_pages(pages: DataFrame) -> DataFrame:
    """Pages with what may be missing filled in: empty lists, visible_text '', page_type 'unknown', no malformed JSON-LD, extraction_success."""
    defaults = {"visible_text": "", "page_type": "unknown"}
    fields = []
    for f in T._parse_datatype_string(EXTRACTED).fields:
        c = F.col(f"extracted.{f.name}")
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        fields.append(c.alias(f.name))
    e = F.struct(*fields)
    d = F.struct(
        F.coalesce("diagnostics.extraction_success", F.lit(True)).alias("extraction_success"),
        F.coalesce("diagnostics.extraction_errors", F.array().cast("array<string>")).alias("extraction_errors"),
        F.coalesce("diagnostics.malformed_jsonld_count", F.lit(0)).alias("malformed_jsonld_count"),
        F.coalesce("diagnostics.text_extraction_success", F.lit(True)).alias("text_extraction_success"),
        F.coalesce("diagnostics.html_size", F.lit(0)).cast("bigint").alias("html_size"),
        F.coalesce("diagnostics.visible_text_length", F.lit(0)).alias("visible_text_length"),
    )
    chain = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    return pages.withColumns({"extracted": e, "diagnostics": d, "redirect_chain": chain, "crawl_status": F.coalesce("crawl_status", F.lit("success"))})


def raw_counts(stats: Column) -> list[Column]:
    """From a crawler's raw counters, a map: redirect_total (answers 301 and 302; 0 without counters) and robots_status (of the first answer to robots.txt by name, if any)."""
    count = lambda k: F.coalesce(F.try_element_at(stats, F.lit(k)).cast("bigint"), F.lit(0))
    redirects = count("downloader/response_status_count/301") + count("downloader/response_status_count/302")
    mark = "robotstxt/response_status_count/"
    robots = F.array_min(F.filter(F.map_keys(stats), lambda k: k.startswith(mark)))
    return [redirects.alias("redirect_total"), F.substring_index(robots, "/", -1).cast("int").alias("robots_status")]


def load_json(spark: SparkSession, path: str) -> Crawl:
    """Crawl dumps: one JSON object a file, read with the fixed schema. A page without one of url, final_url, status_code, content_type or depth fails.

    Unfetched entries may be objects or bare strings. The completed pages are written to the shared folder, as every rule reads them.
    """
    schema = f"seed_url string, crawled_at string, pages array<struct<{_struct(PAGE)}>>, crawl_stats {CRAWL_STATS}, crawl_diagnostics {CRAWL_DIAGNOSTICS}, raw_scrapy_stats map<string, string>, unfetched_urls array<string>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("crawl_id", F.col("_metadata.file_path"))
    crawl = raw.select("crawl_id", "seed_url", "crawled_at", "crawl_stats", "crawl_diagnostics", F.try_element_at("raw_scrapy_stats", F.lit("finish_reason")).alias("finish_reason"), *raw_counts(F.col("raw_scrapy_stats")))
    pages = raw.select("crawl_id", F.posexplode("pages").alias("page_seq", "p")).select("crawl_id", F.col("page_seq").cast("bigint").alias("page_seq"), "p.*")
    for c in ("url", "final_url", "status_code", "content_type", "depth"):
        pages = pages.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a page lacks {c}"))).otherwise(F.col(c)))
    u = F.col("u")
    unfetched = raw.select("crawl_id", F.posexplode("unfetched_urls").alias("seq", "u")).select("crawl_id", F.col("seq").cast("bigint").alias("seq"), F.when(u.startswith("{"), F.get_json_object(u, "$.url")).otherwise(u).alias("url"), F.when(u.startswith("{"), F.get_json_object(u, "$.reason")).alias("reason"))
    return Crawl(crawl, written(complete_pages(pages)), unfetched)


def _struct(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl).fields)


def crawl_statistics(pages: DataFrame) -> DataFrame:
    """Counts by crawl: html pages (content type contains text/html), successful (below 400), failed (the other html pages), non-html responses."""
    html = F.coalesce(F.col("content_type").contains("text/html"), F.lit(False))
    return pages.groupBy("crawl_id").agg(
        F.count("*").alias("responses_received"),
        F.count_if(html).alias("html_pages_crawled"),
        F.count_if(html & (F.col("status_code") < 400)).alias("successful_pages"),
        F.count_if(html & (F.col("status_code") >= 400)).alias("failed_pages"),
        F.count_if(~html).alias("non_html_responses"),
    )


def frontier(seed: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first reach over stored links (url, link): (crawl_id, url, depth, parent_url) of every address within ``max_depth`` of the seeds (crawl_id, url).

    One anti join a level; the driver sees only whether a level is empty.
    """
    seen = seed.select("crawl_id", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"))
    level = seen
    for depth in range(1, max_depth + 1):
        step = level.select("crawl_id", "url").join(links.select("crawl_id", "url", "link"), ["crawl_id", "url"]).groupBy("crawl_id", F.col("link").alias("url")).agg(F.min("url").alias("parent_url"))
        level = step.join(seen.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti").select("crawl_id", "url", F.lit(depth).alias("depth"), "parent_url")
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen
