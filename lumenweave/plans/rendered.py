"""The overlay's pages as HTML: the same fields, but read back from markup, so that extraction is held against the same SQL as the rules.

Fields that a page's HTML can't say stay what they are: status, content type, depth, redirects. A page that is no HTML has none of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.crawl import CRAWL, Crawl, complete_pages
from ..sources.html import extract_pages
from ..sources.tables import written
from .overlay import AUDIT_TIME, SCALARS

_IMAGE = "page_id % 11 = 5"
_NUMBER = "cast(page_id as varchar(20))"


def _only_html(value: str, other: str = "null") -> str:
    return f"case when {_IMAGE} then {other} else {value} end"


_VISIBLE = f"case page_id % 4 when 0 then concat('Same text ', cast(page_id % 40 as varchar(20))) when 1 then 'One' when 2 then concat('One Two Own ', {_NUMBER}, ' text') else concat('One Two Three Own ', {_NUMBER}, ' text') end"
#: what the rules see of the rendered pages, in the place of the overlay's own values
RENDERED = SCALARS | {
    **{c: _only_html(SCALARS[c]) for c in ("title", "meta_description", "robots", "canonical", "link_a", "link_b", "alt_a", "alt_b", "pub", "mod", "ld")},
    **{c: _only_html(SCALARS[c], "0") for c in ("n_h1", "n_images", "malformed")},
    "link_a": _only_html(f"case when page_id % 3 = 0 then concat('https://site.example/p', {_NUMBER}) else concat('https://site.example/p', cast((page_id * 7 + 1) % 300 as varchar(20))) end"),
    "page_type": _only_html("case page_id % 5 when 0 then 'article' when 1 then 'product' else 'unknown' end", "'unknown'"),
    "content": _only_html(_VISIBLE, "''"),
    "text_length": _only_html(f"length({_VISIBLE})", "0"),
}

_type = "case page_id % 5 when 0 then 'Article' when 1 then 'Product' else 'WebPage' end"
#: markup by page number, plain SQL; a title of blanks, an empty attribute and a missing tag differ
HTML = "concat(" + ", ".join([
    "'<!DOCTYPE html><html lang=\"en\"><head>'",
    f"coalesce(concat('<title>', {SCALARS['title']}, '</title>'), '')",
    f"coalesce(concat('<meta name=\"description\" content=\"', {SCALARS['meta_description']}, '\">'), '')",
    f"coalesce(concat('<META content=\"', {SCALARS['robots']}, '\" name=robots>'), '')",
    f"coalesce(concat('<link href=\"', {SCALARS['canonical']}, '\" rel=\"canonical\"/>'), '')",
    f"coalesce(concat('<meta property=\"article:published_time\" content=\"', {SCALARS['pub']}, '\">'), '')",
    f"coalesce(concat('<meta property=\"article:modified_time\" content=\"', {SCALARS['mod']}, '\">'), '')",
    f"concat('<script type=\"application/ld+json\">{{\"@type\":\"', {_type}, '\"', coalesce(concat(',\"datePublished\":\"', {SCALARS['ld']}, '\"'), ''), '}}</script>')",
    f"repeat('<script type=\"application/ld+json\">{{\"a\": </script>', {SCALARS['malformed']})",
    "'<style>h1 { }</style><script>var unseen = \"<p>\";</script></head><body>'",
    "substring('<h1>One</h1><h1>Two</h1><h1>Three</h1>', 1, case page_id % 4 when 0 then 0 when 1 then 12 when 2 then 24 else 38 end)",
    f"concat('<p>', {SCALARS['content']}, '<script>unseen()</script></p>')",
    f"coalesce(concat('<a href=\"', {SCALARS['link_a']}, '\"></a>'), '')",
    f"coalesce(concat('<a class=x href=''', {SCALARS['link_b']}, '''> </a><a>  </a><a href=\"mailto:x@site.example\"></a><a href=\"https://other.example/\"></a>'), '')",
    f"substring('<img src=\"a.png\"><img src=\"b.png\"><img src=\"c.png\">', 1, 17 * ({SCALARS['n_images']}))",
    f"coalesce(concat('<img alt=\"', {SCALARS['alt_a']}, '\">'), '')",
    f"coalesce(concat('<img alt=\"', {SCALARS['alt_b']}, '\">'), '')",
    "'</body></html>'",
]) + ")"


def crawl(spark: SparkSession, sf_dir: str) -> Crawl:
    """The overlay's crawl, with every field that HTML can hold extracted from the rendered page."""
    sql = lambda e: e.replace("varchar(20)", "string")
    outer = ("url", "status_code", "content_type", "depth", "hops")
    f = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", *[f"{sql(SCALARS[c])} as {c}" for c in outer], f"{sql(HTML)} as raw_html")
    chain = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), F.col("hops")), lambda k: F.concat(F.col("url"), F.lit("?r="), k.cast("string")))
    pages = extract_pages(f.select("page_id", "url", F.col("url").alias("final_url"), "status_code", "content_type", "depth", chain.alias("redirect_chain"), "raw_html"))
    pages = pages.select(F.lit("overlay").alias("crawl_id"), F.col("page_id").alias("page_seq"), "url", "final_url", "status_code", "content_type", "depth", F.lit(None).cast("string").alias("parent_url"), "redirect_chain", F.lit("success").alias("crawl_status"), F.lit("").alias("raw_html"), "extracted", "diagnostics")
    head = spark.createDataFrame([("overlay", "https://site.example/p0", AUDIT_TIME, None, {"crawl_termination_reason": "finished", "pages_discovered_not_fetched": 0}, "finished")], CRAWL)
    unfetched = f.where("page_id % 25 = 6").select(F.lit("overlay").alias("crawl_id"), F.col("page_id").alias("seq"), F.concat(F.lit("https://site.example/hidden"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("page_id") % 2 == 0, F.lit("robots_blocked")).otherwise(F.lit("offsite")).alias("reason"))
    return Crawl(head, written(complete_pages(pages)), unfetched)


def pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html) of the rendered pages."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{HTML.replace('varchar(20)', 'string')} as html")
