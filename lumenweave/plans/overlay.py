"""An overlay on the raw pages, by arithmetic on page_id, that triggers rules which the raw pages cannot.

Each expression is plain SQL that reads the same in Spark and in other engines; arrays are built from the scalars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.crawl import CRAWL, Crawl, complete_pages
from ..sources.tables import written

URL = "concat('https://site.example/p', cast(page_id as varchar(20)))"
SCALARS = {
    "url": URL,
    "status_code": "case page_id % 20 when 3 then 404 when 7 then 500 else 200 end",
    "content_type": "case when page_id % 11 = 5 then 'image/png' when page_id % 13 = 2 then 'text/html; charset=utf-8' else 'text/html' end",
    "depth": "cast(page_id % 6 as int)",
    "title": "case page_id % 9 when 0 then null when 4 then '  ' else concat('Title ', cast(page_id as varchar(20))) end",
    "meta_description": "case page_id % 7 when 0 then null when 1 then '' when 2 then ' ' else 'About it' end",
    "robots": "case page_id % 10 when 1 then 'NoIndex' when 2 then 'noindex, nofollow' when 3 then 'nofollow' when 4 then 'index, follow' end",
    "n_h1": "cast(page_id % 4 as int)",
    "page_type": "case page_id % 5 when 0 then 'article' when 1 then 'product' when 2 then 'fragment' else 'unknown' end",
    "hops": "case page_id % 8 when 5 then 1 when 6 then 2 when 7 then 3 else 0 end",
    "canonical": "case page_id % 6 when 0 then null when 1 then '' else concat('p', cast((page_id * 7 + 1) % 300 as varchar(20))) end",
    "link_a": "case when page_id % 3 = 0 then concat('https://site.example/p', cast(page_id as varchar(20)), '#top') else concat('https://site.example/p', cast((page_id * 7 + 1) % 300 as varchar(20))) end",
    "link_b": "case when page_id % 3 = 0 then null else concat('https://site.example/p', cast((page_id * 3 + 2) % 300 as varchar(20))) end",
    "n_images": "cast(page_id % 4 as int)",
    "alt_a": "case page_id % 3 when 0 then 'a view' when 1 then ' ' end",
    "alt_b": "case when page_id % 4 = 2 then 'another' end",
    "malformed": "case when page_id % 12 = 4 then cast(page_id % 5 as int) else 0 end",
    "text_length": "cast((page_id * 13) % 120 as int)",
    "content": "case when page_id % 4 = 0 then concat('Same text ', cast(page_id % 40 as varchar(20))) when page_id % 4 = 1 then '  ' else concat('Own ', cast(page_id as varchar(20)), ' text') end",
    # five kinds of date; the epoch of day numbers is 1970-01-01
    "pub": "case page_id % 7 when 0 then 'yesterday' when 1 then '2024-02-30' when 2 then '2099-01-01' when 3 then '2019-05-06T07:08:09+02:00' when 4 then '2024-03-01' when 5 then '2021-08-01T00:00:00Z' end",
    "mod": "case page_id % 4 when 0 then '2024-01-01' when 1 then '2024-09-01' when 2 then 'soon' end",
    "ld": "case page_id % 3 when 0 then '2024-03-02T01:00:00+03:00' when 1 then '2022-01-01' end",
}
AUDIT_TIME = "2024-09-04T00:00:00Z"


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", *[f"{e.replace('varchar(20)', 'string')} as {c}" for c, e in SCALARS.items()])


def crawl(spark: SparkSession, sf_dir: str) -> Crawl:
    f = flat(spark, sf_dir)
    some = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    date = lambda c, source, field: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), F.lit(source).alias("source"), F.lit(field).alias("field")))
    nothing = F.array().cast("array<string>")
    links = F.array().cast("array<struct<url: string, text: string>>")
    extracted = F.struct(
        "title", "meta_description", some(F.col("robots")).alias("meta_robots"), F.lit("en").alias("language"), F.col("content").alias("visible_text"),
        F.transform(F.slice(F.array(F.lit("One"), F.lit("Two"), F.lit("Three")), F.lit(1), F.col("n_h1")), lambda x: x).alias("h1s"), nothing.alias("h2s"), nothing.alias("h3s"), nothing.alias("headings"),
        F.array_distinct(some(F.col("link_a"), F.col("link_b"))).alias("internal_links"), nothing.alias("external_links"), links.alias("detailed_internal_links"), links.alias("detailed_external_links"),
        F.slice(F.array(F.lit("a.png"), F.lit("b.png"), F.lit("c.png")), F.lit(1), F.col("n_images")).alias("image_urls"), some(F.col("alt_a"), F.col("alt_b")).alias("image_alts"), "canonical", nothing.alias("json_ld"), nothing.alias("parsed_json_ld"),
        nothing.alias("og_tags"), nothing.alias("twitter_metadata"), some(date("pub", "meta", "article:published_time"), date("mod", "meta", "article:modified_time"), date("ld", "json_ld", "datePublished")).alias("date_candidates"), "page_type",
    )
    diagnostics = F.struct(F.lit(True).alias("extraction_success"), nothing.alias("extraction_errors"), F.col("malformed").alias("malformed_jsonld_count"), F.lit(True).alias("text_extraction_success"), F.lit(0).cast("bigint").alias("html_size"), F.col("text_length").alias("visible_text_length"))
    chain = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), F.col("hops")), lambda k: F.concat(F.col("url"), F.lit("?r="), k.cast("string")))
    pages = f.select(F.lit("overlay").alias("crawl_id"), F.col("page_id").alias("page_seq"), "url", F.col("url").alias("final_url"), "status_code", "content_type", "depth", F.lit(None).cast("string").alias("parent_url"), chain.alias("redirect_chain"), F.lit("success").alias("crawl_status"), F.lit("").alias("raw_html"), extracted.alias("extracted"), diagnostics.alias("diagnostics"))
    head = spark.createDataFrame([("overlay", "https://site.example/p0", AUDIT_TIME, None, {"crawl_termination_reason": "finished", "pages_discovered_not_fetched": 0}, "finished")], CRAWL)
    unfetched = f.where("page_id % 25 = 6").select(F.lit("overlay").alias("crawl_id"), F.col("page_id").alias("seq"), F.concat(F.lit("https://site.example/hidden"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("page_id") % 2 == 0, F.lit("robots_blocked")).otherwise(F.lit("offsite")).alias("reason"))
    # written, as a real crawl's pages are: else the overlay's expressions would be copied into every rule
    return Crawl(head, written(complete_pages(pages)), unfetched)
