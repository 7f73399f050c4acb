"""Rules on the link graph and on whole crawls, as equi-joins, an anti join and aggregations."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percentage, squeeze_out
from ..functions.urls import url_join
from ..sources.crawl import Crawl
from .catalog import finding, fire
from .grouping import smallest
from .page_rules import html_ok


def url_graph(pages: DataFrame) -> DataFrame:
    """(crawl_id, target, t_status, t_redirected): one row a url, its last page wins."""
    last = F.max_by(F.struct("status_code", F.size("redirect_chain").alias("hops")), "page_seq").alias("t")
    return pages.groupBy("crawl_id", F.col("url").alias("target")).agg(last).select("crawl_id", "target", F.col("t.status_code").alias("t_status"), (F.col("t.hops") > 0).alias("t_redirected"))


def canonical_rules(pages: DataFrame) -> DataFrame:
    c = F.col("extracted.canonical")
    has = html_ok() & c.isNotNull() & (c != "")
    p = pages.where(has).select("crawl_id", "page_seq", "url", url_join(F.coalesce("final_url", "url"), c).alias("target"))
    p = p.join(url_graph(pages), ["crawl_id", "target"])
    make = lambda rule: finding(rule, F.col("url"), F.col("target"), source="canonical", field="canonical")
    return fire(p, (F.col("t_status") >= 400, make("AI-CANONICAL-002")), (F.col("t_redirected"), make("AI-CANONICAL-003")))


def link_edges(pages: DataFrame) -> DataFrame:
    return pages.select("crawl_id", "page_seq", "url", F.explode("extracted.internal_links").alias("target"))


def link_rules(pages: DataFrame) -> DataFrame:
    """Links to pages that failed or were redirected; the first five targets in order of address are named."""
    hit = link_edges(pages.where(html_ok())).join(url_graph(pages).where("t_status >= 400 or t_redirected"), ["crawl_id", "target"])
    first = lambda when: F.slice(F.array_sort(F.collect_set(F.when(when, F.col("target")))), 1, 5)
    g = hit.groupBy("crawl_id", "page_seq", "url").agg(first(F.col("t_status") >= 400).alias("broken"), first(F.col("t_redirected")).alias("moved"))
    make = lambda rule, c: (F.size(c) > 0, finding(rule, F.col("url"), F.array_join(c, ", "), source="internal_links", field="internal_links"))
    return fire(g, make("AI-LINK-001", "broken"), make("AI-LINK-002", "moved"))


def orphan_rule(pages: DataFrame, crawl: DataFrame) -> DataFrame:
    """Pages below the seed that no page links to, in crawls that ended by themselves and left nothing unfetched."""
    d = "crawl_diagnostics."
    whole = crawl.where((F.col(d + "crawl_termination_reason") == "finished") & (F.coalesce(F.col(d + "pages_discovered_not_fetched"), F.lit(0)) == 0)).select("crawl_id")
    linked = link_edges(pages).select("crawl_id", F.col("target").alias("url")).distinct()
    p = pages.where(html_ok() & (F.col("depth") > 0)).select("crawl_id", "page_seq", "url").join(whole, "crawl_id", "left_semi").join(linked, ["crawl_id", "url"], "left_anti")
    return fire(p, (F.lit(True), finding("AI-LINK-003", F.col("url"), F.lit("0 incoming internal links found"), source="graph", field="incoming_links")))


def _cluster_ids(batches):
    """(crawl_id, h, key) of clusters whose addresses come in order: a digest that every address passes through, none of which is kept."""
    last, digest = None, None
    for batch in batches:
        out = []
        for crawl, h, url in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if (crawl, h) != last:
                out += [(*last, digest.hexdigest())] if last else []
                last, digest = (crawl, h), hashlib.sha256(b"AI-CONTENT-001")
            digest.update((url or "").encode("utf-8", "surrogatepass"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["crawl_id", "h", "key"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*last, digest.hexdigest())], ["crawl_id", "h", "key"])


def duplicate_rule(pages: DataFrame) -> DataFrame:
    """Pages whose texts are equal without white space. A finding's id hashes all addresses of its cluster in order, so they pass through one task, which keeps none; counts and the first five come from shares."""
    text = squeeze_out(F.col("extracted.visible_text"))
    p = pages.where(html_ok()).select("crawl_id", "page_seq", "url", text.alias("t")).where("t <> ''").select("crawl_id", "page_seq", "url", F.sha2("t", 256).alias("h"))
    total = pages.groupBy("crawl_id").agg(F.count("*").alias("pages"))
    key = ["crawl_id", "h"]
    several = p.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(*key)
    members = p.join(several, key, "left_semi")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by a column of its own: Spark drops an exchange on the join's keys, and then tears clusters apart where that join becomes a broadcast while it runs
    dealt = members.select(*key, "url", F.xxhash64(*key).alias("part")).repartition(parts, "part")
    ids = dealt.sortWithinPartitions(*key, "url").mapInArrow(_cluster_ids, "crawl_id string, h string, key string")
    g = smallest(members.select(*key, F.struct("page_seq", "url").alias("x")), key, "x", 5).withColumnRenamed("sample", "m").join(ids, key).join(total, "crawl_id")
    first = F.element_at("m", 1)
    made = finding("AI-CONTENT-001", first["url"], F.concat(F.lit("Exact duplicate across "), F.col("n").cast("string"), F.lit(" pages")), key=[F.col("key")], source="extracted", field="visible_text", seq=first["page_seq"])
    n, pages, urls = F.col("n"), F.col("pages"), F.transform("m", lambda x: x["url"])
    more = {"id": F.upper(F.concat(F.lit("F-AI-CONTENT-001-"), F.substring("key", 1, 32))), "pages_checked": pages, "pages_affected": n, "affected_percentage": F.bround(percentage(n, pages), 2), "sample": urls, "sample_count": n, "truncated": n > 5}
    return fire(g, (F.lit(True), made), carry=("m", "n", "pages"), more=more)


def robots_rule(crawl: DataFrame, unfetched: DataFrame) -> DataFrame:
    """One finding for a crawl with addresses that robots.txt blocked, on its seed."""
    g = smallest(unfetched.where("reason = 'robots_blocked'").select("crawl_id", F.struct("seq", "url").alias("x")), ["crawl_id"], "x", 3).withColumnRenamed("sample", "m")
    g = g.join(crawl.select("crawl_id", "seed_url"), "crawl_id")
    observed = F.concat(F.col("n").cast("string"), F.lit(" URLs blocked. Examples: "), F.array_join(F.transform("m", lambda x: x["url"]), ", "))
    return fire(g, (F.lit(True), finding("AI-ROBOTS-001", F.col("seed_url"), observed, source="unfetched_urls", field="robots_blocked", seq=F.lit(-1))))


def evaluate(c: Crawl) -> DataFrame:
    return canonical_rules(c.pages).union(link_rules(c.pages)).union(orphan_rule(c.pages, c.crawl)).union(duplicate_rule(c.pages)).union(robots_rule(c.crawl, c.unfetched))
