"""Registered queries of the audit engine; ``oracle`` holds their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.ids import finding_id, group_id
from ..functions.text import markdown_escape, percentage, squeeze_out, words
from ..functions.urls import defragment, has_scheme_and_host, host_of, in_domains, path_of
from ..operators import enrich as E
from ..operators import graph_rules, grouping, page_rules, semantic, validation
from ..sources.crawl import CRAWL, UNFETCHED, Crawl, complete_pages, crawl_statistics
from ..sources.html import extract_pages
from ..sources.tables import written
from . import audit as A
from . import checks, crawls, overlay, rendered

FLAT = ["rule_id", "id", "page", "severity", "title", "source", "field", "observed_value"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def overlay_page_rules(spark, sf_dir, crawl=overlay.crawl):
    """Page-local discoverability rules."""
    return page_rules.evaluate(crawl(spark, sf_dir).pages).where("pipeline = 'ai_discoverability'").select(*FLAT)


def overlay_engagement(spark, sf_dir, crawl=overlay.crawl):
    """P14, P15."""
    return page_rules.evaluate(crawl(spark, sf_dir).pages, {"ENG-NAV-001", "ENG-MEDIA-001"}).select("rule_id", "id", "page", "severity", "details")


def overlay_freshness(spark, sf_dir, crawl=overlay.crawl):
    """P16 to P23, on dates parsed once."""
    c = crawl(spark, sf_dir)
    return page_rules.evaluate_freshness(page_rules.with_dates(c.pages, c.crawl)).select(*FLAT)


def overlay_canonical(spark, sf_dir, crawl=overlay.crawl):
    """J1, J2, J3."""
    return graph_rules.canonical_rules(crawl(spark, sf_dir).pages).select(*FLAT)


def overlay_links(spark, sf_dir, crawl=overlay.crawl):
    """J1, J4, J5."""
    return graph_rules.link_rules(crawl(spark, sf_dir).pages).select(*FLAT)


def overlay_orphans(spark, sf_dir, crawl=overlay.crawl):
    """J6."""
    c = crawl(spark, sf_dir)
    return graph_rules.orphan_rule(c.pages, c.crawl).select(*FLAT)


def overlay_duplicates(spark, sf_dir, crawl=overlay.crawl):
    """G1 with its counts."""
    return graph_rules.duplicate_rule(crawl(spark, sf_dir).pages).select("rule_id", "id", "page", "observed_value", "pages_checked", "pages_affected", "affected_percentage", F.array_join("sample", " ").alias("sample"), "truncated")


def overlay_robots(spark, sf_dir):
    """G2."""
    c = overlay.crawl(spark, sf_dir)
    return graph_rules.robots_rule(c.crawl, c.unfetched).select(*FLAT)


def overlay_crawl_stats(spark, sf_dir):
    """G5."""
    return crawl_statistics(overlay.crawl(spark, sf_dir).pages).drop("crawl_id")


def overlay_profile(spark, sf_dir):
    """G13, G16."""
    return grouping.profile(overlay.crawl(spark, sf_dir).pages).drop("crawl_id")


def document_duplicates(spark, sf_dir):
    """G1's grouping on real texts: clusters of documents equal without white space."""
    d = _read(spark, sf_dir, "documents").select("doc_id", squeeze_out(F.col("text")).alias("t")).where("t <> ''").select("doc_id", F.sha2("t", 256).alias("h"))
    return d.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


def document_thin(spark, sf_dir):
    """P13 on real texts."""
    n = F.char_length("text").cast("bigint")
    return _read(spark, sf_dir, "documents").where((n > 0) & (n < 50)).select("doc_id", finding_id(F.lit("AI-CONTENT-002"), F.col("doc_id").cast("string")).alias("id"), n.alias("observed_value"))


def document_gate(spark, sf_dir):
    """N1 and F17 on real texts."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.concat(F.lit("https://x.example/"), F.when(F.col("doc_id") % 9 == 0, F.lit("Login/")).otherwise(F.lit("d/")), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.struct(F.col("text").alias("visible_text"), F.concat("lang", F.lit("-XX")).alias("language"), F.lit("t").alias("title")).alias("extracted"))
    return d.select("doc_id", F.coalesce(semantic.gate(), F.lit("eligible")).alias("state"), F.size(words(F.col("extracted.visible_text"))).cast("bigint").alias("n_words"))


def document_truncation(spark, sf_dir):
    """Texts over 1500 words are cut to them, others stay as they are."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(semantic.truncated(F.col("text")), 256).alias("text_sha256"))


def semantic_candidates(spark, sf_dir):
    """N1, O6 on all documents: of the pages that pass the gate the first 100 addresses are analysed."""
    d = _read(spark, sf_dir, "documents")
    p = d.select(F.lit("c").alias("crawl_id"), F.col("doc_id").alias("page_seq"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.concat(F.lit("https://x.example/d/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("final_url"), F.struct(F.col("text").alias("visible_text"), F.col("lang").alias("language"), F.lit("t").alias("title")).alias("extracted"))
    return semantic.candidates(p).select(F.col("page_seq").alias("doc_id"), F.coalesce("state", F.lit("analysed")).alias("state"))


def scalar_ids(spark, sf_dir):
    """F9, F10, F16, D1's signature."""
    o = _read(spark, sf_dir, "documents")
    return o.select("doc_id", finding_id(F.lit("AI-X-1"), F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("finding"), group_id(F.coalesce("lang", F.lit("")), F.lit("AI-X-1"), F.lit("deterministic"), F.coalesce("source", F.lit(""))).alias("grp"), F.sha2(markdown_escape(F.concat(F.lit("<`"), "source", F.lit("`>"))), 256).alias("escaped"))


def scalar_urls(spark, sf_dir):
    """F12 to F14, S3."""
    u = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", defragment(F.concat("url", F.lit("#x"))).alias("bare"), host_of(u).alias("host"), path_of(u).alias("path"), has_scheme_and_host(u).alias("ok"), in_domains(host_of(u), F.array(F.lit("example.com"), F.lit("example.org"))).alias("inside"))


def scalar_dates(spark, sf_dir):
    """F4 to F8, F21 on order dates."""
    a = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    b = a + (F.col("o_orderkey") % 100) * F.lit(D.HOUR)
    audit = F.unix_micros(F.lit("1998-06-01").cast("timestamp"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", D.iso(b).alias("iso"), D.is_future(b, audit).alias("future"), D.hours_between(a, b).alias("hours"), D.valid_chronology(b, a).alias("in_order"), (D.utc_day(a) == D.utc_day(b)).alias("same_day"), D.age_days(b, audit).alias("age_days"))


def scalar_percentages(spark, sf_dir):
    """F20."""
    return _read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("part"), F.count("*").alias("whole")).select("source", F.bround(percentage(F.col("part"), F.col("whole")), 2).alias("pct"))



def overlay_groups(spark, sf_dir):
    """D1, D3, G3, G4, O2, O4 over the page-local discoverability findings."""
    c = overlay.crawl(spark, sf_dir)
    f = grouping.deduplicate(page_rules.evaluate(c.pages).where("pipeline = 'ai_discoverability'"))
    g = grouping.group(f, c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages")))
    return g.select("group_id", "rule_id", "page", "observed_value", "pages_checked", "pages_affected", F.round("affected_percentage", 9).alias("affected_percentage"), F.array_join("sample", " ").alias("sample"), "truncated", "n_sources")


def overlay_score(spark, sf_dir):
    """G8, G9, O3 over those groups: the summary row, and each group's place in the report."""
    c = overlay.crawl(spark, sf_dir)
    f = grouping.deduplicate(page_rules.evaluate(c.pages).where("pipeline = 'ai_discoverability'"))
    g = grouping.group(f, c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages")))
    return grouping.summary(g, c.crawl).drop("crawl_id")


def overlay_counts(spark, sf_dir):
    """Raw findings by severity."""
    f = page_rules.evaluate(overlay.crawl(spark, sf_dir).pages)
    return grouping.raw_counts(f, "severity").drop("crawl_id")


def overlay_finding_checks(spark, sf_dir):
    """Errors of duplicate-content findings, whose rounded percentage may fail the arithmetic check."""
    c = overlay.crawl(spark, sf_dir)
    f = validation.validate_findings(graph_rules.duplicate_rule(c.pages), c.pages)
    return f.select("id", "page", F.size("errors").cast("bigint").alias("n_errors"))


def overlay_rule_diagnostics(spark, sf_dir):
    """G10, V9's catalog: every rule with its counts and status."""
    c = overlay.crawl(spark, sf_dir)
    checked = written(validation.validate_findings(written(A.run_rules(c)), c.pages))
    return validation.rule_diagnostics(checked, A.default_registry().table(spark), c.crawl).select("rule_id", "status", "findings_generated", "valid_findings", "invalid_findings")


def overlay_bad_findings(spark, sf_dir):
    """V1 to V4, J7 where they fail: findings spoiled in one of 13 ways by page number, each with its errors."""
    c = overlay.crawl(spark, sf_dir)
    f = written(page_rules.evaluate(c.pages, {"AI-META-003"}))
    k = F.col("seq") % 13
    spoil = lambda i, name, bad: F.when(k == i, bad).otherwise(F.col(name)).alias(name)
    ways = {"title": (0, F.lit("")), "pipeline": (1, F.lit(None).cast("string")), "severity": (2, F.lit("")), "action": (3, F.lit("")), "affected_percentage": (6, F.lit(50.0)), "sample_count": (7, F.lit(3).cast("bigint")), "sample": (8, F.array(F.lit("no address"))), "truncated": (9, F.lit(True))}
    f = f.withColumn("sample", F.coalesce("sample", F.array(F.col("page")))).withColumn("sample_count", F.lit(1).cast("bigint")).withColumn("truncated", F.lit(False))
    more = {"page": F.when(k == 4, F.lit("no address")).when(k == 5, F.concat("page", F.lit("/unknown"))).otherwise(F.col("page")).alias("page"), "pages_affected": F.when(k == 10, F.lit(2)).otherwise(F.col("pages_affected")).cast("bigint").alias("pages_affected")}
    bad = f.select(*[spoil(ways[n][0], n, ways[n][1]) if n in ways else more.get(n, F.col(n)) for n in f.columns])
    return validation.validate_findings(bad, c.pages).select(F.col("seq").alias("page_id"), F.size("errors").cast("bigint").alias("n_errors"))


def overlay_finding_dedup(spark, sf_dir):
    """Findings told twice, and once more with another expected value, which is no part of the signature, come back once by rule; another observed value makes another finding."""
    f = written(page_rules.evaluate(overlay.crawl(spark, sf_dir).pages).where("pipeline = 'ai_discoverability'"))
    twice = f.union(f).union(f.withColumn("expected_value", F.lit("other"))).union(f.where("seq % 2 = 0").withColumn("observed_value", F.lit("another")))
    return grouping.deduplicate(twice).groupBy("rule_id").agg(F.count("*").alias("findings"))


def overlay_scores(spark, sf_dir):
    """Each rule's groups as a crawl of their own, and a crawl without any."""
    c = overlay.crawl(spark, sf_dir)
    g = grouping.group(grouping.deduplicate(page_rules.evaluate(c.pages)), c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages")))
    g = written(g.withColumn("crawl_id", F.col("rule_id")))
    crawls = g.select("crawl_id").distinct().union(spark.createDataFrame([("none",)], "crawl_id string"))
    return grouping.summary(g, crawls)


def overlay_group_checks(spark, sf_dir):
    """Groups with validity and error counts; one rule's groups fail, and a second where the first page is missing."""
    c = overlay.crawl(spark, sf_dir)
    f = written(grouping.deduplicate(written(A.run_rules(c))))
    g = validation.validate_groups(grouping.group(f, c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages"))), f, c)
    return g.select("group_id", "rule_id", "valid", "bad_sources", F.size("errors").cast("bigint").alias("n_errors"))


def overlay_compression(spark, sf_dir):
    """G15."""
    c = overlay.crawl(spark, sf_dir)
    f = written(grouping.deduplicate(written(A.run_rules(c))))
    return grouping.compression(f, grouping.group(f, c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages"))), c.crawl).drop("crawl_id")


def _html(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    return extract_pages(p.select("page_id", "url", F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), F.col("html").alias("raw_html")))


def html_crawl(spark, sf_dir) -> Crawl:
    """The raw pages as one crawl, extracted and written."""
    h = _html(spark, sf_dir)
    pages = h.select(F.lit("pages").alias("crawl_id"), F.col("page_id").alias("page_seq"), "url", "final_url", F.lit(200).alias("status_code"), "content_type", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.array().cast("array<string>").alias("redirect_chain"), F.lit("success").alias("crawl_status"), F.lit("").alias("raw_html"), "extracted", "diagnostics")
    head = spark.createDataFrame([("pages", "https://site.example/", overlay.AUDIT_TIME, None, {"crawl_termination_reason": "finished", "pages_discovered_not_fetched": 0}, "finished")], CRAWL)
    return Crawl(head, written(complete_pages(pages)), spark.createDataFrame([], UNFETCHED))


def html_findings(spark, sf_dir):
    """The findings on raw pages, from HTML to rules. Few rules fire on these pages, each on all of them; ``rendered_*`` hold extraction against all rules."""
    return A.run_rules(html_crawl(spark, sf_dir)).select("rule_id", "id", "page", "severity", "observed_value")


def html_groups(spark, sf_dir):
    """The whole audit of the raw pages, from HTML to valid groups."""
    return A.audit(html_crawl(spark, sf_dir), overlay.AUDIT_TIME).groups.select("group_id", "rule_id", "pages_checked", "pages_affected", "n_sources")


def html_fields(spark, sf_dir):
    """E1, E3, E4, E20 on raw pages."""
    return _html(spark, sf_dir).select("page_id", "extracted.title", "extracted.language", F.size("extracted.h1s").cast("bigint").alias("n_h1"), F.col("diagnostics.html_size").alias("html_size"), F.size("extracted.image_urls").cast("bigint").alias("n_images"))


def html_all(spark, sf_dir):
    """E1 to E22, all fields of raw pages."""
    return _html(spark, sf_dir).select("page_id", F.to_json("extracted").alias("extracted"), F.to_json("diagnostics").alias("diagnostics"))


def audit_markdown(spark, sf_dir):
    """The whole audit to the Markdown report: N2 to N11, K1, K2."""
    return A.audit(overlay.crawl(spark, sf_dir), overlay.AUDIT_TIME).markdown


def audit_json(spark, sf_dir):
    return A.audit(overlay.crawl(spark, sf_dir), overlay.AUDIT_TIME).json


def audit_groups(spark, sf_dir):
    """The whole audit's valid groups in report order."""
    a = A.audit(overlay.crawl(spark, sf_dir), overlay.AUDIT_TIME)
    return grouping.report_order(a.groups).select("group_id", "pipeline", "severity", "title", "pages_affected", "outcome")


def enrichment_counts(spark, sf_dir):
    """G12."""
    return E.enrich_counts(A.audit(overlay.crawl(spark, sf_dir), overlay.AUDIT_TIME).groups).drop("crawl_id")


def _over(query, crawl):
    """An overlay's query on another crawl of the same rows."""

    def run(spark, sf_dir):
        return query(spark, sf_dir, crawl)

    run.__doc__ = f"{query.__doc__} On pages rendered as HTML and extracted: E1 to E19."
    return run


QUERIES = {
    f.__name__: f
    for f in (
        overlay_page_rules, overlay_engagement, overlay_freshness, overlay_canonical, overlay_links, overlay_orphans, overlay_duplicates, overlay_robots, overlay_crawl_stats, overlay_profile, document_duplicates, document_thin,
        document_gate, document_truncation, semantic_candidates, scalar_ids, scalar_urls, scalar_dates, scalar_percentages, overlay_groups, overlay_score, overlay_counts, overlay_finding_checks, overlay_bad_findings, overlay_finding_dedup, overlay_scores, overlay_rule_diagnostics,
        overlay_group_checks, overlay_compression, html_fields, html_findings, html_groups, html_all, audit_markdown, audit_json, audit_groups, enrichment_counts,
    )
}
QUERIES |= crawls.QUERIES | checks.QUERIES | {f"rendered_{q.__name__.removeprefix('overlay_')}": _over(q, rendered.crawl) for q in (overlay_page_rules, overlay_engagement, overlay_freshness, overlay_canonical, overlay_links, overlay_orphans, overlay_duplicates)}
