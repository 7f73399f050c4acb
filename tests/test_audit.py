"""Rules, validation, grouping, semantic and enrichment stages, and reports on small crawls."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lumenweave.functions.dates import parse_one
from lumenweave.functions.ids import group_id
from lumenweave.operators import enrich as E
from lumenweave.operators import graph_rules, grouping, page_rules, semantic, validation
from lumenweave.operators.catalog import Registry, Rule
from lumenweave.plans import audit as A
from lumenweave.sources.crawl import CRAWL, UNFETCHED, Crawl, complete_pages, frontier, load_json, raw_counts
from lumenweave.sources.tables import written
from lumenweave.sources.html import extract, page_type

PAGE_DDL = "crawl_id string, page_seq bigint, " + __import__("lumenweave.sources.crawl", fromlist=["PAGE"]).PAGE
BASE = {"title": "Valid Title", "meta_description": "Valid description", "h1s": ["Valid H1"], "visible_text": "A valid page of text. " * 5, "page_type": "unknown", "canonical": "https://example.com/"}


def make(spark, pages, unfetched=(), when="2024-09-04T00:00:00Z", ended="finished", seed="https://example.com/"):
    rows = []
    for i, p in enumerate(pages):
        p = dict(p)
        url = p.pop("url", f"https://example.com/{i}")
        x = BASE | p.pop("x", {})
        d = {"malformed_jsonld_count": 0, "visible_text_length": len(x["visible_text"] or "")} | p.pop("d", {})
        rows.append({"crawl_id": "c", "page_seq": i, "url": url, "final_url": url, "status_code": 200, "content_type": "text/html", "depth": 1, "redirect_chain": [], "raw_html": "", "extracted": x, "diagnostics": d} | p)
    head = [("c", seed, when, None, {"crawl_termination_reason": ended, "pages_discovered_not_fetched": 0}, "finished")]
    return Crawl(spark.createDataFrame(head, CRAWL), written(complete_pages(spark.createDataFrame(rows, PAGE_DDL).coalesce(2))), spark.createDataFrame([("c", i, *u) for i, u in enumerate(unfetched)], UNFETCHED))


def fired(c):
    got = {}
    for r in A.run_rules(c).collect():
        got.setdefault(r.rule_id, []).append(r)
    return got


def pages_of(got, rule):
    return sorted(int(r.page.rsplit("/", 1)[1]) for r in got.get(rule, []))


def test_page_rules(spark):
    cases = [
        {"status_code": 404}, {"status_code": 500}, {"status_code": 404, "content_type": "image/png"}, {"x": {"meta_robots": ["NoIndex"]}}, {"x": {"meta_robots": ["nofollow"]}}, {"x": {"meta_robots": ["nofollow"], "page_type": "fragment"}},
        {"redirect_chain": ["a", "b"]}, {"redirect_chain": ["a"]}, {"x": {"canonical": None}}, {"x": {"canonical": ""}}, {"depth": 4}, {"x": {"h1s": []}}, {"x": {"title": None}}, {"x": {"title": "  "}}, {"x": {"title": ""}}, {"x": {"meta_description": " "}},
        {"d": {"malformed_jsonld_count": 1}}, {"x": {"visible_text": "tiny"}}, {"x": {"visible_text": ""}}, {"x": {"meta_robots": ["index, follow"]}},
    ]
    got = fired(make(spark, cases))
    assert pages_of(got, "AI-CRAWL-001") == [0] and pages_of(got, "AI-CRAWL-002") == [1]
    assert pages_of(got, "AI-ROBOTS-002") == [3] and pages_of(got, "AI-ROBOTS-003") == [4]
    assert pages_of(got, "AI-REDIRECT-001") == [6] and got["AI-REDIRECT-001"][0].observed_value == "a -> b"
    assert pages_of(got, "AI-CANONICAL-001") == [8, 9] and pages_of(got, "AI-LINK-004") == [10] and pages_of(got, "AI-HTML-001") == [11]
    assert pages_of(got, "AI-META-001") == [12] and pages_of(got, "AI-META-002") == [13, 14] and pages_of(got, "AI-META-003") == [15]
    assert pages_of(got, "AI-SCHEMA-001") == [16] and pages_of(got, "AI-CONTENT-002") == [17]


def test_graph_rules(spark):
    u = "https://example.com/"
    pages = [
        {"url": u + "0", "depth": 0, "x": {"internal_links": [u + "1", u + "2", u + "3", u + "77"], "canonical": "1"}},
        {"url": u + "1", "status_code": 404}, {"url": u + "2", "redirect_chain": [u + "old"]}, {"url": u + "3", "x": {"canonical": "/2"}}, {"url": u + "4"},
        {"url": u + "5", "status_code": 500}, {"url": u + "5", "x": {"visible_text": "Another text that is long enough, to be no duplicate and not thin."}},
        {"url": u + "6", "x": {"internal_links": [u + "5"]}},
    ]
    c = make(spark, pages, [("https://example.com/b1", "robots_blocked"), ("https://example.com/b2", "offsite")])
    got = fired(c)
    assert pages_of(got, "AI-LINK-001") == [0] and got["AI-LINK-001"][0].observed_value == u + "1"  # 5's last page is fine
    assert pages_of(got, "AI-LINK-002") == [0] and pages_of(got, "AI-LINK-003") == [4, 6]
    assert pages_of(got, "AI-CANONICAL-002") == [0] and pages_of(got, "AI-CANONICAL-003") == [3]
    dup = got["AI-CONTENT-001"]
    assert len(dup) == 1 and dup[0].page == u + "0" and dup[0].pages_affected == 5 and dup[0].truncated is False
    assert got["AI-ROBOTS-001"][0].observed_value == "1 URLs blocked. Examples: https://example.com/b1"
    assert "AI-LINK-003" not in fired(make(spark, pages, ended="closespider_pagecount"))


def date(v, source="meta", field="article:published_time"):
    return {"value": v, "source": source, "field": field}


def test_freshness(spark):
    art = lambda *d, t="article": {"x": {"page_type": t, "date_candidates": list(d)}}
    mod = lambda v: date(v, field="article:modified_time")
    ld = lambda v: date(v, "json_ld", "datePublished")
    cases = [
        art(), art(t="unknown"), art(date("yesterday")), art(date("2024-02-30")), art(date("2099-01-01")), art(date("2024-03-01"), mod("2024-01-01")), art(date("2024-01-01"), mod("2024-03-01")),
        art(date("2024-05-05T23:00:00Z"), ld("2024-05-06T01:00:00Z")), art(date("2024-05-05T23:00:00Z"), ld("2024-05-06T01:00:00+02:00")), art(date("2022-09-05")), art(date("2022-09-04")), art(date("2022-09-03")), art(date("2021-09-05"), t="product"), art(date("2021-09-03"), t="product"), art(date("2010-01-01"), t="unknown"),
    ]
    got = fired(make(spark, cases))
    assert pages_of(got, "FR-DATE-001") == [0, 2, 3] and pages_of(got, "FR-DATE-002") == [2] and pages_of(got, "FR-DATE-003") == [3] and pages_of(got, "FR-DATE-004") == [4]
    assert pages_of(got, "FR-CONS-001") == [5] and pages_of(got, "FR-CONS-002") == [7]
    assert pages_of(got, "FR-STALE-001") == [10, 11] and pages_of(got, "FR-STALE-002") == [13]
    assert got["FR-DATE-004"][0].observed_value == "Future date: '2099-01-01' (Normalized: 2099-01-01T00:00:00+00:00) vs Audit Time: 2024-09-04T00:00:00+00:00"


def test_dates():
    assert parse_one("20240101")[1] == parse_one("2024-W01-1")[1] == parse_one(" 2024-01-01T00:00:00Z ")[1] == "VALID"
    assert [parse_one(v)[1] for v in ("2024", "2024-1-1", "now", "T12:00", "", None, "20240230")] == ["UNPARSEABLE"] * 7
    assert [parse_one(v)[1] for v in ("2024-02-30", "2024-01-01x", "2024-01-01T12:00:00 UTC")] == ["IMPOSSIBLE"] * 3


def test_engagement(spark):
    u = "https://example.com/"
    nav = lambda links, t="article", **k: {"x": {"page_type": t, "internal_links": links}, **k}
    img = lambda n, alts: {"x": {"image_urls": ["i"] * n, "image_alts": alts}}
    cases = [nav([]), nav([u + "1#a", u + "1"]), nav([u + "x"]), nav([], "unknown"), nav([], status_code=404), img(5, ["a"] * 3), img(5, []), img(1, [" "]), img(5, ["a"] * 5), img(1, ["a", "b"])]
    got = fired(make(spark, cases))
    assert pages_of(got, "ENG-NAV-001") == [0, 1] and pages_of(got, "ENG-MEDIA-001") == [5, 6, 7]
    assert json.loads(got["ENG-MEDIA-001"][0].details)["images_missing_alt"] in (1, 2, 5)


def test_grouping_and_ids(spark):
    cases = [{"status_code": 404} for _ in range(37)] + [{} for _ in range(13)]
    c = make(spark, cases)
    f = page_rules.evaluate(c.pages, {"AI-CRAWL-001"})
    f = f.union(f)
    n = c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages"))
    d = grouping.deduplicate(f)
    assert d.count() == 37
    for x in (d, d.repartition(5)):
        g = grouping.group(x, n).collect()[0]
        assert (g.pages_affected, g.affected_percentage, len(g.sample), g.truncated, g.n_sources) == (37, 74.0, 10, True, 37)
        assert g.sample == sorted(f"https://example.com/{i}" for i in range(37))[:10] and g.page == g.sample[0]
    one = spark.range(1).select(group_id(F.lit("ai_discoverability"), F.lit("AI-META-003"), F.lit("deterministic"), F.lit("low")).alias("g")).first().g
    import hashlib

    assert one == ("G-AI-META-003-" + hashlib.sha256(b"ai_discoverabilityAI-META-003deterministiclow").hexdigest()[:32]).upper()
    s = grouping.summary(grouping.group(d, n), c.crawl).collect()[0]
    assert (s.score, s.total_findings, s.high) == (80, 1, 1)
    assert grouping.summary(grouping.group(d.limit(0), n), c.crawl).collect()[0].score == 100


def test_validation(spark):
    c = make(spark, [{"status_code": 404}, {}], [("https://example.com/0", "x")], seed="https://example.com/seed")
    f = page_rules.evaluate(c.pages, {"AI-CRAWL-001"})
    ok = validation.validate_findings(f, c.pages).collect()[0]
    assert ok.errors == []
    lost = f.withColumn("page", F.lit("https://example.com/none")).union(f.withColumn("page", F.lit("nope"))).union(f.withColumn("pages_affected", F.lit(2).cast("bigint")))
    msgs = sorted(e for r in validation.validate_findings(lost.select(*f.columns), c.pages).collect() for e in r.errors)
    assert any("has no page" in m for m in msgs) and any("no address" in m for m in msgs) and any("More pages" in m for m in msgs)
    n = c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages"))
    g = validation.validate_groups(grouping.group(f, n), f, c).collect()[0]
    assert not g.valid and any("never fetched" in e for e in g.errors)


@pytest.mark.parametrize(("n", "total", "good"), [(2, 102, True), (5, 102, False)])
def test_rounded_percentage(spark, n, total, good):
    text = lambda i: "same " * 20 if i < n else f"own text of page {i}, which is long enough to be fine"
    c = make(spark, [{"x": {"visible_text": text(i)}} for i in range(total)])
    got = validation.validate_findings(graph_rules.duplicate_rule(c.pages), c.pages).collect()
    assert len(got) == 1 and (got[0].errors == []) == good


def test_duplicate_ids_where_a_join_becomes_a_broadcast(spark):
    """A cluster's addresses stay together when its join turns out small while the query runs, which frees Spark from dealing them by cluster."""
    # less than the pages' files let expect, more than the rows that come
    conf = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    c = make(spark, [{"x": {"visible_text": random.Random(i % 150).randbytes(10000).hex()}} for i in range(300)])
    c = Crawl(c.crawl, written(c.pages.repartition(12, "page_seq")), c.unfetched)
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = [r.id for r in graph_rules.duplicate_rule(c.pages).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    key = lambda i: "".join(sorted(f"https://example.com/{j}" for j in (i, i + 150)))
    assert sorted(got) == sorted("F-AI-CONTENT-001-" + hashlib.sha256(f"AI-CONTENT-001{key(i)}".encode()).hexdigest()[:32].upper() for i in range(150))


def test_canonical_to_error_flag(spark):
    c = make(spark, [{"x": {"canonical": "/1"}}, {"status_code": 404}])
    f = graph_rules.canonical_rules(c.pages)
    assert validation.validate_sources(f, c).collect()[0].source_errors
    assert not validation.validate_sources(f, c, several_canonicals=False).collect()[0].source_errors


def test_semantic(spark):
    text = "word " * 60
    p = lambda **x: {"x": {"language": "en-US", "visible_text": text} | x}
    cases = [p(), p(visible_text=text + "mock_low_alignment content"), p(visible_text=text + "mock_fail"), p(visible_text=text + "mock_invalid_json"), p(visible_text=text + "mock_low_alignment"), p(language="fr"), p(language=None), p(visible_text="few words"), p(title=" "), {"url": "https://example.com/Login/9", **p()}, {"status_code": 404, **p()}]
    c = make(spark, cases)
    r = {x.page_seq: x.state for x in semantic.page_results(c.pages).collect()}
    assert [r[i] for i in range(11)] == ["analysis_no_observation", "analysis_success", "analysis_failed", "invalid_model_output", "evidence_invalid", "unsupported_language", "unsupported_language", "skipped_by_gate", "skipped_by_gate", "skipped_by_gate", "not_eligible"]
    f = semantic.interpret(semantic.page_results(c.pages)).collect()
    assert len(f) == 1 and f[0].excerpt == "mock_low_alignment content" and f[0].nlp.confidence == 0.95
    many = make(spark, [p() for _ in range(150)])
    states = [x.state for x in semantic.page_results(many.pages).collect()]
    assert states.count("skipped_by_budget") == 50 and states.count("analysis_no_observation") == 100
    assert {x.state for x in semantic.page_results(c.pages.where("page_seq = 0"), budget=0).collect()} == {"analysis_failed"}


def test_enrichment():
    ask = lambda t: E.ask(E.MockGenerator(), t, pause=0)[0]
    assert [ask(f"mock_{m}") for m in ("429_recover", "429_exhaust", "timeout", "500", "invalid_type", "missing_field", "empty_string", "oversize", "fine")] == ["successful", "rate_limited", "timeouts", "provider_failures", *["invalid_responses"] * 4, "successful"]


def test_registry_and_isolation(spark):
    r = A.default_registry()
    assert len(r.get_all()) == 30 and [x.rule_id for x in r.get_all()] == sorted(r.rules)
    with pytest.raises(ValueError):
        r.register(r.get("AI-META-001"))
    c = make(spark, [{"status_code": 404}])
    own = Registry()
    own.register(Rule("A-1", "freshness", "breaks", lambda c: 1 / 0))
    own.register(r.get("AI-CRAWL-001"))
    good, bad = A.run_isolated(c, own)
    assert [x for x, _ in good] == ["AI-CRAWL-001"] and "ZeroDivisionError" in bad["A-1"]


def test_failed_rules_are_told(spark):
    c = make(spark, [{"status_code": 404}])
    own = Registry()
    own.register(Rule("A-1", "freshness", "breaks", lambda c: 1 / 0))
    a = A.audit(c, "2024-09-04T00:00:00Z", registry=own)
    (r,) = a.rules.collect()
    assert (r.rule_id, r.status, r.error_type, r.error_message, r.findings_generated) == ("A-1", "FAILED", "ZeroDivisionError", "division by zero", 0) and r.duration_seconds >= 0
    assert a.groups.count() == 0 and a.summary.collect()[0].score == 100
    own.register(A.default_registry().get("AI-CRAWL-001"))
    a = A.audit(c, "2024-09-04T00:00:00Z", registry=own)
    assert {x.rule_id: x.status for x in a.rules.collect()} == {"A-1": "FAILED", "AI-CRAWL-001": "SUCCESS"} and a.groups.count() == 1


def test_a_failing_fused_plan_is_isolated(spark, monkeypatch):
    c = make(spark, [{"status_code": 404}])

    def broken(c, pipeline=None):
        raise RuntimeError("no fused plan")

    monkeypatch.setattr(A, "run_rules", broken)
    monkeypatch.setattr(A.graph_rules, "orphan_rule", lambda *a: 1 / 0)
    a = A.audit(c, "2024-09-04T00:00:00Z")
    status = {x.rule_id: x.status for x in a.rules.collect()}
    assert len(status) == 30 and [k for k, v in status.items() if v == "FAILED"] == ["AI-LINK-003"] and status["AI-CRAWL-001"] == "SUCCESS"


def test_report_diagnostics(spark):
    c = make(spark, [{"status_code": 404}, {"x": {"title": "t", "language": "en", "visible_text": "word " * 60}}])
    d = json.loads(A.audit(c, "2024-09-04T00:00:00Z", timed=True).json.collect()[0].report)["diagnostics"]
    assert d["nlp"]["pages"] == 2 and d["nlp"]["not_eligible"] == 1 and sum(v for k, v in d["nlp"].items() if k != "pages") == 2
    assert d["genai"]["eligible_groups"] == d["genai"]["successful"] > 0
    assert tuple(d["stage_timing"]) == E.STAGES and d["stage_timing"]["total"] > 0


def test_raw_counts(spark):
    rows = [({"downloader/response_status_count/301": "2", "downloader/response_status_count/302": "3", "robotstxt/response_status_count/404": "1", "finish_reason": "finished"},), ({},), (None,)]
    got = spark.createDataFrame(rows, "s map<string, string>").select(*raw_counts(F.col("s"))).collect()
    assert [(x.redirect_total, x.robots_status) for x in got] == [(5, 404), (0, None), (0, None)]


def test_audit_reports(spark):
    text = "word " * 60
    c = make(spark, [{"x": {"title": None}}, {"x": {"title": "<`x`>", "language": "en", "visible_text": text + "mock_low_alignment content"}}, {"status_code": 404}])
    a = A.audit(c, "2024-09-04T00:00:00Z")
    j = json.loads(a.json.collect()[0].report)
    assert j["site"] == "https://example.com/" and j["summary"]["overall_score"] == a.summary.collect()[0].score
    kinds = [f["trigger"]["rule_id"] for f in j["findings"]]
    assert "SEMANTIC_TOPIC_RELEVANCE" in kinds and "AI-META-001" in kinds
    assert all(f["genai"]["used"] for f in j["findings"] if "observed_value" in f["evidence"])
    m = a.markdown.collect()[0].report
    assert m.startswith("# AI Readiness Audit Report: https://example.com/\n**Score:**") and "**Apparent topic:** &lt;'x'&gt;" in m and "## Audit Validation Summary" in m
    t = E.terminal_text("s", a.summary.collect()[0].asDict(), a.scopes.collect()[0].asDict(), {"total": 1.0}, {})
    assert "Crawl status: Complete" in t and "Total                    1.00s" in t


def test_json_source(spark, tmp_path):
    page = {"url": "https://example.com/", "final_url": "https://example.com/", "status_code": 200, "content_type": "text/html", "depth": 0, "parent_url": None, "extracted": {"title": "t"}}
    (tmp_path / "a.json").write_text(json.dumps({"seed_url": "https://example.com/", "crawled_at": "2024-01-01T00:00:00Z", "pages": [page], "unfetched_urls": [{"url": "u", "reason": "offsite"}, "bare"]}))
    c = load_json(spark, str(tmp_path / "a.json"))
    p = c.pages.collect()[0]
    assert p.extracted.h1s == [] and p.extracted.page_type == "unknown" and p.crawl_status == "success"
    assert [(u.url, u.reason) for u in c.unfetched.orderBy("seq").collect()] == [("u", "offsite"), ("bare", None)]


def test_frontier(spark):
    links = spark.createDataFrame([("c", "a", "b"), ("c", "b", "c"), ("c", "c", "d"), ("c", "a", "c")], "crawl_id string, url string, link string")
    got = {r.url: r.depth for r in frontier(spark.createDataFrame([("c", "a")], "crawl_id string, url string"), links, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_html():
    e, d = extract(
        '<html lang="en"><head><title></title><title>T</title><meta name="description" content=""><meta property="og:title" content="x"><link rel="canonical" href="/c">'
        '<script type="application/ld+json">{"@graph":[{"@type":"Article","datePublished":"2024-01-01"}]}</script><script type="application/ld+json">{bad</script><style>no</style></head>'
        '<body><h1>a <b>b</b></h1><p>one<p>two <a href="x#f">go <i>on</i></a><a href="https://other.org/">o</a><a href="mailto:x">m</a><img src="i.png" alt=""><img alt="k"><script>no</script></body></html>',
        "https://example.com/d/",
    )
    assert e["title"] == "T" and e["meta_description"] == "" and e["language"] == "en" and e["canonical"] == "/c"
    assert e["h1s"] == ["a ", "b"] and e["internal_links"] == ["https://example.com/d/x"] and e["external_links"] == ["https://other.org/"]
    assert e["detailed_internal_links"][0]["text"] == "go  on" and e["image_urls"] == ["i.png"] and e["image_alts"] == ["", "k"]
    assert d["malformed_jsonld_count"] == 1 and e["page_type"] == "article" and e["date_candidates"] == [{"value": "2024-01-01", "source": "json_ld", "field": "datePublished"}]
    assert e["visible_text"] == "a b one two go on o m" and d["extraction_success"]
    assert page_type("https://x.org", []) == "homepage" and page_type("https://x.org/p/1", []) == "product"
