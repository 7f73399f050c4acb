"""A site's audit from stored answers to files, its settings, user rules as table functions, and what is left on disk."""

import json
import logging
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import validation
from lumenweave.operators.rule_functions import PageRule, known_texts, register, table_function
from lumenweave.plans import audit as A
from lumenweave.plans import overlay
from lumenweave.plans.site import SiteConfig, audit_site, load_config, logger
from lumenweave.sources.dumps import load_dumps
from lumenweave.sources.responses import RESPONSES, CrawlConfig

SF = "/root/testdata/sf0.001"


def test_a_site_from_answers_to_files(spark, tmp_path, capsys):
    u = "https://s.org"
    page = lambda title, *links: f"<html lang=en><head><title>{title}</title></head><body><h1>h</h1>{'words of a text ' * 20}{title}" + "".join(f'<a href="{x}">l</a>' for x in links) + "</body></html>"
    rows = [("/", 200, page("home", "/a", "/gone", "/no")), ("/a", 200, page(" ", "/")), ("/gone", 404, page("x")), ("/no", 200, page("secret"))]
    answers = spark.createDataFrame([(u + k, s, "text/html", None, b) for k, s, b in rows], RESPONSES)
    seeds = spark.createDataFrame([("s/1", u + "/")], "crawl_id string, url string")
    robots = spark.createDataFrame([(u, "User-agent: *\nDisallow: /no")], "origin string, text string")
    config = SiteConfig(crawl=CrawlConfig(crawl_depth=2), audited_at="2024-09-04T00:00:00Z", output=f"{tmp_path}/out", files=("json", "markdown", "dump"))
    a = audit_site(seeds, answers, robots, config)
    assert sorted(os.listdir(tmp_path / "out")) == ["s%2F1.json", "s%2F1.md", "s%2F1.report.json"]
    j = json.loads((tmp_path / "out" / "s%2F1.report.json").read_text())
    assert j["site"] == u + "/" and j["crawl"]["html_pages_crawled"] == 4 and j["evaluation_scope"]["status"] == "Partial"
    found = {f["trigger"]["rule_id"] for f in j["findings"]}
    assert {"AI-CRAWL-001", "AI-ROBOTS-001", "AI-LINK-001", "AI-META-002"} <= found and any("genai" in f for f in j["findings"])
    assert load_dumps(spark, f"{tmp_path}/out/*F1.json").pages.count() == a.scopes.first().pages_evaluated == 4
    plain = audit_site(seeds, answers, robots, SiteConfig(crawl=CrawlConfig(crawl_depth=0), audited_at="2024-09-04T00:00:00Z", semantic=False, enrichment=False))
    assert "genai" not in json.loads(plain.json.first().report)["findings"][0] and plain.scopes.first().pages_evaluated == 1
    with pytest.raises(ValueError, match="no files of the kind"):
        audit_site(seeds, answers, None, SiteConfig(crawl=CrawlConfig(crawl_depth=0), output=f"{tmp_path}/x", files=("pdf",)))


def test_settings(spark):
    keys = {"crawl.crawl_depth": "5", "crawl.page_limit": "none", "crawl.respect_robots_txt": "false", "crawl.allowed_domains": "a.org, b.org", "output": "/x", "enrichment": "FALSE"}
    try:
        for k, v in keys.items():
            spark.conf.set(f"spark.lumenweave.{k}", v)
        c = load_config(spark)
        assert (c.crawl.crawl_depth, c.crawl.page_limit, c.crawl.respect_robots_txt, c.crawl.allowed_domains, c.crawl.in_flight) == (5, None, False, ("a.org", "b.org"), 5)
        assert (c.output, c.enrichment, c.semantic) == ("/x", False, True)
        spark.conf.set("spark.lumenweave.crawl.none_such", "1")
        with pytest.raises(ValueError, match="no setting"):
            load_config(spark)
        spark.conf.unset("spark.lumenweave.crawl.none_such")
        spark.conf.set("spark.lumenweave.semantic", "perhaps")
        with pytest.raises(ValueError, match="neither"):
            load_config(spark)
    finally:
        for k in [*keys, "semantic", "crawl.none_such"]:
            spark.conf.unset(f"spark.lumenweave.{k}")
    assert load_config(spark) == SiteConfig()


def test_one_handler_a_logger():
    first, again = logger("lumenweave.test"), logger("lumenweave.test", logging.DEBUG)
    assert first is again and len([h for h in first.handlers if isinstance(h, logging.StreamHandler)]) == 1 and again.level == logging.DEBUG


def test_rules_as_table_functions(spark):
    class Deep(PageRule):
        vars().update(known_texts("AI-LINK-004"))
        needs = ("crawl_id", "page_seq", "url", "depth")

        def __init__(self, **settings):
            super().__init__(**settings)
            self.seen = 0

        def check(self, page):
            self.seen += 1
            if page.depth >= self.settings.get("least", 4):
                yield {"page": page.url, "observed_value": str(page.depth)}

        def end(self):
            yield {"page": "all", "observed_value": str(self.seen)}

    register(spark, "deep", Deep)
    rows = [("c", i, f"u{i}", i % 6) for i in range(12)] + [("d", 0, "v", 5)]
    spark.createDataFrame(rows, "crawl_id string, page_seq long, url string, depth int").createOrReplaceTempView("own_pages")
    got = spark.sql("select * from deep(table(own_pages) partition by crawl_id, least => 5)").collect()
    assert sorted((r.page, r.observed_value) for r in got) == [("all", "1"), ("all", "12"), ("u11", "5"), ("u5", "5"), ("v", "5")]
    (v,) = [r for r in got if r.page == "v"]
    assert (v.crawl_id, v.rule_id, v.severity, v.pages_affected, v.id[:14]) == ("d", "AI-LINK-004", "low", 1, "F-AI-LINK-004-")
    assert spark.sql("select * from deep(table(select * from own_pages where false))").where("page <> 'all'").count() == 0
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("select * from deep(table(select url from own_pages))")
    with pytest.raises(Exception, match="must be a table"):
        spark.sql("select * from deep(1)")
    with pytest.raises(Exception, match="plain values"):
        spark.sql("select * from deep(table(own_pages), least => array(1))")
    with pytest.raises(ValueError, match="is no pipeline"):
        table_function(type("Bad", (PageRule,), {"rule_id": "x", "pipeline": "none"}))


def test_counts_are_observed_in_the_pass(spark):
    c = overlay.crawl(spark, SF)
    got = {r.rule_id: (r.findings_generated, r.valid_findings) for r in A.observed_diagnostics(c).collect()}
    checked = validation.validate_findings(A.run_rules(c), c.pages)
    want = {r.rule_id: (r.g, r.v) for r in checked.groupBy("rule_id").agg(F.count("*").alias("g"), F.count_if(F.size("errors") == 0).alias("v")).collect()}
    assert len(got) == 30 and {k: v for k, v in got.items() if v[0]} == want
    runs = {r.rule_id: r.count for r in A.rule_runs(c, A.default_registry(), "engagement")}
    assert runs == {k: want[k][0] for k in ("ENG-MEDIA-001", "ENG-NAV-001")}


def test_semantic_sources_of_odd_findings(spark):
    c = overlay.crawl(spark, SF)
    url = c.pages.where("extracted.title is not null").first().url
    rows = [("overlay", url, "semantic", '{"sources":[{"field":"title","text":"no such"}]}', "s"), ("overlay", url, "deterministic", '{"sources":[{"field":"title","text":"no such"}]}', "s"), ("overlay", "gone", "semantic", '{"confidence":2}', "s"), ("overlay", None, "semantic", None, "s"), ("overlay", url, "semantic", '{"confidence":1,"sources":[]}', "s"), ("overlay", url, "semantic", '{"confidence":1.01,"sources":7}', "s")]
    f = spark.createDataFrame(rows, "crawl_id string, page string, trigger_type string, details string, page_fields string")
    got = sorted(tuple(r.semantic_errors) for r in validation.semantic_sources(f, c.pages).collect())
    assert got == [(), (), (), (), ('A semantic source quotes text that the page\'s field "title" does not hold.',), ("Semantic confidence is no number from 0 to 1.",)]
    assert validation.semantic_sources(f, c.pages).columns == [*f.columns, "semantic_errors"]


def test_tables_go_with_the_application(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate()
from lumenweave.sources.tables import written
import os
assert written(s.range(3)).count() == 3 and os.listdir("{tmp_path}/shared")
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, capture_output=True)
    assert not [x for x in os.listdir(tmp_path / "shared") if x.startswith("lw-")]
