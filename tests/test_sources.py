"""Readers and writers of crawls: split dumps, files by name, robots.txt, redirects, the frontier, stored responses and JSON-LD."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenweave.sources import dumps, jsonld, responses, robots
from lumenweave.sources.crawl import CRAWL, UNFETCHED, Crawl, complete_pages, load_json
from lumenweave.sources.tables import written


def dump(n, seed, unfetched=3, **more):
    """A dump with everything that makes a scan stumble: quotes, backslashes, brackets and commas within strings, empty texts, nested lists."""
    rng = random.Random(seed)
    odd = ['"', "\\", "}", "{", "]", "[", ",", ":", '\\"', "}}\\\\", "é", "\n", " ", "a", '"},{"url":"no"', "\U0001f600"]
    text = lambda k: "".join(rng.choice(odd) for _ in range(rng.randrange(k)))
    pages = []
    for i in range(n):
        pages.append({"url": f"https://x.org/{i}", "final_url": f"https://x.org/{i}", "status_code": 200, "content_type": "text/html", "depth": i % 4, "parent_url": None, "redirect_chain": [text(5)] * (i % 3), "raw_html": text(400 if i % 7 else 9000), "extracted": {"title": text(9), "h1s": [text(4), text(4)], "parsed_json_ld": [{"a": [1, {"b": text(5)}]}], "date_candidates": [{"value": text(6), "source": "meta", "field": "x"}]}, "diagnostics": {"malformed_jsonld_count": i}})
    lost = [{"url": text(12), "reason": "offsite"} if i % 2 else text(8) for i in range(unfetched)]
    return {"seed_url": text(20), "crawled_at": "2024-01-01T00:00:00Z", "crawl_stats": {"urls_discovered": n, "crawl_duration": 1.5}, "pages": pages, "crawl_diagnostics": {"crawl_errors": ["a", "b,]"], "crawl_termination_reason": "finished"}, "raw_scrapy_stats": {"finish_reason": "finished", "downloader/response_status_count/301": 2}, "unfetched_urls": lost} | more


def rows(df, *drop):
    """The rows as sorted texts; JSON-LD objects without the spaces that a text of theirs may have."""
    out = []
    for r in df.drop(*drop).collect():
        x = r.asDict(True)
        if "extracted" in x:
            x["extracted"]["parsed_json_ld"] = [json.loads(o) for o in x["extracted"]["parsed_json_ld"]]
        out.append(json.dumps(x, sort_keys=True, default=str))
    return sorted(out)


@pytest.mark.parametrize("indent", [None, 1])
def test_a_dump_read_by_many_tasks(spark, tmp_path, indent):
    for name, d in (("a", dump(25, 1)), ("b", dump(0, 2, 0)), ("c", dump(1, 3, 1, unknown=[1, {"x": [2]}], other={"y": {}})), ("d", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=name == "a"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, chunk in (("5000", 700), ("20000", 1)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got, want = dumps.load_dumps(spark, f"{tmp_path}/*.json", chunk), load_json(spark, f"{tmp_path}/*.json")
            assert rows(got.pages) == rows(want.pages)
            assert rows(got.unfetched) == rows(want.unfetched)
            assert rows(got.crawl) == rows(want.crawl)
        assert got.pages.where("crawl_id like '%a.json'").agg(F.max("page_seq"), F.count_distinct("page_seq")).first()[:] == (24, 25)
        assert spark.read.option("lineSep", "}").text(f"{tmp_path}/a.json").rdd.getNumPartitions() > 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_broken_dumps_fail(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"pages": [{"url": "u"}]}))
    with pytest.raises(Exception, match="a page lacks"):
        dumps.load_dumps(spark, f"{tmp_path}/x.json").pages.collect()
    (tmp_path / "y.json").write_text('{"pages": [{"url": "u", "depth": }]}')
    with pytest.raises(Exception):  # noqa: B017
        dumps.load_dumps(spark, f"{tmp_path}/y.json").pages.collect()


def test_a_dump_written_and_read_again(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(dump(20 if name == "a" else 0, 5, 3 if name == "a" else 0)))
    c = load_json(spark, f"{tmp_path}/*.json")
    named = lambda df: df.withColumn("crawl_id", F.regexp_extract("crawl_id", r"/([ab])\.json$", 1))
    c = Crawl(named(c.crawl), named(c.pages), named(c.unfetched))
    dumps.write_dumps(c, f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["a.json", "b.json"]
    got = dumps.load_dumps(spark, f"{tmp_path}/out/*.json", 500)
    assert rows(got.pages, "crawl_id") == rows(c.pages, "crawl_id") and rows(got.unfetched, "crawl_id") == rows(c.unfetched, "crawl_id")
    assert rows(got.crawl.drop("redirect_total", "robots_status"), "crawl_id") == rows(c.crawl.drop("redirect_total", "robots_status"), "crawl_id")
    with pytest.raises(Exception, match="there already"):
        dumps.write_dumps(c, f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["a.json", "b.json"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    few = spark.range(40, numPartitions=4).select(F.concat(F.lit("n/ü "), F.col("id").cast("string")).alias("name"), F.lit(0).alias("seq"), F.when(F.col("id") == 33, F.raise_error(F.lit("torn"))).otherwise(F.lit("text")).alias("text"))
    with pytest.raises(Exception, match="torn"):
        dumps.write_files(few, f"{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    dumps.write_reports(spark.createDataFrame([("x/y z", "# r"), ("k", None)], "crawl_id string, report string"), f"{tmp_path}/out", ".md")
    assert sorted(os.listdir(tmp_path / "out")) == ["k.md", "x%2Fy%20z.md"] and (tmp_path / "out" / "x%2Fy%20z.md").read_text() == "# r"
    dumps.write_reports(spark.createDataFrame([], "crawl_id string, report string"), f"{tmp_path}/out", ".json")
    assert len(os.listdir(tmp_path / "out")) == 2


def test_robots_rules(spark):
    text = "﻿# none\nUser-agent: a\nUser-agent: *\nDisallow: /private\nAllow: /private/open$\nDisallow: /*.pdf$\nDisallow:\n\nUser-agent: special\nDisallow: /\nAllow: /a%20b\nSitemap: x\nUser-agent: spec\nDisallow: /x"
    files = spark.createDataFrame([("HTTPS://x.org", text), ("https://y.org", None), ("https://z.org", "Disallow: /\nUser-agent: *\nDisallow: /q?a=*&b\nAllow: /q?a=1&b\nDisallow: /t\nAllow: /t")], "origin string, text string")
    urls = ["https://x.org", "https://x.org/private", "https://x.org/private/open", "https://x.org/private/open/er", "https://X.org/a.pdf", "https://x.org/a.pdf?x", "https://x.org/a.pdf#x", "https://y.org/private", "https://z.org/q?a=2&b", "https://z.org/q?a=1&b", "https://z.org/t/u", "https://z.org/", "https://none.org/private", None, "nonsense"]
    asked = spark.createDataFrame([(u, i) for i, u in enumerate(urls * 2)], "url string, origin int")
    got = {r.url: r.blocked for r in robots.with_blocked(asked, robots.robots_rules(files)).collect()}
    assert [u for u in urls if got[u]] == ["https://x.org/private", "https://x.org/private/open/er", "https://X.org/a.pdf", "https://x.org/a.pdf#x", "https://z.org/q?a=2&b"]
    assert robots.with_blocked(asked, robots.robots_rules(files)).count() == 2 * len(urls)
    assert robots.parse_robots(text, "SpecialBot") == [(False, "/"), (True, "/a b")] and robots.parse_robots(text, "spec") == [(False, "/x")]
    own = {r.url: r.blocked for r in robots.with_blocked(asked, robots.robots_rules(files, "special")).collect()}
    assert own["https://x.org"] and own["https://x.org/private/open"] and not own["https://z.org/q?a=1&b"]


def plain_chain(hops, url, most):
    chain, at = [], url
    while at in hops:
        if at in chain:
            return None, chain, "loop"
        chain.append(at)
        at = hops[at]
    return at, chain, "final" if len(chain) <= most else "too_long"


def test_redirect_chains(spark):
    hops = {f"l{i}": f"l{i + 1}" for i in range(30)} | {"s": "s", "a": "b", "b": "c", "c": "a", "t": "a", "u": "end"} | {f"h{i}": "u" for i in range(5)}
    got = {r.url: r for r in responses.redirect_chains(spark.createDataFrame([*hops.items(), ("u", "z"), (None, "x"), ("n", None)], "url string, target string")).collect()}
    assert set(got) == set(hops)
    for u, r in got.items():
        final, chain, state = plain_chain(hops, u, 20)
        assert r.state == state, u
        if state != "too_long":
            assert (r.final_url, r.redirect_chain, r.hops) == (final, chain, len(chain)), u
    assert got["l10"].state == "final" and got["l9"].state == "too_long"
    assert responses.redirect_chains(spark.createDataFrame([], "url string, target string")).count() == 0


def plain_frontier(seeds, links, depth, top):
    out = {}
    for c, seed in seeds:
        seen, level, used = {seed: (0, None)}, [seed], 0
        for d in range(depth + 1):
            level = sorted(level)
            took = level if top is None else level[: max(0, top - used)]
            used += len(took)
            for u in level:
                out[c, u] = (*seen[u], u in took)
            new = {}
            for u in took if d < depth else []:
                for v in links.get(u, []):
                    if v not in seen:
                        new[v] = min(new.get(v, u), u)
            seen |= {v: (d + 1, p) for v, p in new.items()}
            level = list(new)
            if not level:
                break
    return out


@pytest.mark.parametrize(("limit", "in_flight"), [(None, 0), (7, 0), (7, 3), (0, 0), (1, 0), (500, 0)])
def test_frontier_with_a_soft_limit(spark, limit, in_flight):
    rng = random.Random(4)
    links = {f"u{i}": [f"u{rng.randrange(60)}" for _ in range(3)] for i in range(60)}
    seeds = [("p", "u0"), ("q", "u7"), ("r", "nowhere")]
    table = spark.createDataFrame([(c, u, v) for c, _ in seeds for u, vs in links.items() for v in vs] + [("p", "u0", None)], "crawl_id string, url string, link string")
    got = responses.bounded_frontier(spark.createDataFrame(seeds, "crawl_id string, url string"), table, 3, limit, in_flight)
    want = plain_frontier(seeds, links, 3, None if limit is None else limit + in_flight)
    assert {(r.crawl_id, r.url): (r.depth, r.parent_url, r.fetched) for r in got.collect()} == want


def site(spark):
    """A small site with redirects, errors, a refused address, a loop, a picture and a link to its own start."""
    u = "https://s.org"
    page = lambda *links, text="x": f"<html><body><h1>{text}</h1>" + "".join(f'<a href="{x}">l</a>' for x in links) + "</body></html>"
    table = {
        "/": (200, "text/html; Charset=utf-8", None, page("/a", "/b#top", "/b", "/old", "/gone", "/500", "/private/x", "/pic.png", "https://other.org/", "/loop1", "http://sub.s.org/z", "/missing")),
        "/a": (200, "text/html", None, page("/", "/a", "/b", "/deep")), "/b": (200, "TEXT/HTML", None, page("/gone", "/old2")), "/deep": (200, "text/html", None, page("/deeper")), "/deeper": (200, "text/html", None, page()),
        "/old": (301, "text/html", "/older", ""), "/older": (302, "text/html", "/new", ""), "/new": (200, "text/html", None, page("/a")), "/old2": (301, "text/html", "new#x", ""),
        "/gone": (404, "text/html", None, page()), "/500": (500, "text/html", None, page()), "/pic.png": (200, "image/png", None, "<a href='/never'>"), "/loop1": (302, "", "/loop2", ""), "/loop2": (302, "", "/loop1", ""), "/private/x": (200, "text/html", None, page()),
    }
    rows = [(u + k, *v) for k, v in table.items()] + [("http://sub.s.org/z", 200, "text/html", None, page())]
    return spark.createDataFrame(rows, responses.RESPONSES.replace("location string, body", "location string, body"))


def test_stored_responses(spark):
    seeds = spark.createDataFrame([("c", "https://s.org/")], "crawl_id string, url string")
    files = spark.createDataFrame([("https://s.org", "User-agent: *\nDisallow: /private")], "origin string, text string")
    c = responses.crawl_stored(seeds, site(spark), files, responses.CrawlConfig(crawl_depth=2))
    p = c.pages.orderBy("page_seq").collect()
    at = lambda d: [x.url.split(".org")[1] for x in p if x.depth == d]
    assert at(0) == ["/"] and at(1) == ["/z", "/500", "/a", "/b", "/gone", "/old", "/pic.png"] and at(2) == ["/", "/deep"]
    old = next(x for x in p if x.url.endswith("/old"))
    assert old.final_url == "https://s.org/new" and old.redirect_chain == ["https://s.org/old", "https://s.org/older"] and old.depth == 1
    assert next(x for x in p if x.url.endswith("/deep")).parent_url == "https://s.org/a" and p[0].content_type == "text/html; charset=utf-8" and p[0].extracted.external_links == ["https://other.org/"]
    assert "http://sub.s.org/z" in p[0].extracted.internal_links and next(x for x in p if x.url.endswith("png")).extracted.internal_links == []
    assert [(x.url, x.reason) for x in c.unfetched.collect()] == [("https://s.org/private/x", "robots_blocked")]
    h = c.crawl.first()
    s = h.crawl_stats
    assert (s.html_pages_crawled, s.successful_pages, s.failed_pages, s.non_html_responses, s.robots_blocked) == (9, 7, 2, 1, 1)
    # seed, 10 links of it, / and /deep and /old2; /older, /new, /loop2; two more tries of /500
    assert s.urls_discovered == 13 and s.urls_scheduled == 19 and s.redirects == 5 and h.crawl_diagnostics.request_failures == 1
    # /loop1 again; links /a, /b (of /a), /gone (of /b), /a (of /old's page); /new again by /old2
    assert s.duplicate_urls == 6 and h.finish_reason == "finished"
    free = responses.crawl_stored(seeds, site(spark), files, responses.CrawlConfig(crawl_depth=0, respect_robots_txt=False))
    assert free.pages.count() == 1 and free.unfetched.count() == 0
    few = responses.crawl_stored(seeds, site(spark), files, responses.CrawlConfig(crawl_depth=3, page_limit=3, in_flight=1))
    assert few.pages.count() == 4 and few.crawl.first().finish_reason == "closespider_pagecount"
    none = responses.crawl_stored(seeds, site(spark).limit(0), None)
    assert none.pages.count() == 0 and none.crawl.first().crawl_diagnostics.request_failures == 1


def counted_site(spark):
    """A site whose counters are known: 38 addresses linked from the start, two more behind one of them, three redirects, a retried error, a refused one."""
    u, rows = "http://127.0.0.1:5004", []
    names = ["about", "products", "redirect", "404", "500", "private", "article", "malformed", "image.png", "redirect_chain_1", "broken_link_source", *(f"page{i}" for i in range(27))]
    link = lambda *xs: "".join(f'<a href="{x}">t</a>' for x in xs)
    body = {"about": link("/", "/about"), "products": link("/products/a", "/products/b"), "broken_link_source": link("/404")}
    rows.append((u + "/", 200, "text/html", None, link(*(f"/{n}" for n in names), "/about#team", "https://external.com")))
    for n in [*names, "products/a", "products/b", "redirect_chain_2", "chained_destination"]:
        moved = {"redirect": (301, "/products/a"), "redirect_chain_1": (301, "/redirect_chain_2"), "redirect_chain_2": (302, "/chained_destination")}.get(n)
        status = moved[0] if moved else {"404": 404, "500": 500}.get(n, 200)
        rows.append((f"{u}/{n}", status, "image/png" if n == "image.png" else "text/html", moved[1] if moved else None, body.get(n, "")))
    return spark.createDataFrame(rows, responses.RESPONSES)


def test_counters_of_a_known_site(spark):
    seeds = spark.createDataFrame([("c", "http://127.0.0.1:5004/")], "crawl_id string, url string")
    files = spark.createDataFrame([("http://127.0.0.1:5004", "User-agent: *\nDisallow: /private\n")], "origin string, text string")
    s = responses.crawl_stored(seeds, counted_site(spark), files, responses.CrawlConfig(crawl_depth=2, page_limit=50)).crawl.first().crawl_stats
    got = {k: s[k] for k in ("urls_discovered", "urls_scheduled", "requests_attempted", "responses_received", "html_pages_crawled", "successful_pages", "failed_pages", "robots_blocked", "duplicate_urls", "redirects", "non_html_responses")}
    assert got == {"urls_discovered": 41, "urls_scheduled": 46, "requests_attempted": 46, "responses_received": 41, "html_pages_crawled": 39, "successful_pages": 37, "failed_pages": 2, "robots_blocked": 1, "duplicate_urls": 3, "redirects": 3, "non_html_responses": 1}


def test_json_ld(spark):
    cases = [
        ['{"@type":"Article","datePublished":"2024-01-01","dateModified":5}'], ['[{"@type":"Product","uploadDate":"u"},5,"x",{"@type":["Article"]},{"@type":"BlogPosting","dateModified":"m"}]'], ['{"@graph":[{"@type":"NewsArticle","dateModified":"m"},{"@id":"b"}],"@type":"Product"}'],
        ['{"@graph":[{"@graph":[{"@type":"Article"}]}]}'], ['"text"', "17", "null"], ['{"@type": "Article",', "{}"], ['{"@graph":{"@type":"Article"}}'], ['{"@type":"Article","price":NaN,"@type":"Product"}'], [], ["", None, "[]"],
    ]
    t = spark.createDataFrame([("c", i, (x,)) for i, x in enumerate(cases)], "crawl_id string, page_seq bigint, extracted struct<json_ld: array<string>>")
    got = {r.page_seq: (r.objects, r.malformed, r.kind, r.dates) for r in jsonld.by_page(t).collect()}
    assert got == {0: (1, 0, "article", "datePublished=2024-01-01"), 1: (5, 0, "product", "uploadDate=u,dateModified=m"), 2: (2, 0, "article", "dateModified=m"), 3: (1, 0, None, ""), 4: (0, 0, None, ""), 5: (1, 1, None, ""), 6: (1, 0, None, ""), 7: (1, 0, "product", ""), 9: (0, 1, None, "")}
