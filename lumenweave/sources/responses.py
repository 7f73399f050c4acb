"""A crawl of stored responses: the frontier, robots.txt, redirects, extraction and counters, level by level, without a network."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import defragment, host_of, in_domains, url_join
from .crawl import CRAWL, CRAWL_DIAGNOSTICS, CRAWL_STATS, UNFETCHED, Crawl, complete_pages
from .html import extract_pages
from .robots import origin_of, robots_rules, with_blocked
from .tables import written

# Answers that are asked for again, and how a crawl that ran into its page limit ends
RETRIED = (500, 502, 503, 504, 522, 524, 408, 429)
CAPPED = "closespider_pagecount"
SHARES = 64
RESPONSES = "url string, status_code int, content_type string, location string, body string"
PAGE_COLUMNS = ["crawl_id", "page_seq", "url", "final_url", "status_code", "content_type", "depth", "parent_url", "redirect_chain", "crawl_status", "raw_html", "extracted", "diagnostics"]


@dataclass(frozen=True)
class CrawlConfig:
    """What a crawl may do. ``page_limit`` is soft: the ``in_flight`` requests that are on their way when it is reached come in as well."""

    allowed_domains: tuple[str, ...] = field(default=())
    crawl_depth: int | None = None
    page_limit: int | None = None
    in_flight: int = 0
    respect_robots_txt: bool = True
    user_agent: str = "*"
    retries: int = 2
    max_redirects: int = 20


def first_of(rows: DataFrame, keys: list[str], order: str, k: Column) -> DataFrame:
    """The first ``k`` rows of each group by ``order`` (k is a column of the group): first of salted shares, so that no group meets in one task whole."""
    share = F.pmod(F.xxhash64(order), F.lit(SHARES))
    few = rows.withColumn("first_of_rank", F.row_number().over(Window.partitionBy(*keys, share).orderBy(order))).where(F.col("first_of_rank") <= k)
    return few.withColumn("first_of_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("first_of_rank") <= k).drop("first_of_rank")


def bounded_frontier(seed: DataFrame, links: DataFrame, max_depth: int, page_limit: int | None = None, in_flight: int = 0) -> DataFrame:
    """(crawl_id, url, depth, parent_url, fetched): breadth-first reach over stored links (crawl_id, url, link) from the seeds (crawl_id, url).

    Pages come in order of depth and address. Once a crawl has ``page_limit`` pages, the ``in_flight`` next ones come in too and nothing more is
    fetched; what was discovered by then is told with fetched = false. Links of a page at ``max_depth`` are not followed. A running count a level and the first
    addresses of the level in which the limit falls decide; the driver sees only whether a level is empty. A null address is no page.
    """
    top = None if page_limit is None else page_limit + in_flight
    todo, _ = _distinct(seed.select("crawl_id", "url", F.lit(None).cast("string").alias("parent_url")))
    seen, used, out = todo.select("crawl_id", "url"), None, None
    for depth in range(max_depth + 1):
        level = todo.withColumn("depth", F.lit(depth))
        if top is not None:
            room = F.lit(top) if used is None else F.lit(top) - F.coalesce("used", F.lit(0))
            level = level if used is None else level.join(used, "crawl_id", "left")
            level = written(level.withColumn("room", room).drop("used"))
            got = first_of(level, ["crawl_id"], "url", F.col("room")).select("crawl_id", "url", F.lit(True).alias("fetched"))
            level = level.join(got, ["crawl_id", "url"], "left").withColumn("fetched", F.coalesce("fetched", F.lit(False))).drop("room")
        else:
            level = level.withColumn("fetched", F.lit(True))
        level = written(level.select("crawl_id", "url", "depth", "parent_url", "fetched"))
        out = level if out is None else out.union(level)
        if depth == max_depth:
            break
        if top is not None:
            used = out.where("fetched").groupBy("crawl_id").agg(F.count("*").alias("used"))
        found = level.where("fetched").select("crawl_id", "url").join(links.select("crawl_id", "url", "link"), ["crawl_id", "url"]).select("crawl_id", F.col("link").alias("url"), F.col("url").alias("parent_url"))
        todo, empty = _distinct(found.join(seen, ["crawl_id", "url"], "left_anti"))
        if empty:
            break
        seen = seen.union(todo.select("crawl_id", "url"))
    return out


def _distinct(rows: DataFrame) -> tuple[DataFrame, bool]:
    """One row an address, with its least parent, written; and whether there is none."""
    got = written(rows.where("url is not null").groupBy("crawl_id", "url").agg(F.min("parent_url").alias("parent_url")))
    return got, got.isEmpty()


def redirect_chains(hops: DataFrame, most: int = 20) -> DataFrame:
    """(url, final_url, redirect_chain, hops, state) of every address that redirects, from single hops (url, target), one a url.

    redirect_chain has the addresses from ``url`` on, without the final one. state is final, loop (an address comes again; final_url is null) or
    too_long (more than ``most`` hops; final_url is where they lead). Pointers are doubled, so that ``most`` hops take log2 of it many joins; chains
    hold at most 2 * most addresses. Of several targets of a url the least counts; nulls are no hops.
    """
    one = hops.where("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("target"))
    cur = written(one.select("url", "target", F.array("url").alias("chain")))
    reach = 1
    while reach <= most:
        step = cur.select(F.col("url").alias("target"), F.col("target").alias("next"), F.col("chain").alias("more"))
        j = cur.join(step, "target", "left")
        # one that has come upon itself stays as it is
        stuck = F.array_contains("chain", F.col("target")) | F.col("next").isNull()
        cur = written(j.select("url", F.when(stuck, F.col("target")).otherwise(F.col("next")).alias("target"), F.when(stuck, F.col("chain")).otherwise(F.concat("chain", "more")).alias("chain")))
        reach *= 2
    size, apart = F.size("chain"), F.size(F.array_distinct("chain"))
    more = F.array_contains("chain", F.col("target")) | (apart < size)
    state = F.when(more, F.lit("loop")).when(size > most, F.lit("too_long")).otherwise(F.lit("final"))
    chain = F.when(more, F.array_distinct("chain")).otherwise(F.col("chain"))
    return cur.select("url", F.when(more, F.lit(None)).otherwise(F.col("target")).alias("final_url"), chain.alias("redirect_chain"), F.size(chain).alias("hops"), state.alias("state"))


def crawl_stored(seeds: DataFrame, responses: DataFrame, robots: DataFrame | None = None, config: CrawlConfig = CrawlConfig(), crawled_at: str = "1970-01-01T00:00:00Z") -> Crawl:
    """The crawl that a breadth-first crawler makes of stored responses.

    ``seeds`` is (crawl_id, url), one a crawl; ``responses`` are (url, status_code, content_type, location, body), one an address; ``robots`` are (origin, text). An
    answer with a location and a status from 300 to 399 redirects: its target is asked for at the same depth, the page keeps the first address as url, and the
    chain holds all but the last. A request that was made before is filtered, except that the seed is asked for once more where a page links to it. Addresses
    that robots.txt forbids are unfetched with robots_blocked. Internal links (seed's host or ``allowed_domains``) of pages above ``crawl_depth`` are followed.
    Addresses without a stored answer are request failures. Of answers or seeds that share an address any one counts.

    Every level is a few joins on the address; its pages, requests and counts are written. Pages are numbered in order of depth and address.
    """
    spark = seeds.sparkSession
    answers = responses.select("url", F.col("status_code").alias("status"), F.lower(F.coalesce("content_type", F.lit(""))).alias("content_type"), "location", "body").dropDuplicates(["url"])
    rules = None
    if robots is not None and config.respect_robots_txt:
        rules = written(robots_rules(robots, config.user_agent))
    heads = written(seeds.groupBy("crawl_id").agg(F.min("url").alias("seed_url")))
    domains = F.array(*map(F.lit, config.allowed_domains)) if config.allowed_domains else F.array(F.col("seed_host"))
    hosts = heads.select("crawl_id", host_of(F.col("seed_url")).alias("seed_host"))
    new = heads.select("crawl_id", F.col("seed_url").alias("url"), F.lit(None).cast("string").alias("parent_url"))
    asked = spark.createDataFrame([], "crawl_id string, url string")  # the seed is not in it until a page links to it
    known = heads.select("crawl_id", F.col("seed_url").alias("url"))
    events, pages, used, depth = [], None, None, 0
    top = None if config.page_limit is None else config.page_limit + config.in_flight
    while True:
        level, asked, told = _fetched(new, asked, answers, rules, config, first=depth == 0)
        events += told
        level = level.withColumn("depth", F.lit(depth))
        if top is not None:
            room = F.lit(top) if used is None else F.lit(top) - F.coalesce("used", F.lit(0))
            level = written((level if used is None else level.join(used, "crawl_id", "left")).withColumn("room", room).drop("used"))
            level = first_of(level, ["crawl_id"], "url", F.col("room")).drop("room")
        html = F.when(F.col("content_type").contains("text/html"), F.col("raw_html")).otherwise(F.lit(""))
        level = written(extract_in_domains(level.join(hosts, "crawl_id"), domains).withColumn("raw_html", html))
        pages = level if pages is None else pages.union(level)
        if config.crawl_depth is not None and depth >= config.crawl_depth:
            break
        if top is not None:
            used = pages.groupBy("crawl_id").agg(F.count("*").alias("used"))
        links = level.select("crawl_id", F.col("final_url").alias("parent_url"), F.explode("extracted.internal_links").alias("url"))
        links = links if top is None else links.join(used.where(F.col("used") < top).select("crawl_id"), "crawl_id", "left_semi")
        links = written(links)
        fresh = links.select("crawl_id", "url").distinct().join(known, ["crawl_id", "url"], "left_anti")
        known = known.union(written(fresh))
        new = written(links.groupBy("crawl_id", "url").agg(F.min("parent_url").alias("parent_url"), F.count("*").alias("times")).join(asked.withColumn("before", F.lit(True)), ["crawl_id", "url"], "left"))
        events.append(new.groupBy("crawl_id").agg(F.sum(F.when(F.col("before"), F.col("times")).otherwise(F.col("times") - 1)).alias("n")).select("crawl_id", F.lit("duplicate_urls").alias("what"), "n"))
        new = new.where("before is null").select("crawl_id", "url", "parent_url")
        depth += 1
        if new.isEmpty():
            break
    return _assembled(heads, pages, known, events, config, crawled_at, rules, top)


def extract_in_domains(level: DataFrame, domains: Column) -> DataFrame:
    """Extraction, with a link internal where its host is, or lies below, one of ``domains``; ``seed_host`` goes."""
    x = extract_pages(level.withColumn("final_url", F.col("final_url")))
    every = F.array_union("extracted.internal_links", "extracted.external_links")
    # both in the page's order; links to either side of the page's own host are dealt anew
    detailed = F.concat("extracted.detailed_internal_links", "extracted.detailed_external_links")
    inside = lambda u: F.coalesce(in_domains(host_of(u), domains), F.lit(False))
    fields = {
        "internal_links": F.array_sort(F.filter(every, inside)), "external_links": F.array_sort(F.filter(every, lambda u: ~inside(u))),
        "detailed_internal_links": F.filter(detailed, lambda u: inside(u["url"])), "detailed_external_links": F.filter(detailed, lambda u: ~inside(u["url"])),
    }
    e = F.col("extracted")
    for name, value in fields.items():
        e = e.withField(name, F.when(F.col(f"extracted.{name}").isNull(), F.lit(None)).otherwise(value))
    return x.withColumn("extracted", F.when(F.col("extracted").isNotNull(), e)).drop("seed_host")


def _fetched(new: DataFrame, asked: DataFrame, answers: DataFrame, rules: DataFrame | None, config: CrawlConfig, first: bool) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The pages (without extraction) of one level's requests, all requests so far, and counts (crawl_id, what, n) or refused addresses (crawl_id, what, n, url)."""
    told, pages = [], None
    cur = new.select("crawl_id", "url", F.col("url").alias("at"), "parent_url", F.array().cast("array<string>").alias("redirect_chain"))
    for hop in range(config.max_redirects + 1):
        if hop:
            # of several that lead to one address, the least by its first address asks for it; others, and addresses asked before, are filtered
            w = cur.groupBy("crawl_id", "at").agg(F.min("url").alias("url"), F.count("*").alias("times"))
            w = written(w.join(asked.select("crawl_id", F.col("url").alias("at"), F.lit(True).alias("before")), ["crawl_id", "at"], "left"))
            told.append(w.groupBy("crawl_id").agg(F.sum(F.when(F.col("before"), F.col("times")).otherwise(F.col("times") - 1)).alias("n")).select("crawl_id", F.lit("duplicate_urls").alias("what"), "n"))
            cur = cur.join(w.where("before is null").select("crawl_id", "at", "url"), ["crawl_id", "at", "url"], "left_semi")
        if not (first and hop == 0):
            asked = asked.union(written(cur.select("crawl_id", F.col("at").alias("url"))))
        told.append(cur.groupBy("crawl_id").agg(F.count("*").alias("n")).select("crawl_id", F.lit("scheduled").alias("what"), "n"))
        cur = with_blocked(cur, rules, "at") if rules is not None else cur.withColumn("blocked", F.lit(False))
        got = written(cur.join(answers.withColumnRenamed("url", "at"), "at", "left"))
        told.append(got.where("blocked").select("crawl_id", F.lit("robots_blocked").alias("what"), F.lit(1).cast("bigint").alias("n"), F.col("at").alias("url")))
        free = got.where("not blocked")
        told.append(free.where("status is null").groupBy("crawl_id").agg(F.count("*").alias("n")).select("crawl_id", F.lit("request_failures").alias("what"), "n"))
        told.append(free.where(F.col("status").isin(*RETRIED)).groupBy("crawl_id").agg((F.count("*") * config.retries).alias("n")).select("crawl_id", F.lit("retries").alias("what"), "n"))
        moved = F.col("status").between(300, 399) & (F.coalesce("location", F.lit("")) != "")
        told.append(free.where(moved).where("status in (301, 302)").groupBy("crawl_id").agg(F.count("*").alias("n")).select("crawl_id", F.lit("redirects").alias("what"), "n"))
        here = free.where(F.col("status").isNotNull() & ~moved).select("crawl_id", "url", F.col("at").alias("final_url"), F.col("status").alias("status_code"), "content_type", "parent_url", "redirect_chain", F.lit("success").alias("crawl_status"), F.col("body").alias("raw_html"))
        pages = here if pages is None else pages.union(here)
        cur = free.where(moved).select("crawl_id", "url", defragment(url_join(F.col("at"), F.col("location"))).alias("next"), "parent_url", F.concat("redirect_chain", F.array("at")).alias("redirect_chain"))
        cur = written(cur.withColumnRenamed("next", "at"))
        if cur.isEmpty():
            break
    return written(pages), asked, told


def _assembled(heads, pages, known, events, config, crawled_at, rules, top) -> Crawl:
    """Pages numbered in order, one row a crawl with its counters, and the refused addresses."""
    spark = pages.sparkSession
    order = [F.col("crawl_id"), F.col("depth"), F.col("url"), F.col("final_url")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(complete_pages(pages.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("page_seq", F.monotonically_increasing_id()).select(*PAGE_COLUMNS)))
    counts = refused = None
    for e in events:
        if "url" in e.columns:
            refused = e if refused is None else refused.union(e)
        else:
            counts = e if counts is None else counts.union(e)
    refused = written(refused)
    what = lambda name: F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name)
    told = counts.union(refused.drop("url")).groupBy("crawl_id").agg(*[what(x) for x in ("scheduled", "duplicate_urls", "robots_blocked", "request_failures", "retries", "redirects")])
    seen = known.distinct().groupBy("crawl_id").agg(F.count("*").alias("discovered"))
    html, ok = F.col("content_type").contains("text/html"), F.col("status_code") < 400
    kinds = numbered.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_if(html).alias("html"), F.count_if(html & ok).alias("good"), F.count_if(html & ~ok).alias("bad"), F.count_if(~html).alias("other"))
    asked = numbered.select("crawl_id", origin_of(F.col("final_url")).alias("o")).union(refused.select("crawl_id", origin_of(F.col("url")).alias("o"))).distinct()
    files = asked.groupBy("crawl_id").agg(F.count("*").alias("files")) if rules is not None else spark.createDataFrame([], "crawl_id string, files bigint")
    j = heads.join(told, "crawl_id", "left").join(seen, "crawl_id", "left").join(kinds, "crawl_id", "left").join(files, "crawl_id", "left")
    num = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    scheduled = num("scheduled") + num("retries")
    values = {
        "urls_discovered": num("discovered"), "urls_scheduled": scheduled, "requests_attempted": scheduled - num("robots_blocked") + num("files"), "responses_received": num("pages") + num("files"), "html_pages_crawled": num("html"), "successful_pages": num("good"),
        "failed_pages": num("bad"), "robots_blocked": num("robots_blocked"), "duplicate_urls": num("duplicate_urls"), "redirects": num("redirects"), "non_html_responses": num("other"), "crawl_duration": F.lit(0.0),
    }
    capped = F.lit(False) if top is None else num("pages") >= config.page_limit
    ended = F.when(capped, F.lit(CAPPED)).otherwise(F.lit("finished"))
    diagnostics = {
        "robots_txt_fetched": num("files") > 0, "robots_txt_status": F.when(num("files") > 0, F.lit(200)), "crawl_errors": F.array().cast("array<string>"), "request_failures": num("request_failures"), "extraction_failures": F.lit(0).cast("bigint"),
        "pages_discovered_not_fetched": F.lit(0).cast("bigint"), "robots_blocked_urls": num("robots_blocked"), "crawl_termination_reason": ended, "configured_depth_limit": F.lit(config.crawl_depth or 0), "configured_page_limit": F.lit(config.page_limit or 0),
    }
    struct = lambda ddl, given: F.struct(*[given[f.name].cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(f"x {ddl}").fields[0].dataType.fields])
    head = j.select("crawl_id", "seed_url", F.lit(crawled_at).alias("crawled_at"), struct(CRAWL_STATS, values).alias("crawl_stats"), struct(CRAWL_DIAGNOSTICS, diagnostics).alias("crawl_diagnostics"), ended.alias("finish_reason"))
    unfetched = refused.select("crawl_id", F.monotonically_increasing_id().alias("seq"), "url", F.lit("robots_blocked").alias("reason"))
    names = lambda ddl: [f.name for f in T._parse_datatype_string(ddl).fields]
    return Crawl(written(head.select(*names(CRAWL))), numbered, written(unfetched.select(*names(UNFETCHED))))
