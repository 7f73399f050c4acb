"""Queries of crawling, dumps, structured data and user rules on the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import finding_id
from ..operators import validation
from ..operators.rule_functions import PageRule, known_texts, register
from ..sources import dumps, jsonld, responses
from ..sources.crawl import Crawl
from ..sources.html import extract_pages
from ..sources.tables import new_folder, written
from . import audit as A
from . import overlay, rendered

SITE = "https://site.example"
#: a page's navigation, as addresses of one site: the first is taken for the page's own, and where it leads is the others'
_PATHS = r"""regexp_extract_all(html, '<a href="(/[^"]*)"', 1)"""
_CLEAN = "concat('" + SITE + "', regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '#.*$', ''))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html, links): pages with the addresses in their navigation."""
    return _pages(spark, sf_dir).selectExpr("page_id", "html", f"transform({_PATHS}, x -> {_CLEAN}) as links").where("size(links) > 0")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _addressed(spark, sf_dir)
    return a.select(F.lit("site").alias("crawl_id"), F.col("links")[0].alias("url"), F.explode("links").alias("link")).distinct()


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _addressed(spark, sf_dir)
    return a.agg(F.min_by(F.col("links")[0], "page_id").alias("url")).select(F.lit("site").alias("crawl_id"), "url").where("url is not null")


_ADDRESSED = f"a as (select page_id, html, list_transform(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1), lambda x: {_CLEAN}) as links from pages where regexp_matches(html, '<a href=\"/')), seed as (select arg_min(links[1], page_id) as url from a)"
DEPTH, LIMIT, IN_FLIGHT = 3, 60, 5


def frontier_pages(spark, sf_dir):
    """Breadth-first reach over the pages' links to depth 3, with a soft limit of 60 pages and 5 in flight."""
    return responses.bounded_frontier(_seed(spark, sf_dir), _edges(spark, sf_dir), DEPTH, LIMIT, IN_FLIGHT).drop("crawl_id")


_FRONTIER = f"""with recursive {_ADDRESSED}, e as (select distinct links[1] as url, unnest(links) as link from a),
 walk(url, depth) as (select url, 0 from seed union select e.link, walk.depth + 1 from walk join e on e.url = walk.url where walk.depth < {DEPTH}),
 reach as (select url, min(depth) as depth from walk group by url),
 ranked as (select *, row_number() over (order by depth, url) as k from reach),
 got as (select * from ranked where k <= {LIMIT + IN_FLIGHT}),
 out as (select url, depth, true as fetched from got union all select r.url, r.depth, false from ranked r where k > {LIMIT + IN_FLIGHT} and exists (select 1 from got join e on e.url = got.url where e.link = r.url and got.depth = r.depth - 1))
select o.url, o.depth, min(g.url) as parent_url, o.fetched from out o left join (got g join e on e.url = g.url) on e.link = o.url and g.depth = o.depth - 1 group by o.url, o.depth, o.fetched"""


def redirects(spark, sf_dir):
    """Chains of redirects, where every page's first address leads to its second."""
    hops = _addressed(spark, sf_dir).select(F.col("links")[0].alias("url"), F.get("links", F.lit(1)).alias("target"))
    return responses.redirect_chains(hops).select("url", "final_url", F.array_join("redirect_chain", " ").alias("redirect_chain"), "hops", "state")


_REDIRECTS = f"""with recursive {_ADDRESSED}, h as (select links[1] as url, min(links[2]) as target from a where links[2] is not null group by links[1]),
 walk as (select url, target as here, [url] as chain, false as loop from h
   union all select w.url, h.target, list_append(w.chain, w.here), list_contains(list_append(w.chain, w.here), h.target) from walk w join h on h.url = w.here where not w.loop and not list_contains(w.chain, w.here)),
 last as (select *, row_number() over (partition by url order by len(chain) desc) as k from walk)
select url, case when loop or list_contains(chain, here) then null else here end as final_url, array_to_string(chain, ' ') as redirect_chain, len(chain)::int as hops, case when loop or list_contains(chain, here) then 'loop' when len(chain) > 20 then 'too_long' else 'final' end as state from last where k = 1"""

_STATUS = "case page_id % 13 when 5 then 404 when 6 then 500 else 200 end"
_KIND = "case page_id % 17 when 3 then 'image/png' when 4 then 'Text/HTML; charset=utf-8' else 'text/html' end"
#: what the site's robots.txt refuses and allows: the beginnings of some addresses; there are few beginnings, however many pages there are
_REFUSED = "substring({p}, 1, 3)"
_ALLOWED = "substring({p}, 1, 4)"


def _stored(spark: SparkSession, sf_dir: str) -> Crawl:
    a = _addressed(spark, sf_dir).selectExpr("page_id", "html", "links[0] as url")
    first = a.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("x"))
    answers = first.selectExpr("url", "x.page_id as page_id", "x.html as body").selectExpr("url", f"{_STATUS} as status_code", f"{_KIND} as content_type", "cast(null as string) as location", "body")
    path = F.substring("url", len(SITE) + 1, 1 << 30)
    beginnings = a.select(path.alias("p")).where(F.length("p") >= 4)
    lines = beginnings.select(F.concat(F.lit("Disallow: "), F.expr(_REFUSED.format(p="p"))).alias("line")).where("ascii(substring(line, 13, 1)) % 4 = 1").union(beginnings.select(F.concat(F.lit("Allow: "), F.expr(_ALLOWED.format(p="p"))).alias("line")).where("ascii(substring(line, 11, 1)) % 3 = 0")).distinct()
    files = lines.agg(F.concat(F.lit("User-agent: *\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("text")).select(F.lit(SITE).alias("origin"), "text")
    return responses.crawl_stored(_seed(spark, sf_dir), written(answers), files, responses.CrawlConfig(crawl_depth=DEPTH))


def stored_crawl(spark, sf_dir):
    """A crawl of the pages as stored answers, to depth 3, with robots.txt obeyed."""
    return _stored(spark, sf_dir).pages.select("url", "final_url", "status_code", "content_type", "depth", "parent_url", F.size("extracted.internal_links").alias("n_links"))


def stored_crawl_stats(spark, sf_dir):
    """That crawl's counters."""
    c = _stored(spark, sf_dir)
    s = "crawl_stats."
    return c.crawl.select(*[F.col(s + k).alias(k) for k in ("urls_discovered", "urls_scheduled", "requests_attempted", "responses_received", "html_pages_crawled", "successful_pages", "failed_pages", "robots_blocked", "duplicate_urls", "redirects", "non_html_responses")], F.col("crawl_diagnostics.request_failures").alias("request_failures"), F.lit(c.unfetched.count()).cast("bigint").alias("unfetched"))


_STORED = f"""with recursive {_ADDRESSED}, f as (select links[1] as url, min(page_id) as page_id from a group by links[1]),
 ans as (select f.url, page_id, a.links, {_STATUS} as status, lower({_KIND}) as kind from f join a using (page_id)),
 p as (select substr(links[1], {len(SITE) + 1}) as p from a where length(substr(links[1], {len(SITE) + 1})) >= 4),
 rules as (select distinct substring(p, 1, 3) as r, true as refuse from p where ord(substring(p, 3, 1)) % 4 = 1 union select distinct substring(p, 1, 4), false from p where ord(substring(p, 4, 1)) % 3 = 0),
 names as (select url from seed union select unnest(links) from a),
 judged as (select n.url, coalesce((select arg_max(refuse, length(r)) from rules where starts_with(substr(n.url, {len(SITE) + 1}), r)), false) as blocked from names n),
 node as (select j.url, blocked, status, kind, coalesce(not blocked and kind like '%text/html%', false) as open from judged j left join ans using (url)),
 edge as (select distinct ans.url, unnest(links) as link from ans join node using (url) where open),
 walk(url, depth) as (select url, 0 from seed union select link, depth + 1 from walk join edge using (url) where depth < {DEPTH}),
 reach as (select url, min(depth) as depth from walk group by url),
 asked as (select url, depth, false as again from reach union all select seed.url, (select min(r.depth) + 1 from reach r join edge on edge.url = r.url where edge.link = seed.url), true from seed where exists (select 1 from reach r join edge on edge.url = r.url where edge.link = seed.url and r.depth < {DEPTH})),
 parent as (select edge.link as url, r.depth + 1 as depth, min(r.url) as parent_url from reach r join edge on edge.url = r.url group by 1, 2),
 got as (select asked.*, blocked, status, kind, parent_url from asked join node using (url) left join parent using (url, depth)),
 req as (select count(*) as n from got join edge on edge.url = got.url where got.depth < {DEPTH}),"""
_STORED_PAGES = _STORED + """ n as (select url, count(distinct link) as n_links from (select ans.url, unnest(links) as link from ans) group by url)
select url, url as final_url, status as status_code, kind as content_type, depth, parent_url, case when kind like '%text/html%' then n_links else 0 end::int as n_links from got join n using (url) where not blocked and status is not null"""
_STORED_STATS = _STORED + """ t as (select count(*) as scheduled, count(*) filter (not blocked and status = 500) * 2 as retries, count(*) filter (blocked) as blocked, count(*) filter (not blocked and status is not null) as pages, count(*) filter (not blocked and kind like '%text/html%') as html, count(*) filter (not blocked and kind like '%text/html%' and status < 400) as good, count(*) filter (not blocked and status is null) as lost from got)
select (select count(*) from reach) as urls_discovered, scheduled + retries as urls_scheduled, scheduled + retries - blocked + 1 as requests_attempted, pages + 1 as responses_received, html as html_pages_crawled, good as successful_pages, html - good as failed_pages, blocked as robots_blocked,
 req.n - (scheduled - 1) as duplicate_urls, 0::bigint as redirects, pages - html as non_html_responses, lost as request_failures, blocked as unfetched from t, req"""


def dump_roundtrip(spark, sf_dir):
    """The overlay's crawl written as a dump, one file, and read back by as many tasks as it has splits."""
    path = new_folder(spark)
    dumps.write_dumps(overlay.crawl(spark, sf_dir), path)
    p = dumps.load_dumps(spark, f"{path}/*.json").pages
    x = "extracted."
    return p.select("url", "status_code", "content_type", "depth", F.size("redirect_chain").alias("hops"), F.col(x + "title").alias("title"), F.col(x + "meta_description").alias("meta_description"), F.size(x + "h1s").alias("n_h1"), F.size(x + "internal_links").alias("n_links"), F.col(x + "canonical").alias("canonical"), F.col(x + "visible_text").alias("content"), F.col("diagnostics.malformed_jsonld_count").alias("malformed"))


_SCRIPT = """case page_id % 8
 when 0 then concat('{"@type":"Article","datePublished":"2024-01-', cast(10 + page_id % 20 as varchar(20)), '","n":', cast(page_id as varchar(20)), '}')
 when 1 then concat('[{"@type":"Product","uploadDate":"d', cast(page_id as varchar(20)), '"},5,"x",{"@type":["Article"]},{"@type":"BlogPosting","dateModified":"m"}]')
 when 2 then '{"@context":"c","@graph":[{"@type":"NewsArticle","dateModified":"2024-02-02","datePublished":"2024-02-01"},{"@id":"b"}]}'
 when 3 then '{"@graph":[{"@graph":[{"@type":"Article","datePublished":"2020-01-01"}]}]}'
 when 4 then case page_id % 3 when 0 then '"text"' when 1 then 'null' else cast(page_id as varchar(20)) end
 when 5 then '{"@type": "Article",'
 when 6 then '{"@graph":{"@type":"Article"},"datePublished":7}'
 else '[]' end"""
_MORE = "case page_id % 3 when 0 then concat('{\"@type\":\"Product\",\"dateModified\":\"p', cast(page_id as varchar(20)), '\"}') when 1 then '{bad' end"


def jsonld_objects(spark, sf_dir):
    """JSON-LD of every kind put into the real pages, extracted, and read as VARIANT."""
    tag = lambda e: f"concat('<script type=\"application/ld+json\">', {e.replace('varchar(20)', 'string')}, '</script>')"
    html = f"replace(html, '</head>', concat({tag(_SCRIPT)}, coalesce({tag(_MORE)}, ''), '</head>'))"
    p = _pages(spark, sf_dir).select(F.lit("c").alias("crawl_id"), F.col("page_id").alias("page_seq"), "url", F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), F.expr(html).alias("raw_html"))
    return jsonld.by_page(extract_pages(p).select("crawl_id", "page_seq", "extracted")).drop("crawl_id").withColumnRenamed("page_seq", "page_id")


_JSONLD = f"""with s as (select page_id, 0 as nth, {_SCRIPT} as t from pages union all select page_id, 1, {_MORE} from pages where {_MORE} is not null),
 v as (select page_id, nth, case when json_valid(t) then t end as j from s),
 l as (select page_id, nth, case json_type(j) when 'ARRAY' then json_extract(j, '$[*]') when 'OBJECT' then case when json_type(j, '$."@graph"') = 'ARRAY' then json_extract(j, '$."@graph"[*]') else [j::json] end else [] end as l from v where j is not null),
 o as (select page_id, nth, unnest(range(1, len(l) + 1)) as i, unnest(l) as o from l),
 d as (select page_id, nth, i, unnest([0, 1, 2]) as k, unnest(['datePublished', 'dateModified', 'uploadDate']) as field, o from o where json_type(o) = 'OBJECT'),
 dates as (select page_id, string_agg(field || '=' || json_extract_string(o, '$.' || field), ',' order by nth, i, k) as dates from d where json_type(o, '$.' || field) = 'VARCHAR' group by page_id),
 t as (select *, case when json_type(o) = 'OBJECT' and json_type(o, '$."@type"') = 'VARCHAR' then case when json_extract_string(o, '$."@type"') in ('Article', 'NewsArticle', 'BlogPosting') then 'article' when json_extract_string(o, '$."@type"') = 'Product' then 'product' end end as kind from o),
 n as (select page_id, count(*) as objects, arg_min(kind, nth * 1000 + i) filter (kind is not null) as kind from t group by page_id),
 m as (select page_id, count(*) filter (j is null) as malformed from v group by page_id)
select page_id, coalesce(objects, 0) as objects, malformed, kind, coalesce(dates, '') as dates from m left join n using (page_id) left join dates using (page_id)"""

#: what a semantic finding says of its page, in eight ways: right, other text, no such field, a field without value, lists, a wrong confidence, nothing
_DETAILS = """case page_id % 8
 when 0 then concat('{"confidence":0.9,"sources":[{"field":"title","text":"itle ', cast(page_id as string), '"},{"field":"visible_text","text":""}]}')
 when 1 then '{"sources":[{"field":"title","text":"another"},{"field":"none_such","text":"x"}]}'
 when 2 then '{"confidence":1.5,"sources":[{"field":"h1s","text":"One"},{"field":"h1s","text":"Four"}]}'
 when 3 then '{"confidence":"high","sources":[{"field":"canonical","text":"p"}]}'
 when 4 then '{"confidence":-1,"sources":[{"field":null,"text":"x"},{"field":"meta_description","text":"About"}]}'
 when 5 then '{"sources":[{"field":"meta_robots","text":"follow"}],"confidence":true}'
 when 6 then '{"confidence":null}'
 else 'no json' end"""


def semantic_sources(spark, sf_dir):
    """V8: semantic findings on the overlay's pages whose details name sources that fit or fail in each way, with their errors."""
    c = overlay.crawl(spark, sf_dir)
    f = c.pages.select("crawl_id", F.col("page_seq").alias("page_id"), F.col("url").alias("page"), finding_id(F.lit("S"), F.col("url")).alias("id"), F.lit("semantic").alias("trigger_type"), F.expr(_DETAILS.replace("page_id", "page_seq")).alias("details"))
    return validation.semantic_sources(f, c.pages).select("page_id", F.array_join("semantic_errors", "|").alias("errors"))


def _none(field: str) -> str:
    return f"'A semantic source names the field \"{field}\", which the page has no value for.'"


def _other(field: str) -> str:
    return f"'A semantic source quotes text that the page''s field \"{field}\" does not hold.'"


_WORTH = "'Semantic confidence is no number from 0 to 1.'"
_SOURCES = f"""with o as (select page_id, {', '.join(f'{overlay.SCALARS[k]} as {k}' for k in ('title', 'n_h1', 'canonical', 'meta_description', 'robots'))} from pages), e as (select page_id, case page_id % 8
 when 0 then [case when title is null then {_none('title')} when not contains(title, 'itle ' || page_id) then {_other('title')} end]
 when 1 then [case when title is null then {_none('title')} else {_other('title')} end, 'A semantic source names the field "none_such", which no page has.']
 when 2 then [{_WORTH}, case when n_h1 = 0 then {_other('h1s')} end, {_other('h1s')}]
 when 3 then [{_WORTH}, case when canonical is null then {_none('canonical')} when not contains(canonical, 'p') then {_other('canonical')} end]
 when 4 then [{_WORTH}, case when meta_description is null then {_none('meta_description')} when not contains(meta_description, 'About') then {_other('meta_description')} end]
 when 5 then [case when not contains(coalesce(robots, ''), 'follow') then {_other('meta_robots')} end]
 when 6 then [{_WORTH}] else [] end as e from o)
select page_id, array_to_string(list_filter(e, lambda x: x is not null), '|') as errors from e"""


class MissingDescription(PageRule):
    """A page-local rule, as a user would write it."""

    vars().update(known_texts("AI-META-003"))
    needs = ("crawl_id", "page_seq", "url", "status_code", "content_type", "extracted")

    def check(self, page):
        if page.status_code == 200 and page.content_type.startswith("text/html") and not (page.extracted.meta_description or "").strip():
            yield {"page": page.url, "source": "extracted", "field": "meta_description", "observed_value": "None or empty"}


class UnreadableDate(PageRule):
    """A rule with a setting: the sources to look at."""

    vars().update(known_texts("FR-DATE-002"))
    needs = ("crawl_id", "page_seq", "url", "status_code", "content_type", "extracted")

    def check(self, page):
        from ..functions.dates import parse_one

        if page.status_code != 200 or not page.content_type.startswith("text/html"):
            return
        for d in page.extracted.date_candidates:
            if self.settings.get("source", d.source) == d.source and parse_one(d.value)[1] == "UNPARSEABLE":
                yield {"key": page.url + d.source + d.field, "page": page.url, "source": d.source, "field": d.field, "observed_value": f"Unparseable format: '{d.value}'"}


class MissingAlternatives(PageRule):
    """A rule whose partition is a crawl; it tells what it has seen when the crawl is over."""

    vars().update(known_texts("ENG-MEDIA-001"))
    needs = ("crawl_id", "page_seq", "url", "status_code", "extracted")

    def check(self, page):
        images, alts = len(page.extracted.image_urls), sum(bool(a.strip()) for a in page.extracted.image_alts)
        if page.status_code == 200 and images > alts:
            yield {"page": page.url, "observed_value": None, "details": f'{{"total_images":{images},"images_with_alt":{alts},"images_missing_alt":{images - alts}}}'}


def rule_functions(spark, sf_dir):
    """A user's rule of each pipeline, called as a table function from SQL, with and without partitions and with a setting."""
    overlay.crawl(spark, sf_dir).pages.createOrReplaceTempView("rule_pages")
    register(spark, "missing_description", MissingDescription)
    register(spark, "unreadable_date", UnreadableDate)
    register(spark, "missing_alternatives", MissingAlternatives)
    return spark.sql("""
      select rule_id, id, page, severity, observed_value, details from missing_description(table(rule_pages))
      union all select rule_id, id, page, severity, observed_value, details from unreadable_date(table(rule_pages), source => 'meta')
      union all select rule_id, id, page, severity, observed_value, details from missing_alternatives(table(rule_pages) partition by crawl_id)""")


def observed_diagnostics(spark, sf_dir):
    """G10 from counts that the one pass over the findings has observed."""
    c = overlay.crawl(spark, sf_dir)
    return A.observed_diagnostics(c).select("rule_id", "status", "findings_generated", "valid_findings", "invalid_findings")


def rendered_text(spark, sf_dir):
    """E5 to E9, E14, E16 on the real pages: link sets, links with their texts, and visible text."""
    h = extract_pages(_pages(spark, sf_dir).select("page_id", "url", F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), F.col("html").alias("raw_html")))
    e = "extracted."
    said: Column = F.transform(e + "detailed_internal_links", lambda x: F.concat(x["url"], F.lit(" "), x["text"]))
    return h.select("page_id", F.array_join(F.array_sort(e + "internal_links"), " ").alias("internal_links"), F.size(e + "external_links").alias("n_external"), F.sha2(F.array_join(said, "|"), 256).alias("link_texts"), F.sha2(e + "visible_text", 256).alias("text_sha256"), F.col("diagnostics.visible_text_length").alias("text_length"))


_UNESCAPED = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TEXT_SQL = rf"""with b as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, html, regexp_replace(regexp_replace(regexp_extract(html, '<body[^>]*>(.*)', 1, 's'), '<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'gs'), '<!--.*?-->', '', 'gs') as body from pages),
 t as (select page_id, origin, html, array_to_string(list_filter(list_transform(string_split_regex(body, '<[^>]*>'), lambda x: trim({_UNESCAPED.format(x='x')}, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), ' ') as text from b),
 l as (select page_id, origin, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2)) as said, unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1)))) as i from t),
 u as (select page_id, i, origin || regexp_replace({_UNESCAPED.format(x='href')}, '#.*$', '') as to_url, trim({_UNESCAPED.format(x='said')}) as said from l),
 g as (select page_id, array_to_string(list_sort(list_distinct(list(to_url))), ' ') as internal_links, sha256(string_agg(to_url || ' ' || said, '|' order by i)) as link_texts from u group by page_id)
select t.page_id, coalesce(internal_links, '') as internal_links, 0 as n_external, coalesce(link_texts, sha256('')) as link_texts, sha256(text) as text_sha256, length(text)::int as text_length from t left join g using (page_id)"""

_DUMPED = f"select url, status_code, content_type, depth, hops, title, meta_description, n_h1, case when link_b is null or link_a = link_b then 1 else 2 end as n_links, canonical, content, malformed from (select page_id, {', '.join(f'{v} as {k}' for k, v in overlay.SCALARS.items())} from pages)"

QUERIES = {f.__name__: f for f in (frontier_pages, redirects, stored_crawl, stored_crawl_stats, dump_roundtrip, jsonld_objects, semantic_sources, rule_functions, observed_diagnostics, rendered_text)}
SQL = {"frontier_pages": _FRONTIER, "redirects": _REDIRECTS, "stored_crawl": _STORED_PAGES, "stored_crawl_stats": _STORED_STATS, "dump_roundtrip": _DUMPED, "jsonld_objects": _JSONLD, "semantic_sources": _SOURCES, "rendered_text": _TEXT_SQL}
RENDERED = rendered.RENDERED
