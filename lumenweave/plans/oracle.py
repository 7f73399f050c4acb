"""SQL of the registered queries, for comparison by another engine on the same tables."""

from __future__ import annotations

from ..operators.catalog import RULE_TEXTS
from . import checks, crawls
from .overlay import SCALARS
from .rendered import RENDERED

_TEXT = {r[0]: r for r in RULE_TEXTS}
_AUDIT = "timestamp '2024-09-04 00:00:00'"
_O = "with o as (select page_id, " + ", ".join(f"{e} as {c}" for c, e in SCALARS.items()) + " from pages)"
_OK = "status_code = 200 and content_type like 'text/html%'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _id(rule: str, key: str) -> str:
    return f"upper('F-{rule}-' || substr(sha256('{rule}' || {key}), 1, 32))"


def _find(rule: str, when: str, observed: str, source: str, field: str, key: str = "url", table: str = "o") -> str:
    _, _, severity, title, _ = _TEXT[rule]
    lit = lambda s: s if s.startswith("=") else _q(s)
    return f"select '{rule}' as rule_id, {_id(rule, key)} as id, url as page, '{severity}' as severity, {_q(title)} as title, {lit(source).lstrip('=')} as source, {lit(field).lstrip('=')} as field, {observed} as observed_value from {table} where {when}"


def _all(*parts: str) -> str:
    return " union all ".join(parts)


_chain = "case hops when 2 then url || '?r=1 -> ' || url || '?r=2' when 3 then url || '?r=1 -> ' || url || '?r=2 -> ' || url || '?r=3' end"
_PAGE = _all(
    _find("AI-CRAWL-001", "status_code between 400 and 499 and content_type like 'text/html%'", "cast(status_code as varchar)", "status_code", "status_code"),
    _find("AI-CRAWL-002", "status_code >= 500 and content_type like 'text/html%'", "cast(status_code as varchar)", "status_code", "status_code"),
    _find("AI-ROBOTS-002", "lower(robots) like '%noindex%'", "'noindex directive present'", "meta_robots", "meta_robots"),
    _find("AI-ROBOTS-003", "page_type <> 'fragment' and lower(robots) like '%nofollow%'", "'nofollow directive present'", "meta_robots", "meta_robots"),
    _find("AI-REDIRECT-001", "hops >= 2", _chain, "redirect_chain", "redirect_chain"),
    _find("AI-CANONICAL-001", f"{_OK} and coalesce(canonical, '') = ''", "'No canonical tag found'", "extracted", "canonical"),
    _find("AI-LINK-004", f"{_OK} and depth >= 4", "cast(depth as varchar)", "crawler", "depth"),
    _find("AI-HTML-001", f"{_OK} and n_h1 = 0", "'0 H1 tags found'", "extracted", "h1s"),
    _find("AI-META-001", f"{_OK} and title is null", "'None'", "extracted", "title"),
    _find("AI-META-002", f"{_OK} and trim(title) = ''", "'\"\"'", "extracted", "title"),
    _find("AI-META-003", f"{_OK} and trim(coalesce(meta_description, '')) = ''", "'None or empty'", "extracted", "meta_description"),
    _find("AI-SCHEMA-001", f"{_OK} and malformed > 0", "cast(malformed as varchar)", "diagnostics", "malformed_jsonld_count"),
    _find("AI-CONTENT-002", f"{_OK} and text_length > 0 and text_length < 50", "cast(text_length as varchar)", "diagnostics", "visible_text_length"),
)
_GRAPH = _O + ", g as (select url as target, status_code as t_status, hops as t_hops from o)"
_LINKS = _GRAPH + f""", e as (select distinct url, unnest([link_a, link_b]) as target from o where {_OK}),
 h as (select e.url, e.target, t_status >= 400 as broken, t_hops > 0 as moved from e join g using (target)),
 lk as (select url, array_to_string(list_slice(list_sort(list(target) filter (where broken)), 1, 5), ', ') as broken, array_to_string(list_slice(list_sort(list(target) filter (where moved)), 1, 5), ', ') as moved from h group by url) """
# dates: the overlay has six spellings, read here by case
_TS = {"2024-02-30": None, "2099-01-01": "2099-01-01 00:00:00", "2019-05-06T07:08:09+02:00": "2019-05-06 05:08:09", "2024-03-01": "2024-03-01 00:00:00", "2021-08-01T00:00:00Z": "2021-08-01 00:00:00", "2024-01-01": "2024-01-01 00:00:00", "2024-09-01": "2024-09-01 00:00:00", "2024-03-02T01:00:00+03:00": "2024-03-01 22:00:00", "2022-01-01": "2022-01-01 00:00:00"}


def _ts(c: str) -> str:
    return "case " + c + " " + " ".join(f"when '{k}' then timestamp '{v}'" for k, v in _TS.items() if v) + " end"


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S+00:00')"


_DATES = _O + f""", d0 as (select *, {_ts('pub')} as p_ts, {_ts('mod')} as m_ts, {_ts('ld')} as l_ts from o where {_OK}),
 d as (select *, coalesce(p_ts, l_ts) as first_pub, greatest(coalesce(p_ts, timestamp '0001-01-01'), coalesce(m_ts, timestamp '0001-01-01'), coalesce(l_ts, timestamp '0001-01-01')) as best, p_ts is null and m_ts is null and l_ts is null as none from d0),
 x as (select url, 'meta' as src, 'article:published_time' as fld, pub as v, p_ts as ts from d where pub is not null union all select url, 'meta', 'article:modified_time', mod, m_ts from d where mod is not null union all select url, 'json_ld', 'datePublished', ld, l_ts from d where ld is not null) """
_key = "url || src || fld"
_FRESH = _DATES + _all(
    _find("FR-DATE-001", "page_type = 'article' and none", "'No valid date found'", "extracted", "date_candidates", table="d"),
    _find("FR-DATE-002", "ts is null and not regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')", "'Unparseable format: ''' || v || ''''", "=src", "=fld", _key, "x"),
    _find("FR-DATE-003", "ts is null and regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')", "'Impossible date: ''' || v || ''''", "=src", "=fld", _key, "x"),
    _find("FR-DATE-004", f"ts > {_AUDIT} + interval 24 hour", f"'Future date: ''' || v || ''' (Normalized: ' || {_iso('ts')} || ') vs Audit Time: 2024-09-04T00:00:00+00:00'", "=src", "=fld", _key, "x"),
    _find("FR-CONS-001", "first_pub > m_ts + interval 24 hour", f"'Published ' || {_iso('first_pub')} || ' occurs > 24h after Modified ' || {_iso('m_ts')}", "extracted", "dates", table="d"),
    _find("FR-CONS-002", "p_ts <> l_ts and cast(p_ts as date) <> cast(l_ts as date)", f"'Meta (' || {_iso('p_ts')} || ') and JSON-LD (' || {_iso('l_ts')} || ') differ significantly'", "extracted", "dates", table="d"),
    _find("FR-STALE-001", f"page_type = 'article' and not none and best < {_AUDIT} - interval 731 day + interval 1 microsecond", f"'Age > 2 years: (' || {_iso('best')} || ')'", "extracted", "dates", table="d"),
    _find("FR-STALE-002", f"page_type = 'product' and not none and best < {_AUDIT} - interval 1096 day + interval 1 microsecond", f"'Age > 3 years: (' || {_iso('best')} || ')'", "extracted", "dates", table="d"),
)
_nav = "(case when page_id % 3 = 0 then true else coalesce(link_a, '') in ('', url) and coalesce(link_b, '') in ('', url) end)"
_alts = "((case when trim(coalesce(alt_a, '')) <> '' then 1 else 0 end) + (case when trim(coalesce(alt_b, '')) <> '' then 1 else 0 end))"
_DUP = _O + f""", t as (select url, page_id, sha256(regexp_replace(content, '\\s+', '', 'g')) as h from o where {_OK} and regexp_replace(content, '\\s+', '', 'g') <> ''),
 c as (select h, list(url order by page_id) as u, count(*) as n from t group by h having count(*) > 1), s as (select count(*) as pages from pages),
 q as (select 'AI-CONTENT-001' as rule_id, {_id('AI-CONTENT-001', "array_to_string(list_sort(u), '')")} as id, u[1] as page, 'Exact duplicate across ' || n || ' pages' as observed_value, pages as pages_checked, n as pages_affected,
   round_even((cast(n as double) / pages) * 100, 2) as affected_percentage, (cast(n as double) / pages) * 100 as exact, array_to_string(u[1:5], ' ') as sample, n > 5 as truncated from c, s) """
_GROUPS = _O + ", f as (" + _PAGE + f"""), s as (select count(*) as pages from pages),
 r as (select *, row_number() over (partition by rule_id order by page, id) as k from (select distinct rule_id, id, page, severity, title, observed_value from f)),
 g as (select rule_id, severity, title, count(*) as n_sources, count(distinct page) as n, array_to_string(list_slice(list_sort(list(distinct page)), 1, 10), ' ') as sample, max(page) filter (where k = 1) as page, max(observed_value) filter (where k = 1) as observed_value from r group by all) """
_words = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"
_gate = f"case when doc_id % 9 = 0 then 'skipped_by_gate' when lang is null then 'unsupported_language' when lang <> 'en' then 'unsupported_language' when coalesce(text, '') = '' or {_words} < 50 then 'skipped_by_gate' else 'eligible' end"
_b = "(cast(o_orderdate as timestamp) + to_hours(cast(o_orderkey % 100 as integer)))"

ORACLE_SQL = {
    "overlay_page_rules": f"{_O} {_PAGE}",
    "overlay_engagement": f"""{_O} select 'ENG-NAV-001' as rule_id, {_id('ENG-NAV-001', 'url')} as id, url as page, 'medium' as severity, '{{"page_type":"' || page_type || '","outbound_internal_link_count":0}}' as details from o where status_code = 200 and page_type in ('article', 'product') and {_nav}
      union all select 'ENG-MEDIA-001', {_id('ENG-MEDIA-001', 'url')}, url, 'medium', '{{"total_images":' || n_images || ',"images_with_alt":' || {_alts} || ',"images_missing_alt":' || (n_images - {_alts}) || '}}' from o where status_code = 200 and n_images > 0 and n_images > {_alts}""",
    "overlay_freshness": _FRESH,
    "overlay_canonical": _GRAPH + f", p as (select page_id, url, 'https://site.example/' || canonical as target from o where {_OK} and coalesce(canonical, '') <> ''), j as (select p.*, t_status, t_hops from p join g using (target)) " + _all(_find("AI-CANONICAL-002", "t_status >= 400", "target", "canonical", "canonical", table="j"), _find("AI-CANONICAL-003", "t_hops > 0", "target", "canonical", "canonical", table="j")),
    "overlay_links": _LINKS + _all(_find("AI-LINK-001", "broken <> ''", "broken", "internal_links", "internal_links", table="lk"), _find("AI-LINK-002", "moved <> ''", "moved", "internal_links", "internal_links", table="lk")),
    "overlay_orphans": _O + ", l as (select unnest([link_a, link_b]) as u from o), p as (select * from o where url not in (select u from l where u is not null)) " + _find("AI-LINK-003", f"{_OK} and depth > 0", "'0 incoming internal links found'", "graph", "incoming_links", table="p"),
    "overlay_duplicates": _DUP + "select * exclude (exact) from q",
    "overlay_robots": "with b as (select 'https://site.example/hidden' || page_id as u, page_id from pages where page_id % 25 = 6 and page_id % 2 = 0), s as (select 'https://site.example/p0' as url, count(*) as n, array_to_string(list_slice(list(u order by page_id), 1, 3), ', ') as m from b) " + _find("AI-ROBOTS-001", "n > 0", "n || ' URLs blocked. Examples: ' || m", "unfetched_urls", "robots_blocked", table="s"),
    "overlay_crawl_stats": f"{_O} select count(*) as responses_received, count(*) filter (where content_type like '%text/html%') as html_pages_crawled, count(*) filter (where content_type like '%text/html%' and status_code < 400) as successful_pages, count(*) filter (where content_type like '%text/html%' and status_code >= 400) as failed_pages, count(*) filter (where content_type not like '%text/html%') as non_html_responses from o",
    "overlay_profile": f"{_O} select page_type, count(*) as pages, count(*) filter (where link_a is null and link_b is null) as without_links, sum(n_images) as images, sum((alt_a is not null)::int + (alt_b is not null)::int) as image_alts, count(*) filter (where coalesce(title, '') = '') as no_title, count(*) filter (where coalesce(meta_description, '') = '') as no_meta_description, cast(0 as bigint) as no_language, count(*) filter (where coalesce(canonical, '') = '') as no_canonical, count(*) filter (where content = '') as no_visible_text from o group by page_type",
    "document_duplicates": r"with d as (select doc_id, regexp_replace(text, '\s+', '', 'g') as t from documents) select sha256(t) as h, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from d where t <> '' group by sha256(t) having count(*) > 1",
    "document_thin": f"select doc_id, {_id('AI-CONTENT-002', 'cast(doc_id as varchar)')} as id, length(text) as observed_value from documents where length(text) > 0 and length(text) < 50",
    "document_gate": f"select doc_id, {_gate} as state, {_words} as n_words from documents",
    "document_truncation": rf"select doc_id, sha256(case when {_words} > 1500 then array_to_string(list_slice(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), 1, 1500), ' ') else text end) as text_sha256 from documents",
    "semantic_candidates": f"with d as (select doc_id, case when coalesce(lang, '') <> 'en' then 'unsupported_language' when coalesce(text, '') = '' or {_words} < 50 then 'skipped_by_gate' end as state from documents), r as (select *, row_number() over (partition by state order by 'https://x.example/d/' || doc_id) as k from d) select doc_id, coalesce(state, case when k <= 100 then 'analysed' else 'skipped_by_budget' end) as state from r",
    "scalar_ids": "select doc_id, upper('F-AI-X-1-' || substr(sha256('AI-X-1' || coalesce(source, '') || doc_id), 1, 32)) as finding, upper('G-AI-X-1-' || substr(sha256(coalesce(lang, '') || 'AI-X-1deterministic' || coalesce(source, '')), 1, 32)) as grp, sha256('&lt;''' || source || '''&gt;') as escaped from documents",
    "scalar_urls": "select page_id, regexp_replace(url, '#.*$', '') as bare, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) as host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as ok, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) in ('example.com', 'example.org') or lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) like '%.example.com' or lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) like '%.example.org' as inside from pages",
    "scalar_dates": f"with t as (select o_orderkey, cast(o_orderdate as timestamp) as a, {_b} as b from orders) select o_orderkey, strftime(b, '%Y-%m-%dT%H:%M:%S+00:00') as iso, b > timestamp '1998-06-01' + interval 24 hour as future, cast(epoch_us(b) - epoch_us(a) as double) / 3600000000.0 as hours, b <= a + interval 24 hour as in_order, cast(a as date) = cast(b as date) as same_day, cast(floor((epoch_us(timestamp '1998-06-01') - epoch_us(b)) / 86400000000.0) as bigint) as age_days from t",
    "scalar_percentages": "select source, round_even((cast(count(*) filter (where lang = 'en') as double) / count(*)) * 100, 2) as pct from documents group by source",
    "overlay_groups": _GROUPS + "select upper('G-' || rule_id || '-' || substr(sha256('ai_discoverability' || rule_id || 'deterministic' || severity), 1, 32)) as group_id, rule_id, page, observed_value, pages as pages_checked, n as pages_affected, round(least((cast(n as double) / pages) * 100, 100), 9) as affected_percentage, sample, n > 10 as truncated, n_sources from g, s",
    "overlay_score": _GROUPS + "select cast(greatest(0, 100 - coalesce(sum(case severity when 'high' then 20 when 'medium' then 10 when 'low' then 5 end), 0)) as bigint) as score, count(*) as total_findings, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low, cast(0 as bigint) as info from g",
    "overlay_counts": _O + ", f as (" + _PAGE + f") select severity, count(*) as findings from (select severity from f union all select 'medium' from o where status_code = 200 and page_type in ('article', 'product') and {_nav} union all select 'medium' from o where status_code = 200 and n_images > 0 and n_images > {_alts}) group by severity",
    "overlay_finding_checks": _DUP + "select id, page, cast(case when abs(affected_percentage - exact) > 0.001 then 1 else 0 end as bigint) as n_errors from q",
    "html_fields": r"select page_id, replace(replace(replace(regexp_extract(html, '<title[^>]*>([^<]*)<', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title, regexp_extract(html, '<html[^>]* lang=.([A-Za-z-]+)', 1) as language, cast(len(regexp_extract_all(html, '<h1[ >]')) as bigint) as n_h1, cast(octet_length(encode(html)) as bigint) as html_size, cast(len(regexp_extract_all(html, '<img ')) as bigint) as n_images from pages",
}


def _rows(name: str, pipeline: str, severity: str = "severity", page: str = "page", ok: str = "true") -> str:
    return f"select '{pipeline}' as pipeline, rule_id, {severity} as severity, {page} as page, {ok} as ok from ({ORACLE_SQL[name]})"


_EXACT = _DUP + "select *, 'medium' as severity, abs(affected_percentage - exact) <= 0.001 as fits from q"
#: every finding of the overlay, and whether it passes its checks
_EVERY = _all(
    *[_rows(n, "ai_discoverability") for n in ("overlay_page_rules", "overlay_canonical", "overlay_links", "overlay_orphans")],
    _rows("overlay_robots", "ai_discoverability", ok="exists (select 1 from pages where page_id = 0)"),
    _rows("overlay_engagement", "engagement"),
    _rows("overlay_freshness", "freshness"),
    f"select 'ai_discoverability', rule_id, severity, page, fits from ({_EXACT})",
)
_CATALOG = "(values " + ", ".join(f"('{r[0]}', {_q(r[3])})" for r in RULE_TEXTS) + ") as r(rule_id, title)"
_GROUP_ID = "upper('G-' || rule_id || '-' || substr(sha256(pipeline || rule_id || 'deterministic' || severity), 1, 32))"
_SOURCED = "case when rule_id = 'AI-CANONICAL-002' then false when rule_id = 'AI-ROBOTS-001' then exists (select 1 from pages where page_id = 0) else true end"
#: groups of the findings that passed, with whether each passes as a group
_VALID = f"select pipeline, rule_id, severity, {_GROUP_ID} as group_id, count(distinct page) as pages_affected, {_SOURCED} as good from ({_EVERY}) where ok group by pipeline, rule_id, severity"
_HTML = "select page_id, url, html from pages"

#: addresses that the raw pages' links lead to
_HTML_LINKS = """select case when starts_with(x, '/') then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || x else x end as u from (select url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) as x from pages)"""


def _html_find(rule: str, when: str, observed: str) -> str:
    return f"select '{rule}' as rule_id, {_id(rule, 'url')} as id, url as page, '{_TEXT[rule][2]}' as severity, {observed} as observed_value from ({_HTML}) where {when}"


_HTML_FINDINGS = _all(
    _html_find("AI-CANONICAL-001", "not contains(html, 'rel=\"canonical\"')", "'No canonical tag found'"),
    _html_find("AI-META-003", "not contains(html, 'name=\"description\"') and not contains(html, 'og:description')", "'None or empty'"),
    _html_find("AI-HTML-001", "not regexp_matches(html, '<h1[ >]')", "'0 H1 tags found'"),
    _html_find("AI-META-001", "not regexp_matches(html, '<title[ >]')", "'None'"),
    _html_find("AI-LINK-003", f"url not in (select regexp_replace(u, '#.*$', '') from ({_HTML_LINKS}))", "'0 incoming internal links found'"),
)
ORACLE_SQL |= {
    "overlay_rule_diagnostics": f"select r.rule_id, case when coalesce(g, 0) > coalesce(v, 0) then 'INVALID_FINDINGS' when coalesce(g, 0) = 0 then 'NO_FINDINGS' else 'SUCCESS' end as status, coalesce(g, 0) as findings_generated, coalesce(v, 0) as valid_findings, coalesce(g, 0) - coalesce(v, 0) as invalid_findings from {_CATALOG} left join (select rule_id, count(*) as g, count(*) filter (where ok) as v from ({_EVERY}) group by rule_id) using (rule_id)",
    "overlay_compression": f"select count(*) as raw_findings, count(distinct rule_id) as groups, cast(count(*) as double) / count(distinct rule_id) as ratio from ({_EVERY})",
    "overlay_group_checks": f"with p as (select exists (select 1 from pages where page_id = 0) as home), g as (select pipeline, rule_id, severity, count(*) as n from ({_EVERY}) group by all) select {_GROUP_ID} as group_id, rule_id, rule_id <> 'AI-CANONICAL-002' and (rule_id <> 'AI-ROBOTS-001' or home) as valid, case when rule_id = 'AI-CANONICAL-002' then n when rule_id = 'AI-ROBOTS-001' and not home then 1 else 0 end as bad_sources, cast(case when rule_id = 'AI-CANONICAL-002' then 1 when rule_id = 'AI-ROBOTS-001' and not home then 3 else 0 end as bigint) as n_errors from g, p",
    "audit_groups": f"select group_id, pipeline, severity, title, pages_affected, case when pipeline <> 'engagement' then 'successful' end as outcome from ({_VALID}) join {_CATALOG} using (rule_id) where good",
    "enrichment_counts": f"select n as eligible_groups, n as requests_attempted, n as successful, 0::bigint as rate_limited, 0::bigint as timeouts, 0::bigint as provider_failures, 0::bigint as invalid_responses, 0::bigint as skipped_by_budget from (select count(*) as n from ({_VALID}) where good and pipeline <> 'engagement')",
    "overlay_bad_findings": f"{_O} select page_id, cast(case page_id % 13 when 11 then 0 when 12 then 0 when 7 then 2 when 8 then 2 when 10 then 3 else 1 end as bigint) as n_errors from o where {_OK} and trim(coalesce(meta_description, '')) = ''",
    "overlay_finding_dedup": f"{_O}, f as ({_PAGE}) select rule_id, count(*) + count(*) filter (where cast(regexp_extract(page, '([0-9]+)$', 1) as bigint) % 2 = 0) as findings from f group by rule_id",
    "overlay_scores": f"with g as (select rule_id, severity from (select rule_id, severity from ({ORACLE_SQL['overlay_page_rules']}) union all select rule_id, severity from ({ORACLE_SQL['overlay_engagement']})) group by all) select rule_id as crawl_id, cast(100 - case severity when 'high' then 20 when 'medium' then 10 when 'low' then 5 else 0 end as bigint) as score, cast(1 as bigint) as total_findings, cast(severity = 'high' as bigint) as high, cast(severity = 'medium' as bigint) as medium, cast(severity = 'low' as bigint) as low, cast(severity = 'info' as bigint) as info from g union all select 'none', 100, 0, 0, 0, 0, 0",
    "html_findings": _HTML_FINDINGS,
    "html_groups": f"with f as ({_HTML_FINDINGS}) select upper('G-' || rule_id || '-' || substr(sha256('ai_discoverability' || rule_id || 'deterministic' || severity), 1, 32)) as group_id, rule_id, (select count(*) from pages) as pages_checked, count(distinct page) as pages_affected, count(*) as n_sources from f group by rule_id, severity",
}

#: the overlay's rules over pages that were rendered as HTML and extracted again
_R = "with o as (select page_id, " + ", ".join(f"{e} as {c}" for c, e in RENDERED.items()) + " from pages)"
ORACLE_SQL |= {f"rendered_{n}": ORACLE_SQL[f"overlay_{n}"].replace(_O, _R) for n in ("page_rules", "engagement", "freshness", "canonical", "links", "orphans", "duplicates")}
_FLAT = "rule_id, id, page, severity"
ORACLE_SQL |= crawls.SQL | {
    "observed_diagnostics": ORACLE_SQL["overlay_rule_diagnostics"],
    "rule_functions": f"select {_FLAT}, observed_value, null as details from ({ORACLE_SQL['overlay_page_rules']}) where rule_id = 'AI-META-003' union all select {_FLAT}, observed_value, null from ({ORACLE_SQL['overlay_freshness']}) where rule_id = 'FR-DATE-002' and source = 'meta' union all select {_FLAT}, null, details from ({ORACLE_SQL['overlay_engagement']}) where rule_id = 'ENG-MEDIA-001'",
}
ORACLE_SQL |= checks.sql(_EVERY, _VALID, _GROUP_ID, _GROUPS.rstrip(), ORACLE_SQL["semantic_candidates"], _O, _OK, RULE_TEXTS)
