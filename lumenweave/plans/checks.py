"""Queries whose rows fail on purpose: checks of findings and groups, scopes, report order and fields, and the semantic states, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import grouping, page_rules, semantic, validation
from ..sources.crawl import CRAWL_DIAGNOSTICS
from ..sources.tables import written
from . import audit as A
from . import overlay


def _groups(c, findings: DataFrame) -> DataFrame:
    return grouping.group(findings, c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages")))


def overlay_source_checks(spark, sf_dir):
    """Findings whose page is missing, refused by robots.txt, unknown, or says otherwise, with their errors."""
    c = overlay.crawl(spark, sf_dir)
    f = written(page_rules.evaluate(c.pages, {"AI-META-003"}))
    k = F.col("seq") % 5
    hidden = F.concat(F.lit("https://site.example/hidden"), F.col("seq").cast("string"))
    page = F.when(k == 0, F.lit(None)).when(k == 1, hidden).when(k == 2, F.lit("https://site.example/none")).otherwise(F.col("page"))
    spoiled = f.withColumns({"page": page, "rule_id": F.when(k == 3, F.lit("AI-HTML-001")).otherwise(F.col("rule_id"))})
    return validation.validate_sources(spoiled, c).select(F.col("seq").alias("page_id"), F.size("source_errors").cast("bigint").alias("n_errors"))


def overlay_spoiled_groups(spark, sf_dir):
    """Groups with a sample that repeats an address, with other pages than the crawl has, and without sources."""
    c = overlay.crawl(spark, sf_dir)
    f = written(grouping.deduplicate(page_rules.evaluate(c.pages).where("pipeline = 'ai_discoverability'")))
    g, r = _groups(c, f), F.col("rule_id")
    spoiled = g.withColumns({
        "sample": F.when(r == "AI-META-001", F.concat("sample", F.slice("sample", 1, 1))).otherwise(F.col("sample")),
        "pages_checked": F.when(r == "AI-META-002", F.col("pages_checked") + 100).otherwise(F.col("pages_checked")),
        "n_sources": F.when(r == "AI-META-003", F.lit(0)).otherwise(F.col("n_sources")),
    })
    return validation.validate_groups(written(spoiled), f, c).select("group_id", "rule_id", "valid", F.size("errors").cast("bigint").alias("n_errors"))


def enrichment_prompts(spark, sf_dir):
    """What a model would be asked about each group of page rules, one request a group that has an observed value."""
    c = overlay.crawl(spark, sf_dir)
    g = _groups(c, grouping.deduplicate(written(page_rules.evaluate(c.pages))))
    return g.where("observed_value is not null").select("group_id", E.prompt().alias("prompt"))


def overlay_scopes(spark, sf_dir):
    """What part of a crawl was evaluated, for crawls of a few kinds."""
    f = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("concat('c', cast(page_id % 7 as string)) as crawl_id", "page_id")
    d = "named_struct(" + ", ".join(f"'{x.strip().split(': ')[0]}', cast({ {'configured_page_limit': 'n', 'crawl_termination_reason': 'reason'}.get(x.strip().split(': ')[0], 'null')} as {x.strip().split(': ')[1]})" for x in CRAWL_DIAGNOSTICS[7:-1].split(",")) + ")"
    heads = f.groupBy("crawl_id").agg(F.count("*").alias("n")).withColumn("reason", F.when(F.col("crawl_id").isin("c1", "c2"), F.lit("closespider_pagecount")).otherwise(F.lit("finished")))
    heads = heads.selectExpr("crawl_id", f"{d} as crawl_diagnostics", "reason as finish_reason")
    return E.scope(heads, f, f.where("page_id % 7 in (2, 3) and page_id % 2 = 0").select("crawl_id")).drop("robots_respected", "max_depth")


def overlay_report_order(spark, sf_dir):
    """Every group's place in a report, by id, and its rule's place in the run."""
    c = overlay.crawl(spark, sf_dir)
    g = _groups(c, grouping.deduplicate(written(A.run_rules(c))))
    return grouping.with_places(g).select("group_id", "rule_id", "severity", "place", "id_place", "rule_place")


def audit_fields(spark, sf_dir):
    """The JSON report's summary, scope, tallies and first and last findings, read back from its text."""
    report = A.audit(overlay.crawl(spark, sf_dir), overlay.AUDIT_TIME).json
    v = F.parse_json("report")
    at = lambda path, kind="bigint": F.variant_get(v, path, kind)
    listed = at("$.findings", "array<struct<id: string, trigger: struct<rule_id: string>, evidence: struct<pages_affected: bigint>>>")
    return report.select(
        at("$.site", "string").alias("site"), at("$.summary.overall_score").alias("score"), at("$.summary.total_findings").alias("total_findings"), at("$.summary.severity.high").alias("high"), at("$.summary.severity.medium").alias("medium"), at("$.summary.severity.low").alias("low"),
        at("$.evaluation_scope.status", "string").alias("status"), at("$.evaluation_scope.pages_evaluated").alias("pages_evaluated"), at("$.diagnostics.findings_evaluated").alias("findings_evaluated"), at("$.diagnostics.evidence_valid_findings").alias("evidence_valid_findings"), at("$.diagnostics.excluded_findings").alias("excluded_findings"),
        F.array_join(F.transform(listed, lambda x: F.concat(x["trigger"]["rule_id"], F.lit("="), x["evidence"]["pages_affected"].cast("string"))), " ").alias("findings"),
    )


def audit_markdown_lines(spark, sf_dir):
    """K2: the Markdown report's headings, severities, counts, problems and pages, in the report's order."""
    report = A.audit(overlay.crawl(spark, sf_dir), overlay.AUDIT_TIME).markdown
    lines = F.filter(F.split("report", "\n"), lambda x: x.rlike(r"^(#+ |\*\*(Score|Pages evaluated|Crawl status|Severity|Affected|Problem):\*\*|- \*\*Page:)"))
    return report.select(F.array_join(lines, "\n").alias("lines"))


#: a model's answers to documents, of every kind
_ANSWER = """named_struct('failed', doc_id % 8 = 0, 'malformed', doc_id % 8 = 1, 'timed_out', doc_id % 8 = 7, 'apparent_topic', concat('T', cast(doc_id as string)), 'content_topic', 'C',
 'alignment', case doc_id % 8 when 2 then 'odd' when 4 then 'HIGH' else 'Low' end, 'reason', 'r', 'confidence', case doc_id % 8 when 3 then 0.84D else 0.9D end,
 'sources', case doc_id % 8 when 6 then array(named_struct('source_type', 's', 'field', 'visible_text', 'text', 'never said §')) else array(named_struct('source_type', 's', 'field', 'title', 'text', 't'), named_struct('source_type', 's', 'field', 'visible_text', 'text', substring(text, 3, 20))) end)"""


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = d.select(F.lit("c").alias("crawl_id"), F.col("doc_id").alias("page_seq"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.concat(F.lit("https://x.example/d/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("final_url"), F.struct(F.col("text").alias("visible_text"), F.col("lang").alias("language"), F.lit("t").alias("title")).alias("extracted"))
    answers = d.select(F.lit("c").alias("crawl_id"), F.col("doc_id").alias("page_seq"), F.expr(_ANSWER.replace("\\u00a7", "§")).alias("a")).select("crawl_id", "page_seq", "a.*")
    return semantic.judged(semantic.candidates(p), answers)


def semantic_states(spark, sf_dir):
    """Documents and given answers of a model: the state that each ends in."""
    return _answered(spark, sf_dir).select(F.col("page_seq").alias("doc_id"), "state")


def semantic_findings(spark, sf_dir):
    """What is found on documents whose answers hold."""
    return semantic.interpret(_answered(spark, sf_dir)).select("id", "page", "severity", "rule_id", "observed_value", "excerpt", F.col("nlp.confidence").alias("confidence"))


def sql(every: str, valid: str, group_id: str, groups: str, candidates: str, o: str, ok: str, catalog: list) -> dict[str, str]:
    """The SQL, from the oracle's parts: all findings, those in valid groups, a group's id, groups of page rules, documents' first states, the overlay, and the rules."""
    rank = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 99 end"
    titles = "(values " + ", ".join("('{}', '{}')".format(r[0], r[3].replace("'", "''")) for r in catalog) + ") as t(rule_id, title)"
    placed = f"row_number() over (order by pipeline, {rank}, title, group_id) as place"
    told = "(values " + ", ".join("('{}', '{}')".format(r[0], r[4].replace("'", "''").replace("<", "&lt;").replace(">", "&gt;").replace("`", "''")) for r in catalog) + ") as p(rule_id, action)"
    names = "(values (1, 'ai_discoverability', 'AI Discoverability'), (2, 'freshness', 'Freshness'), (3, 'engagement', 'On-site Engagement')) as n(k, pipeline, name)"
    states = f"""with d as ({candidates}), a as (select d.doc_id, d.state, text from d join documents using (doc_id)), s as (select doc_id, text, case when state <> 'analysed' then state else
 case doc_id % 8 when 0 then 'analysis_failed' when 7 then 'analysis_failed' when 1 then 'invalid_model_output' when 2 then 'invalid_model_output' when 3 then 'analysis_no_observation' when 4 then 'analysis_no_observation' when 6 then 'evidence_invalid' else 'analysis_success' end end as state from a)"""
    return {
        "overlay_source_checks": f"{o} select page_id, case page_id % 5 when 0 then 1 when 1 then case when page_id % 25 = 6 then 2 else 1 end when 2 then 1 when 3 then case when n_h1 > 0 then 1 else 0 end else 0 end::bigint as n_errors from o where {ok} and trim(coalesce(meta_description, '')) = ''",
        "overlay_spoiled_groups": f"""{groups}, e as (select rule_id, severity, case rule_id when 'AI-META-001' then 1 + case when n > 10 and 11 >= n then 1 else 0 end when 'AI-META-002' then 1 + case when abs(n * 100.0 / pages - n * 100.0 / (pages + 100)) > 0.001 then 1 else 0 end when 'AI-META-003' then 1 else 0 end as e from g, s)
 select upper('G-' || rule_id || '-' || substr(sha256('ai_discoverability' || rule_id || 'deterministic' || severity), 1, 32)) as group_id, rule_id, e = 0 as valid, e::bigint as n_errors from e""",
        "overlay_scopes": """with c as (select 'c' || page_id % 7 as crawl_id, count(*) as n, count(*) filter (page_id % 7 in (2, 3) and page_id % 2 = 0) as u from pages group by 1)
 select crawl_id, case when u > 0 then 'Partial' else 'Complete' end as status, case when u > 0 and crawl_id in ('c1', 'c2') then 'Configured page limit reached' when u > 0 then 'Did not evaluate all discovered URLs' else 'Evaluated all discovered URLs' end as reason, n as pages_evaluated, n as max_pages, case when crawl_id in ('c1', 'c2') then 'closespider_pagecount' else 'finished' end as termination_reason from c""",
        "overlay_report_order": f"with g as (select pipeline, rule_id, severity, {group_id} as group_id from ({every}) group by pipeline, rule_id, severity) select group_id, rule_id, severity, {placed}, row_number() over (order by group_id) as id_place, row_number() over (order by rule_id, group_id) as rule_place from g join {titles} using (rule_id)",
        "audit_fields": f"""with v as ({valid}), g as (select v.*, title, {placed} from v join {titles} using (rule_id) where good), n as (select count(*) as n from v)
 select 'https://site.example/p0' as site, greatest(0, 100 - sum(case severity when 'high' then 20 when 'medium' then 10 when 'low' then 5 end))::bigint as score, count(*) as total_findings, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low,
 case when (select count(*) from pages where page_id % 25 = 6) > 0 then 'Partial' else 'Complete' end as status, (select count(*) from pages) as pages_evaluated, n.n as findings_evaluated, count(*) as evidence_valid_findings, n.n - count(*) as excluded_findings, string_agg(rule_id || '=' || pages_affected, ' ' order by place) as findings from g, n group by n.n""",
        "audit_markdown_lines": f"""with v as ({valid}), m as (select pipeline, rule_id, severity, min(page) as page from ({every}) where ok group by all), g as (select v.*, title, action, page, {placed}, k, name from v join m using (pipeline, rule_id, severity) join {titles} using (rule_id) join {told} using (rule_id) join {names} using (pipeline) where good),
 s as (select greatest(0, 100 - sum(case severity when 'high' then 20 when 'medium' then 10 when 'low' then 5 end)) as score from g), c as (select count(*) as n, count(*) filter (page_id % 25 = 6) as lost from pages),
 w as (select k, place, '### ' || title || chr(10) || '**Severity:** ' || upper(severity[1]) || severity[2:] || chr(10) || '**Affected:** ' || pages_affected || ' of ' || n || ' evaluated pages' || chr(10) || '**Problem:** ' || action || chr(10) || '- **Page:** `' || page || '`' || case when pipeline <> 'engagement' then chr(10) || '### GenAI Context' else '' end as line from g, c
   union all select distinct k, 0, '## ' || name from g union all select 9, 0, '## Audit Validation Summary'
   union all select 0, 0, '# AI Readiness Audit Report: https://site.example/p0' || chr(10) || '**Score:** ' || score || '/100' || chr(10) || '**Pages evaluated:** ' || n || chr(10) || '**Crawl status:** ' || case when lost > 0 then 'Partial' else 'Complete' end from s, c)
 select string_agg(line, chr(10) order by k, place) as lines from w""",
        "enrichment_prompts": f"{groups} select upper('G-' || rule_id || '-' || substr(sha256('ai_discoverability' || rule_id || 'deterministic' || severity), 1, 32)) as group_id, 'Explain the impact of ''' || title || ''' (Severity: ' || severity || '). Observed: ' || observed_value || '.' as prompt from g",
        "semantic_states": f"{states} select doc_id, state from s",
        "semantic_findings": f"{states}, u as (select doc_id, text, 'https://x.example/d/' || doc_id as page from s where state = 'analysis_success') select upper('F-SEMANTIC_TOPIC_RELEVANCE-' || substr(sha256('SEMANTIC_TOPIC_RELEVANCE' || page), 1, 32)) as id, page, 'medium' as severity, 'SEMANTIC_TOPIC_RELEVANCE' as rule_id, 'Apparent topic: T' || doc_id || ' vs Content topic: C' as observed_value, substring(text, 3, 20) as excerpt, 0.9::double as confidence from u",
    }


QUERIES = {f.__name__: f for f in (overlay_source_checks, overlay_spoiled_groups, overlay_scopes, overlay_report_order, audit_fields, audit_markdown_lines, enrichment_prompts, semantic_states, semantic_findings)}
