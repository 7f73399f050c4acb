"""An audit from a crawl to reports. Rules that can share a scan run fused; if the fused plan fails, each rule runs by itself and a failing one is reported."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import graph_rules, grouping, page_rules, semantic, validation
from ..operators.catalog import FINDING, RULE_TEXTS, Registry, Rule
from ..sources.crawl import Crawl
from ..sources.tables import written


def default_registry() -> Registry:
    """The 30 deterministic rules."""
    r = Registry()
    graph = {"AI-CANONICAL-002": lambda c: graph_rules.canonical_rules(c.pages), "AI-CANONICAL-003": lambda c: graph_rules.canonical_rules(c.pages), "AI-LINK-001": lambda c: graph_rules.link_rules(c.pages), "AI-LINK-002": lambda c: graph_rules.link_rules(c.pages), "AI-LINK-003": lambda c: graph_rules.orphan_rule(c.pages, c.crawl), "AI-CONTENT-001": lambda c: graph_rules.duplicate_rule(c.pages), "AI-ROBOTS-001": lambda c: graph_rules.robots_rule(c.crawl, c.unfetched)}
    for rule, pipeline, _, title, _ in RULE_TEXTS:
        if rule in graph:
            run = lambda c, rule=rule: graph[rule](c).where(F.col("rule_id") == rule)
        elif pipeline == "freshness":
            run = lambda c, rule=rule: page_rules.evaluate_freshness(page_rules.with_dates(c.pages, c.crawl), {rule})
        else:
            run = lambda c, rule=rule: page_rules.evaluate(c.pages, {rule})
        r.register(Rule(rule, pipeline, title, run))
    return r


def run_rules(c: Crawl, pipeline: str | None = None) -> DataFrame:
    """All findings of the deterministic rules in fused plans."""
    parts = []
    if pipeline in (None, "ai_discoverability", "engagement"):
        parts.append(page_rules.evaluate(c.pages))
    if pipeline in (None, "ai_discoverability"):
        parts.append(graph_rules.evaluate(c))
    if pipeline in (None, "freshness"):
        parts.append(page_rules.evaluate_freshness(page_rules.with_dates(c.pages, c.crawl)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out if pipeline is None else out.where(F.col("pipeline") == pipeline)


@dataclass
class RuleRun:
    """What one rule did when run by itself: its findings, or the error that it failed with."""

    rule_id: str
    findings: DataFrame | None
    count: int
    error_type: str | None
    error_message: str | None
    seconds: float


def rule_runs(c: Crawl, registry: Registry, pipeline: str | None = None) -> list[RuleRun]:
    """Each rule by itself, in order of id; findings are written, so that a rule that runs does so once, and counted while they are."""
    out = []
    for rule in registry.get_all(pipeline):
        began, seen, n = time.monotonic(), Observation(), 0
        try:
            got, error = written(rule.evaluate(c).observe(seen, F.count(F.lit(1)).alias("n"))), (None, None)
            n = seen.get["n"]
        except Exception as e:  # noqa: BLE001  a rule's failure is its diagnostic
            got, error = None, (type(e).__name__, str(e))
        out.append(RuleRun(rule.rule_id, got, n, *error, time.monotonic() - began))
    return out


def observed_diagnostics(c: Crawl, registry: Registry | None = None) -> DataFrame:
    """(rule_id, status, findings_generated, valid_findings, invalid_findings) of the fused rules over all crawls of ``c``.

    The counts are observed while the findings and their checks are written, so no job counts them afterwards.
    """
    rules = [r.rule_id for r in (registry or default_registry()).get_all()]
    made, passed = Observation(), Observation()
    is_ = lambda r: F.col("rule_id") == r
    raw = written(run_rules(c).observe(made, *[F.count_if(is_(r)).alias(r) for r in rules]))
    written(validation.validate_findings(raw, c.pages).observe(passed, *[F.count_if(is_(r) & (F.size("errors") == 0)).alias(r) for r in rules]))
    g, v = made.get, passed.get
    status = lambda r: "INVALID_FINDINGS" if g[r] > v[r] else "SUCCESS" if g[r] else "NO_FINDINGS"
    return c.pages.sparkSession.createDataFrame([(r, status(r), g[r], v[r], g[r] - v[r]) for r in rules], "rule_id string, status string, findings_generated bigint, valid_findings bigint, invalid_findings bigint")


def run_isolated(c: Crawl, registry: Registry, pipeline: str | None = None) -> tuple[list[tuple[str, DataFrame]], dict[str, str]]:
    """(rule, its findings) of those that run, and the errors of those that fail."""
    runs = rule_runs(c, registry, pipeline)
    return [(r.rule_id, r.findings) for r in runs if r.findings is not None], {r.rule_id: f"{r.error_type}: {r.error_message}" for r in runs if r.findings is None}


@dataclass
class Audit:
    findings: DataFrame
    checked: DataFrame
    groups: DataFrame
    summary: DataFrame
    scopes: DataFrame
    rules: DataFrame
    timing: dict[str, float]
    json: DataFrame
    markdown: DataFrame


def audit(c: Crawl, audited_at: str, model: semantic.Model | None = semantic.mock_model, make=E.MockGenerator, several_canonicals: bool = True, registry: Registry | None = None, timed: bool = False) -> Audit:
    """``model`` None: no page is analysed; ``make`` None: no group is enriched. ``registry``: run these rules, one by one, in place of the fused default rules. ``timed``: the JSON report tells the stages' seconds.

    Each stage is written to the shared folder: later stages read it several times, and no plan grows with the stages before it.
    If the fused plan fails, each rule runs by itself; a rule that fails is FAILED in ``rules``, and the others' findings count.
    """
    spark, timing, began = c.pages.sparkSession, {}, time.monotonic()

    def lap(stage: str) -> None:
        timing[stage] = time.monotonic() - began - sum(timing.values())

    runs: list[RuleRun] = []
    if registry is None:
        try:
            raw = written(run_rules(c))
        except Exception:  # noqa: BLE001  which rule it is shows when they run one by one
            logging.getLogger(__name__).exception("the fused plan of the rules failed; each rule runs by itself")
            runs = rule_runs(c, default_registry())
    else:
        runs = rule_runs(c, registry)
    if runs:
        raw = spark.createDataFrame([], FINDING)
        for r in runs:
            raw = raw if r.findings is None else raw.union(r.findings)
        raw = written(raw)
    checked = written(validation.validate_findings(raw, c.pages))
    rules = validation.rule_diagnostics(checked, (registry or default_registry()).table(spark), c.crawl, [(r.rule_id, r.error_type, r.error_message, r.seconds) for r in runs])
    lap("rule_engines")
    kept = checked.where(F.size("errors") == 0).drop("errors").select(*raw.columns)
    pages_read = written(semantic.page_results(c.pages if model else c.pages.where("false"), model or semantic.mock_model).select(*semantic.RESULT))
    kept = written(kept.union(semantic.interpret(pages_read).select(*raw.columns)))
    lap("nlp")
    sources = written(grouping.deduplicate(kept))
    pages = c.pages.groupBy("crawl_id").agg(F.count("*").alias("pages"))
    grouped = written(grouping.group(sources, pages))
    lap("grouping")
    groups = written(validation.validate_groups(grouped, sources, c, several_canonicals))
    lap("evidence_validation")
    tally = groups.groupBy("crawl_id").agg(F.count("*").alias("findings_evaluated"), F.count_if("valid").alias("evidence_valid_findings"), F.count_if(~F.col("valid")).alias("excluded_findings"))
    valid = written(E.enrich(groups.where("valid"), make) if make else E.plain(groups.where("valid")))
    lap("genai")
    s, scopes = grouping.summary(valid, c.crawl), E.scope(c.crawl, c.pages, c.unfetched)
    diagnostics = {"nlp": semantic.state_counts(pages_read), "genai": E.enrich_counts(valid)}
    report = E.json_reports(valid, c.crawl, s, scopes, audited_at, tally, diagnostics, {**timing, "total": sum(timing.values())} if timed else None)
    return Audit(kept, checked, valid, s, scopes, rules, timing, report, E.markdown_reports(valid, c.crawl, s, scopes, tally))
