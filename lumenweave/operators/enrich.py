"""Enrichment of valid groups by a pluggable generator, and the reports.

Groups are at most one for each rule and severity of a crawl, so a crawl's requests run in one task under one time budget.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_escape
from ..sources.crawl import STATS

BUDGET_SECONDS, RETRIES, LONGEST = 10.0, 3, 1000
OUTCOMES = ("successful", "rate_limited", "timeouts", "provider_failures", "invalid_responses", "skipped_by_budget")


class RateLimited(Exception):
    def __init__(self, retry_after: float = 0.0):
        super().__init__("rate limited")
        self.retry_after = retry_after


class ProviderFailure(Exception):
    pass


Generator = Callable[[str], dict]


class MockGenerator:
    """A deterministic stand-in, steered by marks in the prompt. Its marks and texts are fixed values, which tests look for."""

    def __init__(self):
        self.limited = 0

    def __call__(self, prompt: str):
        if "mock_429_recover" in prompt:
            self.limited += 1
            if self.limited == 1:
                raise RateLimited()
            return {"explanation": "Recovered from 429!", "why_it_matters": "It matters because 429 recovery works.", "possible_solution": "Retry with backoff."}
        if "mock_429_exhaust" in prompt:
            raise RateLimited()
        if "mock_timeout" in prompt:
            raise TimeoutError
        if "mock_500" in prompt:
            raise ProviderFailure("Internal Server Error")
        if "mock_invalid_type" in prompt:
            return "This is a string, not a dict"
        if "mock_missing_field" in prompt:
            return {"explanation": "Missing other fields"}
        if "mock_empty_string" in prompt:
            return {"explanation": "", "why_it_matters": "test", "possible_solution": "test"}
        if "mock_oversize" in prompt:
            return {"explanation": "A" * 5000, "why_it_matters": "test", "possible_solution": "test"}
        return {
            "explanation": "This is a generalized explanation of the group issue. It helps search engines parse the site.",
            "why_it_matters": "It matters because search engines need clear guidance.",
            "possible_solution": "Implement the suggested best practices.",
        }


def prompt() -> Column:
    return F.concat(F.lit("Explain the impact of '"), F.col("title"), F.lit("' (Severity: "), F.col("severity"), F.lit("). Observed: "), F.col("observed_value"), F.lit("."))


def ask(generate: Generator, text: str, retries: int = RETRIES, pause: float = 1.0) -> tuple[str, dict | None]:
    """Outcome and, if successful, the three texts."""
    for attempt in range(retries + 1):
        last = attempt == retries
        try:
            got = generate(text)
            break
        except TimeoutError:
            if last:
                return "timeouts", None
        except RateLimited as e:
            if last:
                return "rate_limited", None
            time.sleep(max(e.retry_after, pause * 2**attempt))
        except Exception as e:  # noqa: BLE001  any other failure is the provider's
            if last or not isinstance(e, ProviderFailure):
                return "provider_failures", None
            time.sleep(pause * 2**attempt)
    keys = ("explanation", "why_it_matters", "possible_solution")
    if not isinstance(got, dict) or not all(isinstance(got.get(k, ""), str) for k in keys):
        return "invalid_responses", None
    texts = {k: got.get(k, "").strip() for k in keys}
    if not all(0 < len(v) <= LONGEST for v in texts.values()):
        return "invalid_responses", None
    return "successful", texts


def enrich(groups: DataFrame, make: Callable[[], Generator] = MockGenerator, budget: float = BUDGET_SECONDS, pause: float = 1.0) -> DataFrame:
    """Groups with ``outcome`` (NULL if not eligible, that is, without an observed value), explanation, why_it_matters and possible_solution."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        began, generate, out = time.monotonic(), make(), []
        for r in pdf.sort_values("group_id").itertuples():
            outcome, texts = ("skipped_by_budget", None) if time.monotonic() - began >= budget else ask(generate, r.prompt, pause=pause)
            out.append({"crawl_id": r.crawl_id, "group_id": r.group_id, "outcome": outcome, **dict.fromkeys(("explanation", "why_it_matters", "possible_solution")), **(texts or {})})
        return pd.DataFrame(out, columns=["crawl_id", "group_id", "outcome", "explanation", "why_it_matters", "possible_solution"])

    asked = groups.where("observed_value is not null").select("crawl_id", "group_id", prompt().alias("prompt"))
    got = asked.groupBy("crawl_id").applyInPandas(run, "crawl_id string, group_id string, outcome string, explanation string, why_it_matters string, possible_solution string")
    return groups.join(got, ["crawl_id", "group_id"], "left")


def plain(groups: DataFrame) -> DataFrame:
    """Groups as ``enrich`` returns them, none of which was asked about."""
    return groups.withColumns({c: F.lit(None).cast("string") for c in ("outcome", "explanation", "why_it_matters", "possible_solution")})


def enrich_counts(enriched: DataFrame) -> DataFrame:
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return enriched.groupBy("crawl_id").agg(F.count("outcome").alias("eligible_groups"), F.count_if(F.col("outcome").isNotNull() & (F.col("outcome") != "skipped_by_budget")).alias("requests_attempted"), *n)


# --- reports -----------------------------------------------------------------------------------------------


def scope(crawl: DataFrame, pages: DataFrame, unfetched: DataFrame) -> DataFrame:
    """(crawl_id, status, reason, pages_evaluated, max_pages, max_depth, robots_respected, termination_reason)."""
    n = pages.groupBy("crawl_id").agg(F.count("*").alias("n"))
    u = unfetched.groupBy("crawl_id").agg(F.count("*").alias("u"))
    j = crawl.join(n, "crawl_id", "left").join(u, "crawl_id", "left")
    left = F.coalesce("u", F.lit(0)) > 0
    capped = F.coalesce(F.col("finish_reason") == "closespider_pagecount", F.lit(False))
    reason = F.when(left & capped, F.lit("Configured page limit reached")).when(left, F.lit("Did not evaluate all discovered URLs")).otherwise(F.lit("Evaluated all discovered URLs"))
    d = "crawl_diagnostics."
    return j.select("crawl_id", F.when(left, F.lit("Partial")).otherwise(F.lit("Complete")).alias("status"), reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("pages_evaluated"), F.col(d + "configured_page_limit").alias("max_pages"), F.col(d + "configured_depth_limit").alias("max_depth"), F.lit(True).alias("robots_respected"), F.col(d + "crawl_termination_reason").alias("termination_reason"))


def finding_struct() -> Column:
    """A group as the finding object of the JSON report; to_json leaves nulls out."""
    used = F.col("explanation").isNotNull()
    genai = F.when(F.col("outcome").isNotNull(), F.struct(used.alias("used"), "explanation", "why_it_matters", "possible_solution"))
    evidence = F.struct("pages_checked", "pages_affected", "affected_percentage", F.struct(F.col("pages_affected").alias("count"), "sample", "truncated").alias("affected_pages"), "page", "source", "field", "observed_value", "expected_value", "excerpt", "context", F.try_parse_json(F.coalesce("details", F.lit("{}"))).alias("details"))
    nlp = F.when(F.col("nlp").isNotNull(), F.struct(F.lit(True).alias("used"), F.col("nlp.confidence").alias("confidence"), F.try_parse_json("nlp.semantic_evidence").alias("semantic_evidence")))
    return F.struct(F.col("group_id").alias("id"), "pipeline", "title", "severity", F.struct("rule_id", F.col("trigger_type").alias("type")).alias("trigger"), evidence.alias("evidence"), F.struct(F.col("action").alias("summary"), "priority").alias("suggested_action"), nlp.alias("nlp"), genai.alias("genai"))


def json_reports(groups: DataFrame, crawl: DataFrame, summary: DataFrame, scopes: DataFrame, audited_at: str, checked: DataFrame, diagnostics: dict[str, DataFrame] | None = None, timing: dict[str, float] | None = None) -> DataFrame:
    """(crawl_id, report): one JSON text a crawl. ``checked`` is (crawl_id, findings_evaluated, evidence_valid_findings, excluded_findings).

    ``diagnostics``: by name a row of counts a crawl; ``timing``: seconds by stage. Both are parts of the report's diagnostics.
    """
    from .grouping import severity_rank

    key = F.struct("pipeline", severity_rank(F.col("severity")).alias("r"), "title", "group_id")
    f = groups.withColumn("json", F.to_json(finding_struct())).groupBy("crawl_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), "json"))).alias("fs"))
    j = crawl.join(summary, "crawl_id").join(scopes, "crawl_id").join(f, "crawl_id", "left").join(checked, "crawl_id", "left")
    stats = F.struct(*[F.col(f"crawl_stats.{s}").alias(s) for s in STATS], F.col("crawl_stats.crawl_duration").alias("crawl_duration_seconds"))
    head = F.to_json(F.struct(F.col("seed_url").alias("site"), F.lit(audited_at).alias("audited_at"), F.struct(F.col("score").alias("overall_score"), "total_findings", F.struct("high", "medium", "low", "info").alias("severity")).alias("summary"), stats.alias("crawl"), F.struct("status", "reason", "pages_evaluated", "max_pages", "max_depth", "robots_respected", "termination_reason").alias("evaluation_scope")))
    listed = F.concat(F.lit(',"findings":['), F.array_join(F.transform(F.coalesce("fs", F.array().cast(f.schema["fs"].dataType)), lambda x: x["json"]), ","), F.lit("]"))
    parts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("findings_evaluated", "evidence_valid_findings", "excluded_findings")]
    for name, counts in (diagnostics or {}).items():
        j = j.join(counts.select("crawl_id", F.struct(*[c for c in counts.columns if c != "crawl_id"]).alias(f"_{name}")), "crawl_id", "left")
        parts.append(F.col(f"_{name}").alias(name))
    if timing is not None:
        parts.append(F.struct(*[F.lit(timing.get(k, 0.0)).alias(k) for k in STAGES]).alias("stage_timing"))
    diag = F.to_json(F.struct(*parts))
    return j.select("crawl_id", F.concat(F.regexp_replace(head, r"\}$", ""), listed, F.lit(',"diagnostics":'), diag, F.lit("}")).alias("report"))


#: the report's stages, in order
STAGES = ("crawling", "rule_engines", "grouping", "evidence_validation", "nlp", "genai", "reporting", "total")
_NAMES = {"ai_discoverability": "AI Discoverability", "freshness": "Freshness", "engagement": "On-site Engagement"}


def markdown_finding() -> Column:
    """The Markdown section of one group."""
    e = markdown_escape
    line = lambda label, c, when=None: F.when(c.isNotNull() if when is None else when, F.concat(F.lit(label), c))
    lines = [
        F.concat(F.lit("### "), e(F.col("title"))),
        F.concat(F.lit("**Severity:** "), F.initcap("severity")),
        F.concat(F.lit("**Affected:** "), F.col("pages_affected").cast("string"), F.lit(" of "), F.col("pages_checked").cast("string"), F.lit(" evaluated pages")),
        F.lit(""),
        F.concat(F.lit("**Problem:** "), e(F.col("action"))),
        F.concat(F.lit("**Suggested action:** "), e(F.col("action"))),
        F.lit(""),
        F.lit("**Evidence:**"),
        F.when(F.coalesce("page", F.lit("")) != "", F.concat(F.lit("- **Page:** `"), e(F.col("page")), F.lit("`"))),
        line("- **Checked:** ", e(F.coalesce("field", "source")), F.coalesce("field", "source").isNotNull()),
        line("- **Observed value:** ", e(F.col("observed_value")), F.col("observed_value").isNotNull()),
        line("- **Expected value:** ", e(F.col("expected_value")), F.col("expected_value").isNotNull()),
        line("- **Excerpt:**\n  > ", e(F.col("excerpt")), F.coalesce("excerpt", F.lit("")) != ""),
        line("- **Context:** ", e(F.col("context")), F.coalesce("context", F.lit("")) != ""),
    ]
    said = lambda k: e(F.get_json_object("nlp.semantic_evidence", f"$.{k}"))
    has = F.col("nlp.semantic_evidence").isNotNull()
    lines += [F.when(has, F.lit("**Semantic Observation:**")), *[line(f"- **{label}:** ", said(k), has) for label, k in (("Apparent topic", "apparent_topic"), ("Content topic", "content_topic"), ("Alignment", "alignment"))], F.lit("")]
    gen = F.col("explanation").isNotNull()
    lines += [F.when(gen, F.lit(x)) for x in ("### GenAI Context", "")]
    lines += [line(f"**{label}:** ", e(F.col(k)), gen) for label, k in (("Explanation", "explanation"), ("Why it matters", "why_it_matters"), ("Possible solution", "possible_solution"))]
    lines += [F.when(gen, F.lit("")), F.lit("**Affected pages:**"), F.concat(F.col("pages_affected").cast("string"), F.lit(" pages affected. "), F.when(F.col("truncated"), F.lit("Sample shown:")).otherwise(F.lit("List:")))]
    sample = F.transform("sample", lambda s: F.concat(F.lit("- `"), e(s), F.lit("`")))
    fixed = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return F.array_join(F.concat(fixed, sample, F.array(F.lit(""))), "\n")


def markdown_reports(groups: DataFrame, crawl: DataFrame, summary: DataFrame, scopes: DataFrame, checked: DataFrame) -> DataFrame:
    """(crawl_id, report)."""
    from .grouping import severity_rank

    g = groups.select("crawl_id", "pipeline", F.struct(severity_rank(F.col("severity")).alias("r"), "title", "group_id").alias("k"), markdown_finding().alias("md"))
    f = g.groupBy("crawl_id").pivot("pipeline", list(_NAMES)).agg(F.array_sort(F.collect_list(F.struct("k", "md"))))
    j = crawl.join(summary, "crawl_id").join(scopes, "crawl_id").join(f, "crawl_id", "left").join(checked, "crawl_id", "left")
    part = lambda p, name: F.when(F.size(p) > 0, F.concat(F.lit(f"## {name}\n\n"), F.array_join(F.transform(p, lambda x: x["md"]), "\n")))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    head = F.concat(F.lit("# AI Readiness Audit Report: "), markdown_escape(F.col("seed_url")), F.lit("\n**Score:** "), F.col("score").cast("string"), F.lit("/100\n**Pages evaluated:** "), F.col("pages_evaluated").cast("string"), F.lit("\n**Crawl status:** "), markdown_escape(F.col("status")), F.lit("\n"))
    foot = F.concat(F.lit("## Audit Validation Summary\n- Findings evaluated: "), n("findings_evaluated"), F.lit("\n- Evidence-valid findings: "), n("evidence_valid_findings"), F.lit("\n- Findings excluded during evidence validation: "), n("excluded_findings"), F.lit("\n"))
    return j.select("crawl_id", F.concat_ws("\n", head, *[part(p, name) for p, name in _NAMES.items()], foot).alias("report"))


def terminal_text(site: str, s: dict, scope: dict, timing: dict | None = None, genai: dict | None = None) -> str:
    """The console summary of one crawl from its summary and scope rows."""
    out = ["Audit Complete", "", f"Site: {site}", f"Score: {s['score']}/100", f"Pages evaluated: {scope['pages_evaluated']}", f"Crawl status: {scope['status']}", ""]
    out += [f"Findings: {s['total_findings']}", *[f"{k.title()}: {s[k]}" for k in ("high", "medium", "low", "info")], ""]
    rule = "-" * 32
    if timing:
        names = {"crawling": "Crawling", "rule_engines": "Rule engines", "grouping": "Grouping", "evidence_validation": "Evidence validation", "nlp": "NLP", "genai": "GenAI", "reporting": "Reporting"}
        out += ["Stage Timing", rule, *[f"{v:<25}{timing.get(k, 0.0):.2f}s" for k, v in names.items()], rule, f"{'Total':<25}{timing.get('total', 0.0):.2f}s", ""]
    if genai:
        names = {"eligible_groups": "Eligible groups:", "requests_attempted": "Requests attempted:", "successful": "Successful:", "rate_limited": "Rate limited (429):", "timeouts": "Timeouts:", "provider_failures": "Provider failures:", "invalid_responses": "Invalid responses:", "skipped_by_budget": "Skipped by budget:"}
        out += ["GenAI Diagnostics", rule, *[f"{v:<26}{genai.get(k, 0)}" for k, v in names.items()], f"{'Total GenAI time:':<26}{genai.get('total_duration_seconds', 0.0):.2f}s", ""]
    return "\n".join([*out, "Reports saved to: report.json, report.md"])
