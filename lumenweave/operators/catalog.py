"""The rules' fixed texts and the registry of rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import finding_id
from ..sources.crawl import Crawl

AI, FRESH, ENGAGE = "ai_discoverability", "freshness", "engagement"
PIPELINES = (AI, FRESH, ENGAGE)

# Rule id, pipeline, severity, title, suggested action. The action's priority equals the severity.
RULE_TEXTS = [
    ("AI-CRAWL-001", AI, "high", "Client Error (4xx)", "Fix broken page or remove links to it."),
    ("AI-CRAWL-002", AI, "high", "Server Error (5xx)", "Fix server error."),
    ("AI-ROBOTS-001", AI, "medium", "Robots.txt Blocking", "Review robots.txt rules."),
    ("AI-ROBOTS-002", AI, "low", "Noindex Directive Present", "Review to ensure directive is intentional. If intended to be discoverable, remove the directive."),
    ("AI-ROBOTS-003", AI, "low", "Nofollow Directive Present", "Ensure nofollow is intentional; if content should be discoverable via links, remove the directive."),
    ("AI-REDIRECT-001", AI, "medium", "Redirect Chain", "Update links to point to the final URL directly."),
    ("AI-CANONICAL-001", AI, "medium", "Missing Canonical", "Add a canonical tag."),
    ("AI-CANONICAL-002", AI, "high", "Canonical Points to Error", "Fix canonical tag to point to a valid 200 OK page."),
    ("AI-CANONICAL-003", AI, "medium", "Canonical Points to Redirect", "Fix canonical tag to point directly to the final destination."),
    ("AI-LINK-001", AI, "high", "Broken Internal Link(s)", "Remove or update broken links."),
    ("AI-LINK-002", AI, "low", "Internal Link(s) to Redirect", "Update internal links to point directly to their final destinations."),
    ("AI-LINK-003", AI, "high", "Orphan Page", "Add internal links pointing to this page to make it discoverable."),
    ("AI-LINK-004", AI, "low", "Excessive Crawl Depth", "Improve site architecture so this page is reachable in fewer clicks."),
    ("AI-HTML-001", AI, "medium", "Missing H1", "Add an H1 tag to describe the page's main topic."),
    ("AI-META-001", AI, "high", "Missing Title", "Add a descriptive <title> tag."),
    ("AI-META-002", AI, "high", "Empty Title", "Provide a non-empty <title> tag."),
    ("AI-META-003", AI, "low", "Missing Meta Description", "Consider adding a meta description."),
    ("AI-SCHEMA-001", AI, "high", "Malformed JSON-LD", "Fix JSON syntax errors in schema markup."),
    ("AI-CONTENT-001", AI, "medium", "Exact Duplicate Content", "Consolidate pages or use canonical tags."),
    ("AI-CONTENT-002", AI, "low", "Thin Content", "Review to ensure page has enough context to be discoverable."),
    ("FR-DATE-001", FRESH, "medium", "Missing Expected Date Signal", "Add datePublished or article:published_time."),
    ("FR-DATE-002", FRESH, "low", "Unparseable Date Value", "Fix date format to use standard ISO 8601."),
    ("FR-DATE-003", FRESH, "high", "Calendar-Impossible Date", "Fix impossible calendar date (e.g. Feb 30)."),
    ("FR-DATE-004", FRESH, "high", "Future Date Value", "Correct date to not be in the future."),
    ("FR-CONS-001", FRESH, "medium", "Contradictory Chronology", "Ensure datePublished is before dateModified."),
    ("FR-CONS-002", FRESH, "medium", "Date Source Contradiction", "Ensure meta and json-ld dates are equivalent."),
    ("FR-STALE-001", FRESH, "medium", "Stale Time-Sensitive Content", "Review or update stale article."),
    ("FR-STALE-002", FRESH, "low", "Stale Product Content", "Review or update stale product page."),
    ("ENG-NAV-001", ENGAGE, "medium", "Dead-End Content Page", "Article/product page has no outbound internal navigation links."),
    ("ENG-MEDIA-001", ENGAGE, "medium", "Missing Image Alt Text", "Images are missing alternative text."),
]
FINDING = (
    "crawl_id string, seq bigint, id string, pipeline string, title string, severity string, rule_id string, trigger_type string, action string, priority string,"
    " page string, source string, field string, observed_value string, expected_value string, excerpt string, context string, details string,"
    " pages_checked bigint, pages_affected bigint, affected_percentage double, sample array<string>, sample_count bigint, truncated boolean,"
    " nlp struct<confidence: double, semantic_evidence: string>"
)


def finding(rule: str, page: Column, observed: Column | None = None, *, key: list[Column] | None = None, source: str | Column | None = None, field: str | Column | None = None, seq: Column | None = None, details: Column | None = None) -> Column:
    """What a rule says of one row. ``key`` identifies the finding beside the rule; by default the page. ``fire`` adds the rule's texts."""
    text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    return F.struct(
        F.lit(rule).alias("rule_id"), (seq if seq is not None else F.col("page_seq")).cast("bigint").alias("seq"), (F.concat(*key) if key else page).alias("key"), page.alias("page"),
        text(source).alias("source"), text(field).alias("field"), text(observed).alias("observed_value"), text(details).alias("details"),
    )


def _text_of(position: int) -> Column:
    return F.create_map(*[F.lit(x) for r in RULE_TEXTS for x in (r[0], r[position])])[F.col("rule_id")]


def fire(rows: DataFrame, *pairs: tuple[Column, Column], carry: tuple[str, ...] = (), more: dict[str, Column] | None = None) -> DataFrame:
    """All findings whose condition holds, from one pass over ``rows``.

    A finding concerns one page of one, but for engagement rules, which do not count, and where ``more`` says otherwise from the columns that ``carry`` names.
    """
    if len(pairs) == 1:
        when, what = pairs[0]
        found = rows.where(when).select("crawl_id", *carry, what.alias("f")).select("crawl_id", *carry, "f.*")
    else:
        found = rows.select("crawl_id", *carry, F.inline(F.filter(F.array(*[F.when(when, what) for when, what in pairs]), lambda x: x.isNotNull())))
    pipeline = _text_of(1)
    counted = F.when(pipeline != ENGAGE, F.lit(1))
    severity = _text_of(2)
    values = {
        "id": finding_id(F.col("rule_id"), F.col("key")), "pipeline": pipeline, "severity": severity, "priority": severity, "title": _text_of(3), "action": _text_of(4),
        "trigger_type": F.lit("deterministic"), "pages_checked": counted, "pages_affected": counted, "affected_percentage": counted * F.lit(100.0),
    }
    values |= {c: F.col(c) for c in ("crawl_id", "seq", "rule_id", "page", "source", "field", "observed_value", "details")} | (more or {})
    from pyspark.sql import types as T

    return found.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(FINDING).fields])


@dataclass(frozen=True)
class Rule:
    """A table function from a crawl to findings. It must not touch the network."""

    rule_id: str
    pipeline: str
    description: str
    evaluate: Callable[[Crawl], DataFrame]


@dataclass
class Registry:
    rules: dict[str, Rule] = field(default_factory=dict)

    def register(self, rule: Rule) -> None:
        if not isinstance(rule, Rule):
            raise TypeError("not a Rule")
        if not rule.rule_id:
            raise ValueError("a rule needs an id")
        if rule.rule_id in self.rules:
            raise ValueError(f"{rule.rule_id} is registered already")
        if rule.pipeline not in PIPELINES:
            raise ValueError(f"{rule.pipeline} is no pipeline")
        self.rules[rule.rule_id] = rule

    def get(self, rule_id: str) -> Rule | None:
        return self.rules.get(rule_id)

    def get_all(self, pipeline: str | None = None) -> list[Rule]:
        return [self.rules[k] for k in sorted(self.rules) if pipeline in (None, self.rules[k].pipeline)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.rule_id, r.pipeline, r.description) for r in self.get_all()], "rule_id string, pipeline string, description string")
