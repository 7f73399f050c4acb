"""Semantic topic check: native gates, a bounded number of model calls, and a state machine over the answers."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import finding_id
from ..functions.text import is_blank, words
from ..functions.urls import path_of
from .catalog import AI, FINDING
from .grouping import smallest

LIMIT, MAX_WORDS, CONFIDENCE, BUDGET_SECONDS, RETRIES = 100, 1500, 0.85, 180.0, 2
# Paths that are not looked at
EXCLUDED = ("/login", "/cart", "/checkout", "/account", "/privacy", "/terms")
RULE = "SEMANTIC_TOPIC_RELEVANCE"
RESPONSE = "failed boolean, malformed boolean, timed_out boolean, apparent_topic string, content_topic string, alignment string, reason string, confidence double, sources array<struct<source_type: string, field: string, text: string>>"

Model = Callable[[str, str], dict | None]


def page_address() -> Column:
    return F.coalesce(F.nullif("final_url", F.lit("")), "url")


def gate() -> Column:
    """not_eligible, skipped_by_gate, unsupported_language or NULL for a page that may be analysed."""
    text, lang = F.col("extracted.visible_text"), F.col("extracted.language")
    path = F.lower(path_of(page_address()))
    off = F.lit(False)
    for x in EXCLUDED:
        off = off | path.contains(x)
    html = F.coalesce(F.lower("content_type").contains("html"), F.lit(False))
    return (
        F.when((F.col("status_code") != 200) | ~html, F.lit("not_eligible"))
        .when(off, F.lit("skipped_by_gate"))
        .when(F.coalesce(lang, F.lit("")) == "", F.lit("unsupported_language"))
        .when(F.substring_index(F.lower(lang), "-", 1) != "en", F.lit("unsupported_language"))
        .when(F.coalesce(text, F.lit("")) == "", F.lit("skipped_by_gate"))
        .when(F.size(words(text)) < 50, F.lit("skipped_by_gate"))
        .when(is_blank(F.col("extracted.title")), F.lit("skipped_by_gate"))
    )


def truncated(text: Column, limit: int = MAX_WORDS) -> Column:
    w = words(text)
    return F.when(F.size(w) > limit, F.array_join(F.slice(w, 1, limit), " ")).otherwise(text)


def candidates(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every page with ``state`` (NULL: to be analysed): beyond the gates, the first ``limit`` addresses of a crawl in order are analysed, the others skipped_by_budget."""
    p = pages.withColumn("state", gate()).withColumn("address", page_address())
    free = p.where("state is null")
    last = smallest(free.select("crawl_id", F.struct("address", "page_seq").alias("x")), ["crawl_id"], "x", limit).select("crawl_id", F.element_at("sample", -1).alias("last"))
    p = p.join(last, "crawl_id", "left")
    return p.withColumn("state", F.when(F.col("state").isNull() & (F.struct("address", "page_seq") > F.col("last")), F.lit("skipped_by_budget")).otherwise(F.col("state"))).drop("last")


def mock_model(title: str, text: str) -> dict | None:
    """A deterministic stand-in for a model, steered by marks in the text."""
    if "mock_fail" in text:
        raise ValueError("simulated network failure")
    if "mock_invalid_json" in text:
        return {"malformed": "json"}
    low = "mock_low_alignment" in text
    sources = [{"source_type": "page_title", "field": "title", "text": title}, {"source_type": "visible_text", "field": "visible_text", "text": "mock_low_alignment content"}]
    return {
        "observation": {"apparent_topic": title, "content_topic": "Unrelated Topic" if low else title, "alignment": "low" if low else "high", "reason": "Title indicates weather, but content is about dogs." if low else "Alignment is high"},
        "confidence": 0.95 if low else 0.9,
        "supporting_evidence": {"sources": sources if low else []},
    }


def analyse(todo: DataFrame, model: Model = mock_model, budget: float = BUDGET_SECONDS, retries: int = RETRIES) -> DataFrame:
    """(crawl_id, page_seq, RESPONSE): at most LIMIT rows a crawl, in one task a crawl so that the time budget holds for all of them; beyond it all fail."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        began, out = time.monotonic(), []
        for r in pdf.itertuples():
            got, x = None, dict.fromkeys((f.split(" ")[0] for f in ("failed", "malformed", "timed_out", "apparent_topic", "content_topic", "alignment", "reason", "confidence", "sources")))
            for attempt in range(retries + 1):
                if time.monotonic() - began >= budget:
                    break
                try:
                    got = model(r.title, r.text)
                    break
                except Exception:  # noqa: BLE001  the model's failures are answers
                    if attempt == retries:
                        break
            obs = (got or {}).get("observation", {})
            x |= {"crawl_id": r.crawl_id, "page_seq": r.page_seq, "failed": not got, "malformed": "malformed" in (got or {}), "timed_out": False, **{k: obs.get(k, "") for k in ("apparent_topic", "content_topic", "alignment", "reason")}}
            x |= {"confidence": float((got or {}).get("confidence", 0.0)), "sources": [{k: s.get(k, "") for k in ("source_type", "field", "text")} for s in (got or {}).get("supporting_evidence", {}).get("sources", [])]}
            out.append(x)
        if time.monotonic() - began >= budget:
            for x in out:
                x["timed_out"] = True
        return pd.DataFrame(out, columns=["crawl_id", "page_seq", *(f.strip().split(" ")[0] for f in ("failed", "malformed", "timed_out", "apparent_topic", "content_topic", "alignment", "reason", "confidence", "sources"))])

    rows = todo.select("crawl_id", "page_seq", F.col("extracted.title").alias("title"), truncated(F.col("extracted.visible_text")).alias("text"))
    return rows.groupBy("crawl_id").applyInPandas(run, f"crawl_id string, page_seq bigint, {RESPONSE}")


def judged(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages with a first ``state`` (NULL: was to be analysed) and a model's answers (crawl_id, page_seq, RESPONSE): each page with its final state and the answer, if any."""
    r = pages.join(answers, ["crawl_id", "page_seq"], "left")
    align = F.lower("alignment")
    wrong = F.exists("sources", lambda s: F.when(s["field"] == "title", ~F.col("extracted.title").contains(s["text"])).when(s["field"] == "visible_text", ~F.col("extracted.visible_text").contains(s["text"])).otherwise(True))
    state = (
        F.when(F.col("state").isNotNull(), F.col("state"))
        .when(F.col("timed_out") | F.coalesce("failed", F.lit(True)), F.lit("analysis_failed"))
        .when(F.col("malformed") | ~align.isin("high", "medium", "low"), F.lit("invalid_model_output"))
        .when((F.col("confidence") < CONFIDENCE) | (align != "low"), F.lit("analysis_no_observation"))
        .when(F.coalesce(wrong, F.lit(False)), F.lit("evidence_invalid"))
        .otherwise(F.lit("analysis_success"))
    )
    return r.withColumn("state", state)


def page_results(pages: DataFrame, model: Model = mock_model, budget: float = BUDGET_SECONDS) -> DataFrame:
    """Every page with its final ``state`` and the model's answer, if any."""
    c = candidates(pages)
    return judged(c, analyse(c.where("state is null"), model, budget))


#: all states that a page can end in
STATES = ("not_eligible", "skipped_by_gate", "unsupported_language", "skipped_by_budget", "analysis_failed", "invalid_model_output", "analysis_no_observation", "evidence_invalid", "analysis_success")


def state_counts(results: DataFrame) -> DataFrame:
    """(crawl_id, pages, one count a state)."""
    return results.groupBy("crawl_id").agg(F.count("*").alias("pages"), *[F.count_if(F.col("state") == x).alias(x) for x in STATES])


def interpret(results: DataFrame) -> DataFrame:
    """Findings of pages whose content a model found to miss their title's topic."""
    page = F.col("address")
    said = F.to_json(F.struct("apparent_topic", "content_topic", F.lower("alignment").alias("alignment"), "reason"))
    excerpt = F.try_element_at(F.filter("sources", lambda s: s["field"] == "visible_text"), F.lit(1))["text"]
    values = {
        "crawl_id": F.col("crawl_id"), "seq": F.col("page_seq"), "id": finding_id(F.lit(RULE), page), "pipeline": F.lit(AI), "title": F.lit("Pages do not clearly address their apparent topics"), "severity": F.lit("medium"),
        "rule_id": F.lit(RULE), "trigger_type": F.lit("semantic"), "action": F.lit("Align the page content with the topic indicated by the title."), "priority": F.lit("medium"), "page": page, "source": F.lit("semantic_analysis"), "field": F.lit("visible_text"),
        "observed_value": F.concat(F.lit("Apparent topic: "), F.col("apparent_topic"), F.lit(" vs Content topic: "), F.col("content_topic")), "expected_value": F.lit("High alignment between title and content topics"), "excerpt": excerpt, "details": said,
        "nlp": F.struct(F.col("confidence"), said.alias("semantic_evidence")),
    }
    from pyspark.sql import types as T

    return results.where("state = 'analysis_success'").select(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(FINDING).fields])


#: what interpretation and diagnostics need of a page's result
RESULT = ("crawl_id", "page_seq", "address", "state", "apparent_topic", "content_topic", "alignment", "reason", "confidence", "sources")
