"""Checks of findings and groups against the crawl. Errors are an array of texts, built from conditions in one pass after the look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import percentage
from ..functions.urls import has_scheme_and_host
from ..sources.crawl import EXTRACTED, Crawl
from ..sources.tables import unused

# Texts that are looked for by those who read errors
NO_ID, MISMATCH, NOT_CRAWLED = "Finding must have an ID.", "Value mismatch", "not found in crawled dataset"


def errors(*checks: tuple[Column, Column | str]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks]), lambda e: e.isNotNull())


def known_pages(pages: DataFrame) -> DataFrame:
    """(crawl_id, url): addresses and final addresses, one key table in place of an OR join."""
    return pages.select("crawl_id", F.explode(F.array_distinct(F.array("url", "final_url"))).alias("url")).where("url is not null").distinct()


def page_lookup(pages: DataFrame) -> DataFrame:
    """(crawl_id, url, p): page of each address; final addresses override addresses, later pages override earlier ones."""
    p = F.struct(F.col("extracted.canonical").alias("canonical"), F.col("extracted.h1s").alias("h1s"), F.col("extracted.title").alias("title"), F.col("extracted.visible_text").alias("visible_text"))
    keys = F.array(F.struct(F.lit(0).alias("k"), F.col("url").alias("u")), F.struct(F.lit(1).alias("k"), F.nullif("final_url", F.lit("")).alias("u")))
    each = pages.select("crawl_id", "page_seq", p.alias("p"), F.explode(keys).alias("x")).where("x.u is not null")
    return each.groupBy("crawl_id", F.col("x.u").alias("url")).agg(F.max_by("p", F.struct("x.k", "page_seq")).alias("p"))


def structural(sample_known: Column, page_known: Column, sample_count: Column) -> list[tuple[Column, Column | str]]:
    """Structure, provenance and arithmetic of a finding with columns as in the catalog's FINDING."""
    page, empty = F.col("page"), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    has_page = F.coalesce(page, F.lit("")) != ""
    checked, affected, pct = F.col("pages_checked"), F.col("pages_affected"), F.col("affected_percentage")
    expected = percentage(affected, checked)
    bad = F.filter("sample", lambda u: ~has_scheme_and_host(u))
    return [
        (empty("id"), NO_ID),
        (empty("title"), "The title is missing."),
        (empty("pipeline"), "The pipeline is missing."),
        (empty("severity"), "The severity is missing."),
        (empty("rule_id"), "No rule is named as the trigger."),
        (empty("action"), "No action is suggested."),
        (has_page & ~has_scheme_and_host(page), F.concat(F.lit("The page is no address: "), page)),
        (has_page & has_scheme_and_host(page) & ~page_known, F.concat(F.lit("The crawl has no page "), page)),
        (F.size(bad) > 0, F.concat(F.lit("The sample holds what is no address: "), F.array_join(bad, ", "))),
        (~sample_known, "The crawl lacks a page of the sample."),
        (affected > checked, "More pages are affected than were checked."),
        (F.abs(pct - expected) > 0.001, F.concat(F.lit("The percentage is "), pct.cast("string"), F.lit(", but its pages give "), expected.cast("string"))),
        (sample_count != affected, "The sample's count is not the number of affected pages."),
        (sample_count.isNotNull() & F.col("truncated") & (F.size("sample") >= sample_count), "The sample is called truncated though it is whole."),
        (sample_count.isNotNull() & ~F.col("truncated") & (F.size("sample") < sample_count), "The sample is not called truncated though pages are left out."),
    ]


def _provenance(rows: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with page_known and sample_known, by equi-joins with the key table; ``key`` names a row."""
    known = known_pages(pages).withColumn("__ok", F.lit(True))
    out = rows.join(known.withColumnRenamed("url", "page"), ["crawl_id", "page"], "left").withColumn("page_known", F.col("__ok").isNotNull()).drop("__ok")
    each = rows.where(F.size("sample") > 0).select(*key, F.explode("sample").alias("url")).join(known, ["crawl_id", "url"], "left")
    lost = each.groupBy(*key).agg(F.bool_and(F.col("__ok").isNotNull()).alias("sample_known"))
    return out.join(lost, key, "left").withColumn("sample_known", F.coalesce("sample_known", F.lit(True)))


def validate_findings(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings with ``errors``."""
    f = _provenance(findings, pages, ["crawl_id", "id", "rule_id"])
    return f.withColumn("errors", errors(*structural(F.col("sample_known"), F.col("page_known"), F.col("sample_count")))).drop("page_known", "sample_known")


def page_fields() -> Column:
    """A page's extracted fields by name, as the text in which a source's quotation is looked for; NULL text for a field without value."""

    def text(f: T.StructField) -> Column:
        c = F.col(f"extracted.{f.name}")
        if isinstance(f.dataType, T.StringType):
            return c
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
        return F.to_json(c)

    fields = T._parse_datatype_string(EXTRACTED).fields
    return F.map_from_arrays(F.array(*[F.lit(f.name) for f in fields]), F.array(*[F.struct(text(f).alias("text")) for f in fields]))


def semantic_sources(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings with ``semantic_errors``: of semantic ones whose page was crawled, what is wrong with the confidence and the sources that their ``details`` name.

    details is JSON; a confidence must be a number from 0 to 1, and a source with a field and a text must name a field of a page, which
    has a value there and holds the text. Details that are no JSON say nothing. Fields are looked up by a name that is data, in a map that is made of
    the named pages only.
    """
    sources, fields, errors_ = (unused(findings, n) for n in ("sources_named", "page_fields", "semantic_errors"))
    v = F.try_parse_json("details")
    semantic = F.col("trigger_type") == "semantic"
    f = findings.withColumn(sources, F.when(semantic, F.coalesce(F.try_variant_get(v, "$.sources", "array<struct<field: string, text: string>>"), F.array().cast("array<struct<field: string, text: string>>"))))
    asked = f.where(semantic).select("crawl_id", F.col("page").alias("url")).where("url is not null").distinct()
    keys = F.array(F.struct(F.lit(0).alias("k"), F.col("url").alias("u")), F.struct(F.lit(1).alias("k"), F.nullif("final_url", F.lit("")).alias("u")))
    each = pages.select("crawl_id", "page_seq", "extracted", F.explode(keys).alias("x")).select("crawl_id", "page_seq", "extracted", "x.k", F.col("x.u").alias("url")).join(asked, ["crawl_id", "url"], "left_semi")
    known = each.groupBy("crawl_id", F.col("url").alias("page")).agg(F.max_by("extracted", F.struct("k", "page_seq")).alias("extracted")).select("crawl_id", "page", page_fields().alias(fields))

    def wrong(s: Column) -> Column:
        there = F.try_element_at(F.col(fields), s["field"])
        empty = (F.coalesce(s["field"], F.lit("")) == "") | (F.coalesce(s["text"], F.lit("")) == "")
        return (
            F.when(empty, F.lit(None).cast("string"))
            .when(there.isNull(), F.concat(F.lit('A semantic source names the field "'), s["field"], F.lit('", which no page has.')))
            .when(there["text"].isNull(), F.concat(F.lit('A semantic source names the field "'), s["field"], F.lit('", which the page has no value for.')))
            .when(~F.contains(there["text"], s["text"]), F.concat(F.lit('A semantic source quotes text that the page\'s field "'), s["field"], F.lit('" does not hold.')))
        )

    given = F.try_variant_get(v, "$.confidence", "variant")
    number = F.schema_of_variant(given).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT|BOOLEAN)$") & F.coalesce(F.try_variant_get(v, "$.confidence", "double").between(0.0, 1.0), F.lit(False))
    worth = errors((given.isNotNull() & ~number, "Semantic confidence is no number from 0 to 1."))
    told = F.concat(worth, F.filter(F.transform(sources, wrong), lambda e: e.isNotNull()))
    out = f.join(known, ["crawl_id", "page"], "left").withColumn(errors_, F.when(semantic & F.col(fields).isNotNull(), told).otherwise(F.array().cast("array<string>")))
    return out.select(*findings.columns, F.col(errors_).alias("semantic_errors"))


def validate_sources(findings: DataFrame, c: Crawl, several_canonicals: bool = True) -> DataFrame:
    """Findings with ``source_errors``: page fetched and in the crawl, and values that agree with the page.

    With ``several_canonicals`` AI-CANONICAL-002 is taken to claim several canonical tags, which one page field can never show, so none of its findings
    passes; without, the rule's own meaning (a canonical that leads to an error) is accepted.
    """
    blocked = c.unfetched.select("crawl_id", F.col("url").alias("page")).distinct().withColumn("__blocked", F.lit(True))
    look = page_lookup(c.pages).withColumnRenamed("url", "page")
    f = semantic_sources(findings, c.pages) if "details" in findings.columns else findings.withColumn("semantic_errors", F.array().cast("array<string>"))
    f = f.join(blocked, ["crawl_id", "page"], "left").join(look, ["crawl_id", "page"], "left")
    page, p, rule = F.col("page"), F.col("p"), F.col("rule_id")
    has_page = F.coalesce(page, F.lit("")) != ""
    there = has_page & p.isNotNull()
    det, sem = there & (F.col("trigger_type") == "deterministic"), there & (F.col("trigger_type") == "semantic")
    confidence = F.col("nlp.confidence")
    checks = [
        (~has_page, "No page is named."),
        (has_page & F.col("__blocked").isNotNull(), F.concat(F.lit("The page was never fetched: "), page)),
        (has_page & p.isNull(), F.concat(page, F.lit(f" {NOT_CRAWLED}"))),
        (det & (rule == "AI-CANONICAL-001") & (F.coalesce("p.canonical", F.lit("")) != ""), F.concat(F.lit(f"{MISMATCH}: the page has a canonical address, "), F.col("p.canonical"))),
        (det & (rule == "AI-CANONICAL-002") & F.lit(several_canonicals), F.concat(F.lit(f"{MISMATCH}: one page field can't show several canonical addresses, it is "), F.coalesce("p.canonical", F.lit("None")))),
        (det & (rule == "AI-HTML-001") & (F.size("p.h1s") > 0), f"{MISMATCH}: the page has a first heading"),
        (sem & (F.coalesce("excerpt", F.lit("")) != "") & (F.coalesce("p.visible_text", F.lit("")) != "") & ~F.col("p.visible_text").contains(F.col("excerpt")), "The excerpt is no part of the page's text."),
        (sem & confidence.isNotNull() & ~confidence.between(0.0, 1.0), "The confidence is not between 0 and 1."),
    ]
    return f.withColumn("source_errors", F.concat(errors(*checks), "semantic_errors")).drop("__blocked", "p", "semantic_errors")


def validate_groups(groups: DataFrame, sources: DataFrame, c: Crawl, several_canonicals: bool = True) -> DataFrame:
    """Groups with ``errors`` and ``valid``: the canonical finding's own checks, its denominator, and every source's. One bad source makes a group invalid."""
    keys = ["crawl_id", "pipeline", "rule_id", "trigger_type", "severity"]
    s = validate_sources(sources, c, several_canonicals)
    bad = s.where(F.size("source_errors") > 0).select(*keys, F.concat(F.lit("Finding "), F.col("id"), F.lit(": "), F.array_join("source_errors", "; ")).alias("e"))
    bad = bad.groupBy(*keys).agg(F.count("*").alias("bad_sources"), F.min("e").alias("first_bad"))
    scope = c.pages.groupBy("crawl_id").agg(F.count("*").alias("__scope"))
    g = _provenance(groups.withColumn("id", F.col("group_id")), c.pages, ["crawl_id", "group_id"]).join(bad, keys, "left").join(scope, "crawl_id", "left")
    own = errors(
        *structural(F.col("sample_known"), F.col("page_known"), F.col("pages_affected")),
        (F.col("pages_checked") != F.coalesce("__scope", F.lit(0)), "The pages checked are not those that the crawl has."),
        (F.size("sample") != F.size(F.array_distinct("sample")), "The sample repeats an address."),
        (F.col("n_sources") == 0, "The group has no findings."),
        (F.col("bad_sources") > 0, F.col("first_bad")),
    )
    return g.withColumn("errors", own).withColumn("valid", F.size("errors") == 0).withColumn("bad_sources", F.coalesce("bad_sources", F.lit(0))).drop("page_known", "sample_known", "__scope", "first_bad", "id")


def rule_diagnostics(checked: DataFrame, catalog: DataFrame, crawls: DataFrame, runs: list[tuple[str, str | None, str | None, float]] = ()) -> DataFrame:
    """(crawl_id, rule_id, status, findings_generated, valid_findings, invalid_findings, error_type, error_message, duration_seconds): every rule appears, also without findings.

    ``runs`` tells of rules run one by one: (rule_id, error type or None, error message or None, seconds). A rule with an error is FAILED.
    """
    n = checked.groupBy("crawl_id", "rule_id").agg(F.count("*").alias("g"), F.count_if(F.size("errors") == 0).alias("v"))
    told = checked.sparkSession.createDataFrame(list(runs), "rule_id string, error_type string, error_message string, duration_seconds double")
    # both sides are small by nature: one row a rule, one row a crawl
    out = crawls.select("crawl_id").join(catalog.select(F.collect_list("rule_id").alias("rules")), how="cross").select("crawl_id", F.explode("rules").alias("rule_id")).join(n, ["crawl_id", "rule_id"], "left").join(told, "rule_id", "left")
    g, v = F.coalesce("g", F.lit(0)), F.coalesce("v", F.lit(0))
    status = F.when(F.col("error_type").isNotNull(), F.lit("FAILED")).when(g > v, F.lit("INVALID_FINDINGS")).when(g == 0, F.lit("NO_FINDINGS")).otherwise(F.lit("SUCCESS"))
    return out.select("crawl_id", "rule_id", status.alias("status"), g.alias("findings_generated"), v.alias("valid_findings"), (g - v).alias("invalid_findings"), "error_type", "error_message", "duration_seconds")
