"""Dedup and grouping of findings, scores, counts and the order of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import group_id, signature
from ..functions.text import percentage

KEYS = ["pipeline", "rule_id", "trigger_type", "severity"]
SAMPLE = 10
SALTS = 64
# Points that a group of each severity costs, and the severities' order
WEIGHTS = {"critical": 50, "high": 20, "medium": 10, "low": 5, "info": 0}
RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def smallest(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, n, sample): the number of rows and the k smallest values of each group, without gathering a group.

    Counts are an aggregation. Of each of SALTS shares the k smallest come first, cut before the shuffle where Spark can limit a window's groups; at most
    SALTS * k values meet.
    """
    salted = rows.select(*keys, F.col(value).alias("v")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("v"))).where(F.col("r") <= k)
    sample = few.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("v")), 1, k).alias("sample"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(sample, keys)


def deduplicate(findings: DataFrame) -> DataFrame:
    """Of findings alike in id, pipeline, rule, trigger, severity, page, field and observed value, the first by their whole content."""
    s = findings.withColumn("signature", signature(*map(F.col, ("id", "pipeline", "rule_id", "trigger_type", "severity", "page", "field", "observed_value"))))
    row = F.struct(*findings.columns)
    return s.groupBy("crawl_id", "signature").agg(F.min_by(row, F.to_json(row)).alias("f")).select("f.*")


def group(findings: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row a group: group_id, the canonical finding's columns, pages_checked, pages_affected, affected_percentage, sample, truncated, n_sources.

    ``evaluated`` is (crawl_id, pages). The representative is the source of smallest page, then id. Sources stay rows of ``findings``.
    """
    keys = ["crawl_id", *KEYS]
    rest = [c for c in findings.columns if c not in (*keys, "id", "pages_checked", "pages_affected", "affected_percentage", "sample", "sample_count", "truncated")]
    row = F.struct(*rest)
    g = findings.groupBy(*keys).agg(F.min_by(row, F.struct(F.coalesce("page", F.lit("")), F.col("id"), F.to_json(row))).alias("f"), F.count("*").alias("n_sources"))
    urls = smallest(findings.where(F.coalesce("page", F.lit("")) != "").select(*keys, "page").distinct(), keys, "page", SAMPLE)
    g = g.join(urls, keys, "left").join(evaluated, "crawl_id", "left")
    n, pages = F.coalesce("n", F.lit(0)).cast("bigint"), F.coalesce("pages", F.lit(0)).cast("bigint")
    return g.select(
        group_id(*map(F.col, KEYS)).alias("group_id"), *keys, *[F.col(f"f.{c}").alias(c) for c in rest], pages.alias("pages_checked"), n.alias("pages_affected"),
        F.least(percentage(n, pages), F.lit(100.0)).alias("affected_percentage"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"), (n > SAMPLE).alias("truncated"), "n_sources",
    )


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[c], F.lit(99))


def report_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy("crawl_id", "pipeline", severity_rank(F.col("severity")), "title", "group_id")


def with_places(groups: DataFrame) -> DataFrame:
    """Groups with their title's place in the report (``place``), in order of id (``id_place``), and of rule, then id (``rule_place``), counted from 1 in each crawl. A crawl has at most one group a rule and severity."""
    w = lambda *by: F.row_number().over(Window.partitionBy("crawl_id").orderBy(*by)).cast("bigint")
    return groups.withColumns({"place": w("pipeline", severity_rank(F.col("severity")), "title", "group_id"), "id_place": w("group_id"), "rule_place": w("rule_id", "group_id")})


def summary(groups: DataFrame, crawls: DataFrame) -> DataFrame:
    """(crawl_id, score, total_findings, high, medium, low, info); a crawl without groups scores 100. Critical groups cost points but are not counted apart."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("severity")], F.lit(0))
    s = groups.groupBy("crawl_id").agg(F.sum(weight).alias("w"), F.count("*").alias("total_findings"), *[F.count_if(F.col("severity") == x).alias(x) for x in ("high", "medium", "low", "info")])
    out = crawls.select("crawl_id").join(s, "crawl_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("crawl_id", F.greatest(F.lit(0), 100 - F.coalesce("w", F.lit(0))).cast("bigint").alias("score"), *map(zero, ("total_findings", "high", "medium", "low", "info")))


def raw_counts(findings: DataFrame, by: str) -> DataFrame:
    return findings.groupBy("crawl_id", by).agg(F.count("*").alias("findings"))


def compression(findings: DataFrame, groups: DataFrame, crawls: DataFrame) -> DataFrame:
    """(crawl_id, raw_findings, groups, ratio): raw over groups, 1 without raw findings."""
    a = findings.groupBy("crawl_id").agg(F.count("*").alias("a"))
    b = groups.groupBy("crawl_id").agg(F.count("*").alias("b"))
    j = crawls.select("crawl_id").join(a, "crawl_id", "left").join(b, "crawl_id", "left").select("crawl_id", F.coalesce("a", F.lit(0)).alias("raw_findings"), F.coalesce("b", F.lit(0)).alias("groups"))
    return j.withColumn("ratio", F.when(F.col("raw_findings") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("raw_findings").cast("double"), F.col("groups"))))


def profile(pages: DataFrame) -> DataFrame:
    """(crawl_id, page_type, pages, without_links, images, image_alts, without each text field) in one aggregation."""
    x = "extracted."
    missing = {c: F.count_if(F.coalesce(F.col(x + c), F.lit("")) == "").alias(f"no_{c}") for c in ("title", "meta_description", "language", "canonical", "visible_text")}
    return pages.groupBy("crawl_id", F.col(x + "page_type").alias("page_type")).agg(
        F.count("*").alias("pages"), F.count_if(F.size(x + "internal_links") == 0).alias("without_links"), F.sum(F.size(x + "image_urls")).alias("images"), F.sum(F.size(x + "image_alts")).alias("image_alts"), *missing.values()
    )
