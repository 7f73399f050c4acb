"""Secret scan with multipart credential linking; DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three kinds (assign, access, hex) that pass their length test.
The method adds spans: a bare 40-character key (kind ``key``) is weak evidence and an address (kind ``endpoint``) none
by itself, so they are reported only where complementary parts co-occur: a key with an access identifier in its scope,
an endpoint with an access identifier and a secret (key or assign) in its scope. A key is bounded by its own alphabet only,
so it may follow ``NAME=`` or end a sentence; ``=`` behind it is padding and not part of its span. A scope is a span widened by ``SCOPE``
code points on either side, within one document.

Positions: ``(?s)\\G(.*?)(pattern)`` cuts a text into gaps and matches; running sums of their lengths are the
positions; ``\\G`` lets the text behind the last match fail at once. The interval join is two sweeps over a document's spans, with the running maximum
of ends from the left and the running minimum of starts from the right: each span is one row and no pairs are made, whatever the
number of spans in a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

SCOPE = 500
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"(?i:https?|s3|jdbc:[a-z]+|postgres|mysql|mongodb|amqp|redis)://[^\x00-\x20\"'<>]+"
#: kind, pattern, number of groups before the gap's end, a test that is true of every text with a passing match
BASE = ("assign", "access", "hex")


def _cuts(text: Column, kind: str, pattern: str, needs: Column, groups: int = 0) -> Column:
    """array of (kind, pos, gap, len, value length) for each match; empty where ``needs`` is false."""
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    gap, hit = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    value = F.regexp_extract_all(text, whole, F.lit(2 + groups)) if groups else hit
    rows = F.transform(F.arrays_zip(gap.alias("g"), hit.alias("h"), value.alias("v")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.char_length(x["g"]).cast("long").alias("gap"), F.char_length(x["h"]).cast("long").alias("len"), F.char_length(x["v"]).cast("long").alias("value")))
    none = F.expr("cast(array() as array<struct<kind string, pos int, gap bigint, len bigint, value bigint>>)")
    return F.when(needs, rows).otherwise(none)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (row, doc_id, kind, start, end): every reported span of every text, and for a text without any one row whose kind is null.

    ``row`` tells rows with equal doc_id apart. Null text counts as empty; positions are code points, end exclusive.
    Empty input gives an empty result; extra columns are ignored.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    access = t.rlike(r"AKIA[A-Z0-9]{12}")
    cuts = [
        _cuts(t, "assign", ASSIGN, t.rlike(ASSIGN), 2),
        _cuts(t, "access", ACCESS, access),
        # runs shorter than 32 are dropped anyway, and a run of 32 or more begins where the maximal run begins
        _cuts(t, "hex", r"[0-9a-f]{32,}", t.rlike(r"[0-9a-f]{32}")),
        _cuts(t, "key", KEY, access),
        _cuts(t, "endpoint", ENDPOINT, access),
    ]
    s = d.select("row", "doc_id", F.concat(*cuts).alias("cuts")).select("row", "doc_id", F.explode_outer("cuts").alias("c")).select("row", "doc_id", "c.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    kind = F.col("kind")
    ok = (kind == "assign") & (F.col("value") >= 8) | (kind == "access") & (F.col("len") >= 16) | kind.isin("hex", "key", "endpoint")
    s = s.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # a part begins no later than this span and ends in the scope or behind it, or begins no earlier and does so in the scope
    left = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    right = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def beside(part: Column) -> Column:
        last, first = F.max(F.when(part, F.col("end"))).over(left), F.min(F.when(part, F.col("start"))).over(right)
        return F.coalesce(last >= F.col("start") - scope, F.lit(False)) | F.coalesce(first <= F.col("end") + scope, F.lit(False))

    has_access, has_secret = beside(F.col("ok") & (kind == "access")), beside(F.col("ok") & kind.isin("key", "assign"))
    report = kind.isin(*BASE) | (kind == "key") & has_access | (kind == "endpoint") & has_access & has_secret
    shown = F.col("ok") & F.coalesce(report, F.lit(False))
    return s.select("row", "doc_id", F.when(shown, kind).alias("kind"), F.when(shown, F.col("start")).alias("start"), F.when(shown, F.col("end")).alias("end"))


def per_document(spans: DataFrame) -> DataFrame:
    kinds = [*BASE, "key", "endpoint"]
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    item = F.when(F.col("kind").isNotNull(), F.struct(F.col("start").alias("s"), rank.alias("k"), F.concat_ws(":", "kind", "start", "end").alias("x")))
    g = spans.groupBy("row", "doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE], F.array_sort(F.collect_list(item)).alias("all"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x["x"]), ",")
    base = F.filter("all", lambda x: x["k"] <= len(BASE))
    return g.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(secret_spans(read_table(spark, sf_dir, "documents")))
