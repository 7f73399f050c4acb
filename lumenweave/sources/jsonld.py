"""JSON-LD of pages as rows of VARIANT: lists, graphs and single objects, with what could not be read counted."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

# Dates that an object may name, in order, and the types that tell a page's kind
DATES = ("datePublished", "dateModified", "uploadDate")
ARTICLES = ("Article", "NewsArticle", "BlogPosting")


@F.pandas_udf(T.StringType())
def _lenient(text: pd.Series) -> pd.Series:
    """Texts that Python's reader takes though VARIANT's does not (a key that comes twice, NaN), written so that both do: the last value of a key, null for no number."""

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(json.loads(t, parse_constant=lambda _: None), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in text], dtype=object)


def parsed(text: Column) -> Column:
    """A script as VARIANT, NULL if it is no JSON. Only what the native parser refuses goes to Python."""
    native = F.try_parse_json(text)
    return F.coalesce(native, F.try_parse_json(_lenient(F.when(native.isNull(), text))))


def kind(v: Column) -> Column:
    """array, object or scalar; NULL for no value."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("ARRAY"), F.lit("array")).when(s.startswith("OBJECT"), F.lit("object")).when(v.isNotNull(), F.lit("scalar"))


def scripts(pages: DataFrame) -> DataFrame:
    """(crawl_id, page_seq, script, v): the scripts of pages that have any, written; v is NULL for a malformed one."""
    each = pages.select("crawl_id", "page_seq", F.posexplode("extracted.json_ld").alias("script", "text")).where("text is not null")
    return written(each.select("crawl_id", "page_seq", "script", parsed(F.col("text")).alias("v")))


def objects(found: DataFrame) -> DataFrame:
    """(crawl_id, page_seq, script, nth, object) of ``scripts``: the elements of a list, those of an object's ``@graph`` if it is a list, else the object itself. Scalars count for nothing; elements may be of any kind."""
    spark = found.sparkSession
    graph = F.try_variant_get("v", '$["@graph"]', "variant")
    k = kind(F.col("v"))
    listed = F.when(k == "array", F.col("v")).when((k == "object") & (kind(graph) == "array"), graph)
    keyed = found.select("crawl_id", "page_seq", "script", "v", listed.alias("listed"))
    many = keyed.where("listed is not null").lateralJoin(spark.tvf.variant_explode(F.col("listed").outer())).select("crawl_id", "page_seq", "script", F.col("pos").alias("nth"), F.col("value").alias("object"))
    one = keyed.where(F.col("listed").isNull() & (kind(F.col("v")) == "object")).select("crawl_id", "page_seq", "script", F.lit(0).alias("nth"), F.col("v").alias("object"))
    return many.union(one)


def text_at(v: Column, name: str) -> Column:
    """An object's field if it is a string."""
    field = F.try_variant_get(v, f'$["{name}"]', "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(v, f'$["{name}"]', "string"))


def dates(found: DataFrame) -> DataFrame:
    """(crawl_id, page_seq, script, nth, field, value): the dates that objects name as strings."""
    o = F.col("object")
    each = F.filter(F.array(*[F.struct(F.lit(d).alias("field"), text_at(o, d).alias("value")) for d in DATES]), lambda x: x["value"].isNotNull())
    return found.where(kind(o) == "object").select("crawl_id", "page_seq", "script", "nth", F.inline(each))


def by_page(pages: DataFrame) -> DataFrame:
    """(crawl_id, page_seq, objects, malformed, kind, dates): counts, article or product by the first object with such a type (else NULL), and dates in order as ``field=value``. Pages without scripts have no row."""
    s = scripts(pages)
    o = written(objects(s))
    place = F.struct("script", "nth")
    type_ = text_at(F.col("object"), "@type")
    named = F.when(type_.isin(*ARTICLES), F.lit("article")).when(type_ == "Product", F.lit("product"))
    named = F.when(kind(F.col("object")) == "object", named)
    counts = o.select("crawl_id", "page_seq", place.alias("place"), named.alias("kind")).groupBy("crawl_id", "page_seq").agg(F.count("*").alias("objects"), F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("place"))).alias("kind"))
    order = F.create_map(*[F.lit(x) for i, d in enumerate(DATES) for x in (d, i)])[F.col("field")]
    d = dates(o).select("crawl_id", "page_seq", F.struct("script", "nth", order.alias("k"), F.concat_ws("=", "field", "value").alias("said")).alias("d"))
    d = d.groupBy("crawl_id", "page_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda x: x["said"]), ",").alias("dates"))
    bad = s.groupBy("crawl_id", "page_seq").agg(F.count_if(F.col("v").isNull()).alias("malformed"))
    out = bad.join(counts, ["crawl_id", "page_seq"], "left").join(d, ["crawl_id", "page_seq"], "left")
    return out.select("crawl_id", "page_seq", F.coalesce("objects", F.lit(0)).alias("objects"), "malformed", "kind", F.coalesce("dates", F.lit("")).alias("dates"))
