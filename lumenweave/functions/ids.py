from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _id(prefix: str, rule: Column, *parts: Column) -> Column:
    digest = F.sha2(F.concat(*parts), 256)
    return F.upper(F.concat(F.lit(prefix), rule, F.lit("-"), F.substring(digest, 1, 32)))


def finding_id(rule: Column, *parts: Column) -> Column:
    """F-<rule>-<first 32 hex digits of the SHA-256 of rule and parts, not separated>, upper case."""
    return _id("F-", rule, rule, *parts)


def group_id(pipeline: Column, rule: Column, trigger_type: Column, severity: Column) -> Column:
    return _id("G-", rule, pipeline, rule, trigger_type, severity)


def signature(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
