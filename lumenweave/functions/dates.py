from __future__ import annotations

import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARSED = T.StructType([T.StructField("micros", T.LongType()), T.StructField("status", T.StringType())])
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_DATE_LIKE = re.compile(r"^\d{4}-\d{2}-\d{2}")


def parse_one(value) -> tuple[int | None, str]:
    """Microseconds since 1970 in UTC and VALID, IMPOSSIBLE or UNPARSEABLE, by the ISO 8601 reader of Python's datetime."""
    if not value or not isinstance(value, str) or not value.strip():
        return None, "UNPARSEABLE"
    value = value.strip()
    try:
        t = datetime.fromisoformat(value[:-1] + "+00:00" if value.endswith("Z") else value)
        t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    except (ValueError, OverflowError):
        return None, "IMPOSSIBLE" if _DATE_LIKE.match(value) else "UNPARSEABLE"
    d = t - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds, "VALID"


@F.pandas_udf(_PARSED)
def parse_date(value: pd.Series) -> pd.DataFrame:
    got = [parse_one(v) for v in value]
    return pd.DataFrame({"micros": pd.array([g[0] for g in got], dtype="Int64"), "status": [g[1] for g in got]})


@F.pandas_udf(T.ArrayType(_PARSED))
def parse_dates(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [dict(zip(("micros", "status"), parse_one(x))) for x in v] for v in values], dtype=object)


HOUR, DAY = 3_600_000_000, 86_400_000_000


def iso(micros: Column) -> Column:
    """As Python prints an aware UTC datetime."""
    ts = F.timestamp_micros(micros)
    part = F.pmod(micros, F.lit(1_000_000))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))), F.lit("+00:00"))


def utc_day(micros: Column) -> Column:
    return F.floor(micros / DAY)


def is_future(micros: Column, audit: Column, hours: int = 24) -> Column:
    return micros > audit + F.lit(hours * HOUR)


def hours_between(a: Column, b: Column) -> Column:
    return (b - a) / F.lit(float(HOUR))


def valid_chronology(published: Column, modified: Column, hours: int = 24) -> Column:
    return (published <= modified) | (published - modified <= F.lit(hours * HOUR))


def age_days(micros: Column, audit: Column) -> Column:
    return F.floor((audit - micros) / DAY)
