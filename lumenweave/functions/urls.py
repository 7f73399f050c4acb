from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def url_join(base: pd.Series, ref: pd.Series) -> pd.Series:
    """``ref`` resolved against ``base``; NULL if either is NULL, ``ref`` itself where the two cannot be joined."""
    from urllib.parse import urljoin

    def one(b, r):
        if b is None or r is None:
            return None
        try:
            return urljoin(b, r)
        except ValueError:
            return r

    return pd.Series([one(b, r) for b, r in zip(base, ref)], dtype=object)


def defragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def has_scheme_and_host(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def in_domains(host: Column, domains: Column) -> Column:
    return F.exists(domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
