"""Rules of robots.txt files as a table, and the addresses that they block, by an equi-join on path prefixes."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import unused

RULES = "origin string, allow boolean, pattern string, head string, regex string"


def origin_of(url: Column) -> Column:
    """Scheme, host and port of an address, in lower case."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))


def path_and_query(url: Column) -> Column:
    """What a rule is matched with: path and query, a slash where there is no path."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def parse_robots(text: str | None, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the rules that hold for ``agent``: those of the groups with the longest name that the agent's begins with, else of the groups for all."""
    best, chosen, names, open_group = -1, [], [], False
    agent = agent.lower()
    for line in (text or "").lstrip("\ufeff").splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if not open_group else [value.lower()]
            open_group = False
        elif key in ("allow", "disallow"):
            open_group = True
            fits = max((0 if n == "*" else len(n) for n in names if n == "*" or n and agent.startswith(n)), default=-1)
            if fits > best:
                best, chosen = fits, []
            if fits == best and fits >= 0 and value:
                chosen.append((key == "allow", unquote(value)))
    return chosen


def rule_regex(pattern: str) -> str:
    """A pattern as a regular expression on the whole of path and query: ``*`` is any text, a last ``$`` the end."""
    end = pattern.endswith("$")
    body = "".join(".*" if c == "*" else re.escape(c) for c in (pattern[:-1] if end else pattern))
    return f"(?s)^{body}" + ("$" if end else "")


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """RULES of robots.txt files (origin, text). ``head`` is a pattern's text before its first ``*`` or last ``$``. Null or empty files have no rules."""

    @F.pandas_udf("array<struct<allow: boolean, pattern: string, head: string, regex: string>>")
    def parsed(text: pd.Series) -> pd.Series:
        return pd.Series([[{"allow": a, "pattern": p, "head": re.split(r"\*|\$$", p)[0], "regex": rule_regex(p)} for a, p in parse_robots(t, agent)] for t in text], dtype=object)

    return files.select(F.lower("origin").alias("origin"), F.inline(parsed("text"))).distinct()


def with_blocked(rows: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The rows with ``blocked``: whether the longest rule that matches an address forbids it; of rules of one length, one that allows wins.

    A rule's literal head is one of the address's prefixes, so only prefixes of lengths that the origin's rules have are made, and joined on their text; what
    stands behind a ``*`` is verified by the regular expression. Addresses without rules are free, and a null address, too.
    """
    origin, path, n, head, size = (unused(rows, f"robots_{c}") for c in ("origin", "path", "n", "head", "size"))
    lengths = rules.groupBy("origin").agg(F.array_sort(F.collect_set(F.length("head"))).alias(n)).withColumnRenamed("origin", origin)
    own = rows.select(url).where(F.col(url).isNotNull()).distinct().select(F.col(url).alias(path + "u"), origin_of(F.col(url)).alias(origin), path_and_query(F.col(url)).alias(path))
    some = own.join(lengths, origin).withColumn(size, F.explode(F.filter(n, lambda k: k <= F.length(path)))).withColumn(head, F.expr(f"substring(`{path}`, 1, `{size}`)"))
    hit = some.join(rules.withColumnsRenamed({"origin": origin, "head": head}), [origin, head]).where(F.regexp_like(F.col(path), F.col("regex")))
    worst = hit.groupBy(F.col(path + "u").alias(url)).agg(F.max_by(~F.col("allow"), F.struct(F.length("pattern"), "allow")).alias("blocked"))
    return rows.drop("blocked").join(worst, url, "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))

