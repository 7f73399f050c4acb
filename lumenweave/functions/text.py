from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: the characters that str.isspace() accepts, as a Java character class
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze_out(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, SPACE, "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def is_blank(c: Column) -> Column:
    """NULL, empty or white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def markdown_escape(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ("`", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def percentage(part: Column, whole: Column) -> Column:
    """(part / whole) * 100 in doubles and in this order; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * F.lit(100.0).cast("double"))
