"""Rules as SQL table functions: a user's rule over a crawl's pages, written in Python, called from SQL.

``register`` makes a rule class a table function: ``select * from my_rule(table(pages))``, or ``table(pages) partition by crawl_id`` for a rule that needs a
crawl's pages together. The function is polymorphic: it accepts any table that has the columns which the rule names, takes the rule's settings as named
arguments, and its result has the columns of a finding. Rows come one by one and none is kept; a rule that gathers something keeps it itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .catalog import FINDING, PIPELINES, RULE_TEXTS

_TEXTS = {r[0]: r for r in RULE_TEXTS}
SETTINGS = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.BooleanType, T.DecimalType)


class PageRule:
    """A rule on pages. Subclasses set rule_id, pipeline, severity, title, action and needs, and define ``check``; ``end`` may tell more when a partition is over.

    ``check`` gives dicts with any of a finding's columns; ``page`` stands for ``key`` if that is missing, by which findings are told apart. A rule must not touch the network.
    """

    rule_id = pipeline = severity = title = action = ""
    needs: tuple[str, ...] = ("crawl_id", "page_seq", "url")

    def __init__(self, **settings):
        self.settings = settings

    def check(self, page: Row) -> Iterable[dict]:
        raise NotImplementedError

    def end(self) -> Iterable[dict]:
        return ()

    def finding(self, said: dict) -> dict:
        key = said.get("key", said.get("page") or "")
        digest = hashlib.sha256(f"{self.rule_id}{key}".encode("utf-8", "surrogatepass")).hexdigest()[:32]
        counted = None if self.pipeline == "engagement" else 1
        return {
            "id": f"F-{self.rule_id}-{digest}".upper(), "pipeline": self.pipeline, "title": self.title, "severity": self.severity, "rule_id": self.rule_id, "trigger_type": "deterministic", "action": self.action, "priority": self.severity,
            "pages_checked": counted, "pages_affected": counted, "affected_percentage": None if counted is None else 100.0,
        } | said


def known_texts(rule_id: str) -> dict:
    """The catalog's texts of a rule, as a subclass's attributes."""
    rule, pipeline, severity, title, action = _TEXTS[rule_id]
    return {"rule_id": rule, "pipeline": pipeline, "severity": severity, "title": title, "action": action}


def table_function(rule: type[PageRule]):
    """The rule as a polymorphic table function of a table and named settings."""
    if not rule.rule_id:
        raise ValueError("a rule needs an id")
    if rule.pipeline not in PIPELINES:
        raise ValueError(f"{rule.pipeline} is no pipeline")

    schema = T._parse_datatype_string(FINDING)
    names = schema.names

    class Function:
        @staticmethod
        def analyze(pages: AnalyzeArgument, **settings: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError("the first argument must be a table")
            have = {f.name for f in pages.dataType.fields}
            if lost := [c for c in rule.needs if c not in have]:
                raise ValueError(f"{rule.rule_id} needs the columns {', '.join(lost)}")
            if odd := [k for k, a in settings.items() if not isinstance(a.dataType, SETTINGS)]:
                raise ValueError(f"settings must be plain values: {', '.join(odd)}")
            return AnalyzeResult(schema)

        def __init__(self):
            self.rule = None

        def eval(self, pages: Row, **settings) -> Iterator[tuple]:
            self.rule = self.rule or rule(**settings)
            for said in self.rule.check(pages) or ():
                yield self._row({"crawl_id": pages["crawl_id"], "seq": pages["page_seq"]} | said)

        def terminate(self) -> Iterator[tuple]:
            if self.rule is not None:
                for said in self.rule.end() or ():
                    yield self._row(said)

        def _row(self, said: dict) -> tuple:
            values = self.rule.finding(said)
            return tuple(values.get(n) for n in names)

    return udtf(Function)


def register(spark: SparkSession, name: str, rule: type[PageRule]) -> None:
    spark.udtf.register(name, table_function(rule))
