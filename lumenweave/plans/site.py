"""A site's audit from stored answers to files, and its configuration in one place."""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import semantic
from ..sources.dumps import write_dumps, write_reports
from ..sources.responses import CrawlConfig, crawl_stored
from .audit import Audit, audit

PREFIX = "spark.lumenweave."


@dataclass(frozen=True)
class SiteConfig:
    """What an audit does. ``output`` names a folder for reports (``json``, ``markdown``) and the crawls' dumps (``dump``); without it nothing is written."""

    crawl: CrawlConfig = field(default_factory=lambda: CrawlConfig(crawl_depth=2, page_limit=100, in_flight=5))
    audited_at: str = "1970-01-01T00:00:00Z"
    semantic: bool = True
    enrichment: bool = True
    several_canonicals: bool = True
    output: str | None = None
    files: tuple[str, ...] = ("json", "markdown")


def _value(kind: str, text: str):
    """A setting's text as what its field holds; "none" is None where that is allowed."""
    if "None" in kind and text.strip().lower() in ("", "none"):
        return None
    if "tuple" in kind:
        return tuple(x.strip() for x in text.split(",") if x.strip())
    if "bool" in kind:
        if text.strip().lower() not in ("true", "false"):
            raise ValueError(f"{text!r} is neither true nor false")
        return text.strip().lower() == "true"
    return int(text) if "int" in kind else text


def load_config(spark: SparkSession, default: SiteConfig = SiteConfig()) -> SiteConfig:
    """The session's settings ``spark.lumenweave.<name>`` and ``spark.lumenweave.crawl.<name>`` over ``default``. A name that no field has is an error."""
    known = {f.name: f.type for f in fields(SiteConfig) if f.name != "crawl"}
    crawl = {f"crawl.{f.name}": f.type for f in fields(CrawlConfig)}
    own, below = {}, {}
    for key, text in spark.conf.getAll.items():
        if not key.startswith(PREFIX):
            continue
        name = key.removeprefix(PREFIX)
        if name in known:
            own[name] = _value(known[name], text)
        elif name in crawl:
            below[name.removeprefix("crawl.")] = _value(crawl[name], text)
        else:
            raise ValueError(f"there is no setting {key}")
    return replace(default, crawl=replace(default.crawl, **below), **own)


def logger(name: str = "lumenweave", level: int = logging.INFO) -> logging.Logger:
    """A logger that writes to standard output; asked for again, it is the same one with the same single handler."""
    log = logging.getLogger(name)
    if not any(isinstance(h, logging.StreamHandler) and getattr(h, "stream", None) is sys.stdout for h in log.handlers):
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log


def audit_site(seeds: DataFrame, responses: DataFrame, robots: DataFrame | None = None, config: SiteConfig | None = None, model: semantic.Model = semantic.mock_model, make=E.MockGenerator) -> Audit:
    """Crawls the stored answers from each seed (crawl_id, url), audits what was found, and writes the files that the configuration asks for."""
    config = config or load_config(seeds.sparkSession)
    log = logger()
    c = crawl_stored(seeds, responses, robots, config.crawl, config.audited_at)
    log.info("crawled: %s", c.crawl.agg(F.count("*").alias("crawls"), F.sum("crawl_stats.html_pages_crawled").alias("html_pages")).first().asDict())
    a = audit(c, config.audited_at, model if config.semantic else None, make if config.enrichment else None, config.several_canonicals, timed=True)
    if config.output:
        for kind in config.files:
            if kind == "json":
                write_reports(a.json, config.output, ".report.json")
            elif kind == "markdown":
                write_reports(a.markdown, config.output, ".md")
            elif kind == "dump":
                write_dumps(c, config.output)
            else:
                raise ValueError(f"there are no files of the kind {kind}")
        log.info("written to %s: %s", config.output, ", ".join(config.files))
    return a
