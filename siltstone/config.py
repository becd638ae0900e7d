"""Settings that change results, with overrides from ``spark.conf`` keys ``siltstone.<name>``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    num_shards: int = 4
    k1: float = 1.5
    b: float = 0.75
    page_size: int = 10
    max_page_size: int = 50
    cache_ttl_seconds: float = 300.0
    crawl_max_depth: int = 3
    crawl_max_pages: int = 500
    crawl_delay_seconds: float = 1.0
    crawl_timeout_seconds: float = 30.0
    user_agent: str = "siltstone-crawler"
    stemmer: str = "suffix"
    #: Wired behaviour instead of documented intent: no length normalisation, negation ignored and unknown words
    #: skipped in AND queries, rank restarting on each page, pages of at most ten, snippets from titles.
    compat: bool = False

    @classmethod
    def of(cls, spark: SparkSession, **overrides) -> Settings:
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(f"siltstone.{f.name}", None)
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.lower() == "true" if kind is bool else kind(raw)
        return replace(cls(**found), **overrides)
