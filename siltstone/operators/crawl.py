"""Breadth-first crawl as one DataFrame step per depth."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import BooleanType

from siltstone.config import Settings
from siltstone.functions import urls
from siltstone.functions.html import page_links

#: What a fetch returns for each url: body, content type, HTTP status, error (null if it succeeded).
FETCHED = "url string, html string, content_type string, http_status int, error string"
ROBOTS_SECONDS = 10
PAGE = "url string, depth int, seq bigint, status string, html string, title string, links array<string>, bytes bigint, http_status int"


def allowed(rules: str | None, url: str, agent: str) -> bool:
    """Whether robots rules let ``agent`` fetch ``url``; without rules, yes."""
    return True if rules is None else _parsed(rules).can_fetch(agent, url)


@lru_cache(1024)
def _parsed(rules: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(rules.splitlines())
    return parser


def robots_filter(targets: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``targets`` with ``allowed``. ``robots`` (base_url, body) has a row per authority that serves rules; rules go
    where they apply by a join, others are allowed."""

    @F.pandas_udf(BooleanType())
    def check(rules: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([allowed(r, u, agent) for r, u in zip(rules, url)])

    rules = robots.groupBy(F.col("base_url").alias("__base")).agg(F.min("body").alias("__rules"))  # one row an authority, or targets multiply
    x = targets.withColumn("__base", urls.base(F.col("url"))).join(rules, "__base", "left")
    return x.withColumn("allowed", F.coalesce(check("__rules", "url"), F.lit(True))).drop("__base", "__rules")


def table_fetch(web: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Fetches from a table (url, html, content_type, http_status, error); a url that isn't there fails."""
    return lambda targets: targets.select("url").join(web, "url", "left").withColumn("error", F.when(F.coalesce("html", "content_type", "error").isNull(), "not found").otherwise(F.col("error"))).select("url", "html", "content_type", "http_status", "error")


def http_fetch(settings: Settings) -> Callable[[DataFrame], DataFrame]:
    """Fetches over HTTP with TLS verification, one domain in one task, at least the delay between its fetches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for url, domain in zip(batch["url"], batch["domain"]):
                time.sleep(max(0.0, last.get(domain, 0.0) + settings.crawl_delay_seconds - time.monotonic()))
                last[domain] = time.monotonic()
                try:
                    request = urllib.request.Request(url, headers={"User-Agent": settings.user_agent, "Accept": "text/html"})
                    with urllib.request.urlopen(request, timeout=settings.crawl_timeout_seconds) as r:
                        out.append((url, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.headers.get("Content-Type", ""), r.status, None))
                except Exception as e:
                    out.append((url, None, None, getattr(e, "code", None), str(e)))
            yield pd.DataFrame(out, columns=["url", "html", "content_type", "http_status", "error"])

    return lambda targets: targets.select("url", urls.domain(F.col("url")).alias("domain")).repartition("domain").mapInPandas(run, FETCHED)


def http_robots(settings: Settings) -> Callable[[DataFrame], DataFrame]:
    """Fetches /robots.txt of authorities (base_url) over HTTP: base_url, body. Only an answer with status 200 has rules;
    anything else, time running out included, has none, and all is allowed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for base in batch["base_url"]:
                try:
                    request = urllib.request.Request(f"{base}/robots.txt", headers={"User-Agent": settings.user_agent})
                    with urllib.request.urlopen(request, timeout=ROBOTS_SECONDS) as r:
                        bodies.append(r.read().decode("utf-8", "replace") if r.status == 200 else None)
                except Exception:
                    bodies.append(None)
            yield pd.DataFrame({"base_url": batch["base_url"], "body": pd.Series(bodies, index=batch.index, dtype=object)})

    return lambda bases: bases.select("base_url").distinct().mapInPandas(run, "base_url string, body string")


@dataclass
class CrawlResult:
    """``log``: a row per URL taken from the frontier; ``seen``: hashes of all of those; ``frontier``: URLs that still
    waited when the pages were enough."""

    log: DataFrame
    seen: DataFrame
    frontier: int = 0
    seconds: float = 0.0

    def stats(self) -> DataFrame:
        """One row of counters: crawled, failed, skipped, bytes, seconds, pages a second."""
        of = lambda s: F.count_if(F.col("status") == s)
        return self.log.agg(of("crawled").alias("pages_crawled"), of("failed").alias("pages_failed"), of("skipped").alias("pages_skipped"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_downloaded")).withColumns(
            {"elapsed_seconds": F.lit(round(self.seconds, 3)), "pages_per_second": F.round(F.col("pages_crawled") / max(self.seconds, 1e-3), 3)}
        )

    def documents(self) -> DataFrame:
        """Raw documents of the crawl, in the documents table's columns; doc_id is a hash of the URL."""
        from siltstone.sources.store import DOCUMENTS, empty

        x = self.log.where("status = 'crawled'").select(
            F.sha2(F.col("url").cast("binary"), 256).alias("doc_id"), "url", "title", F.col("html").alias("raw_html"), F.lit(None).cast("string").alias("clean_text"),
            F.array().cast(empty(self.log.sparkSession, DOCUMENTS).schema["tokens"].dataType).alias("tokens"), F.lit(0).alias("token_count"), F.current_timestamp().alias("crawled_at"),
            F.lit(None).cast("timestamp").alias("processed_at"), "depth", urls.domain(F.col("url")).alias("domain"), F.lit("raw").alias("status"),
        )
        return x


def _keep(df: DataFrame) -> DataFrame:
    """Cuts lineage: a checkpoint where the session has a folder for it, else a cached copy (a local session)."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


#: An end for robots rules: a table (base_url, body), or a fetch of authorities (base_url) that gives one.
Robots = DataFrame | Callable[[DataFrame], DataFrame] | None


def crawl(spark: SparkSession, seeds: list[str], fetch: Callable[[DataFrame], DataFrame], robots: Robots = None, settings: Settings = Settings(), max_pages: int | None = None, seen: DataFrame | None = None) -> CrawlResult:
    """Fetches breadth first from the seeds, each URL once: depth by depth the frontier is what the last one links to and
    was never seen. Only HTML is kept; depth ``crawl_max_depth`` is fetched but not expanded. At most ``max_pages``
    pages, in frontier order; URLs that fail or are skipped don't count, so a depth goes on until that many are crawled.
    ``robots``: rules by authority, or where to fetch them (each authority once); without, all is allowed."""
    began = time.monotonic()
    most = settings.crawl_max_pages if max_pages is None else max_pages
    start = [(u, (0, i)) for i, u in enumerate(dict.fromkeys(x for x in map(urls.py_normalise, urls.valid_seeds(seeds)) if x))]
    frontier = spark.createDataFrame(start, "url string, at struct<seq:bigint,i:int>")
    seen = seen if seen is not None else spark.createDataFrame([], "url_hash string")
    rules = robots if isinstance(robots, DataFrame) else spark.createDataFrame([], "base_url string, body string")
    log, crawled, waiting, number = spark.createDataFrame([], PAGE), 0, 0, 0
    for depth in range(settings.crawl_max_depth + 1):
        # One row for each hash, the one linked first: URLs that differ in case alone are one page.
        fresh = frontier.withColumn("url_hash", urls.url_hash(F.col("url"))).join(seen, "url_hash", "left_anti")
        left = _keep(fresh.groupBy("url_hash").agg(F.min(F.struct("at", "url")).alias("x")).select("url_hash", "x.at", "x.url"))
        level = spark.createDataFrame([], PAGE)
        while crawled < most:
            # At most max_pages rows, so their places can be numbered in one task.
            place = F.row_number().over(Window.orderBy("at")) + F.lit(number).cast("bigint")
            named = _keep(left.orderBy("at").limit(most - crawled).select("url_hash", "url", F.lit(depth).alias("depth"), place.alias("seq")))
            taken, asked = named.count(), most - crawled
            if not taken:
                break
            number += taken
            seen = _keep(seen.union(named.select("url_hash")))
            if robots is not None and not isinstance(robots, DataFrame):
                unknown = named.select(urls.base(F.col("url")).alias("base_url")).distinct().join(rules, "base_url", "left_anti")
                rules = _keep(rules.union(robots(unknown).select("base_url", "body")))
            checked = robots_filter(named.select("url", "depth", "seq"), rules, settings.user_agent)
            got = _keep(fetch(checked.where("allowed")))
            is_html = F.coalesce(F.col("content_type").contains("text/html"), F.lit(False))
            status = F.when(~F.col("allowed"), "skipped").when(F.col("error").isNotNull(), "failed").when(~is_html, "skipped").otherwise("crawled")
            x = checked.join(got, "url", "left").withColumn("status", status).withColumn("html", F.when(F.col("status") == "crawled", F.col("html")))
            fields = page_links(x.where("status = 'crawled'").select("url", "html"))
            x = x.join(fields, "url", "left").select("url", "depth", "seq", "status", "html", F.col("crawl_title").alias("title"), "links", F.octet_length("html").cast("bigint").alias("bytes"), "http_status")
            part = _keep(x)
            level = level.union(part)
            crawled += part.where("status = 'crawled'").count()
            left = _keep(left.join(named.select("url_hash"), "url_hash", "left_anti"))
            if taken < asked:
                break
        log = log.union(level)
        waiting = left.count()
        nexts = level.where("status = 'crawled'").select("seq", F.posexplode_outer("links").alias("i", "url")).where(F.col("url").isNotNull())
        frontier = nexts.groupBy("url").agg(F.min(F.struct("seq", "i")).alias("at"))
        if depth == settings.crawl_max_depth or crawled >= most or frontier.isEmpty():
            if crawled >= most and depth < settings.crawl_max_depth:
                waiting += frontier.select(urls.url_hash(F.col("url")).alias("url_hash")).distinct().join(seen, "url_hash", "left_anti").count()
            break
    return CrawlResult(_keep(log), seen, waiting, time.monotonic() - began)
