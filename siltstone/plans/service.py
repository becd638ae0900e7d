"""The search engine: crawl, process, index, search, cache, metrics."""

from __future__ import annotations

import hashlib
import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.operators import index as ix
from siltstone.operators import query as qy
from siltstone.operators.crawl import CrawlResult, crawl
from siltstone.operators.process import process
from siltstone.operators.rank import page as page_of
from siltstone.operators.rank import total_pages
from siltstone.operators.snippet import snippet
from siltstone.sources.store import DocumentStore, counts, processed, unprocessed

log = logging.getLogger("siltstone")


@dataclass
class SearchResult:
    rank: int
    doc_id: object
    url: str
    title: str
    snippet: str
    score: float
    matched_terms: list[str]


@dataclass
class SearchResponse:
    query: str
    results: list[SearchResult] = field(default_factory=list)
    total_found: int = 0
    page: int = 1
    page_size: int = 10
    total_pages: int = 0
    query_time_ms: float = 0.0
    from_cache: bool = False

    @property
    def has_results(self) -> bool:
        return bool(self.results)


class ResultCache:
    """Responses that expire; at most ``most``, the oldest go first."""

    def __init__(self, ttl: float, most: int = 1000, clock=time.monotonic):
        self.ttl, self.most, self.clock, self.held = ttl, most, clock, {}

    @staticmethod
    def key(query: qy.ParsedQuery, page: int, size: int) -> str:
        """By the parsed query, so that words which mean different things don't collide."""
        parts = (query.kind, *query.terms, "-", *query.negative)
        return hashlib.sha256(f"{chr(31).join(parts)}|p{page}|s{size}".encode()).hexdigest()[:16]

    @staticmethod
    def compat_key(query: str, page: int, size: int) -> str:
        return hashlib.sha256(f"{query.lower().strip()}|p{page}|s{size}".encode()).hexdigest()[:16]

    def get(self, key: str) -> SearchResponse | None:
        found = self.held.get(key)
        if found is None or self.clock() >= found[0]:
            self.held.pop(key, None)
            return None
        return found[1]

    def put(self, key: str, response: SearchResponse) -> None:
        self.held[key] = (self.clock() + self.ttl, response)
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held)))

    def clear(self) -> int:
        n = len(self.held)
        self.held.clear()
        return n


def hydrate(top: DataFrame, docs: DataFrame, terms: list[str], compat: bool = False) -> DataFrame:
    """A page of matches with url, title (or url) and snippet of the body, from ``docs`` (doc_id, url, title,
    clean_text); empty where there is no such document. The page is the small side, so of the documents only its rows
    are read on."""
    found = docs.select("doc_id", "url", "title", "clean_text").join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi")
    x = top.join(F.broadcast(found), "doc_id", "left")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"), F.lit(""))
    body = F.coalesce("title", F.lit("")) if compat else F.coalesce(F.nullif(F.col("clean_text"), F.lit("")), F.col("title"), F.lit(""))
    return x.select("rank", "doc_id", F.coalesce("url", F.lit("")).alias("url"), title.alias("title"), snippet(body, terms).alias("snippet"), "score", "matched_terms")


class SearchEngine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root = spark, root
        self.settings = settings or Settings.of(spark)
        self.store = DocumentStore(spark, f"{root}/documents")
        self.store.init()
        self.cache = ResultCache(self.settings.cache_ttl_seconds)
        self.last_crawl: CrawlResult | None = None
        self._index: ix.Index | None = None

    def crawl(self, seeds: list[str], fetch, robots=None, max_pages: int | None = None, recrawl: bool = True) -> DataFrame:
        """Crawls, stores, processes and records the job; returns the counters. ``robots`` as :func:`crawl` takes it: for a
        live crawl ``http_robots(settings)``. Without ``recrawl`` URLs seen before stay out."""
        seen = None if recrawl or self.last_crawl is None else self.last_crawl.seen
        began, status, pages = time.time(), "failed", 0
        try:
            self.last_crawl = crawl(self.spark, seeds, fetch, robots, self.settings, max_pages, seen)
            stats = self.last_crawl.stats()
            pages = stats.first()["pages_crawled"]
            self.store.upsert(self.last_crawl.documents(), refresh_html=True)
            self.process_batch()
            status = "completed"
        finally:
            self.store.add_job(seeds, began, time.time(), pages, status)
            log.info("crawl seeds=%d pages=%d status=%s", len(seeds), pages, status)
        return stats

    def add_documents(self, docs: DataFrame) -> None:
        self.store.upsert(docs)

    def process_batch(self, limit: int | None = None) -> DataFrame:
        """Processes raw documents, the oldest first; returns doc_id, url, success, token_count, unique_terms, error."""
        docs = self.store.read()
        raw = docs.where("status = 'raw'") if limit is None else unprocessed(docs, limit)
        done = process(raw, self.settings.stemmer).persist()
        out = done.select("doc_id", "url", F.col("error").isNull().alias("success"), "token_count", "unique_terms", "error")
        self.store.upsert(done.drop("error", "unique_terms"))
        return out

    def rebuild_index(self) -> ix.Index:
        """Indexes all processed documents into a new version; cached responses go."""
        docs = processed(self.store.read())
        stats = ix.corpus_stats(docs.select("token_count")).first()
        post = ix.postings_from_payload(docs, self.settings.num_shards)
        built = ix.Index(post, ix.term_stats(post), stats["total_docs"], stats["total_tokens"], stats["avg_doc_length"], self.settings.num_shards, self.settings.stemmer)
        ix.write(built, f"{self.root}/index")
        self._index = None
        self.cache.clear()
        return self.index

    @property
    def index(self) -> ix.Index:
        if self._index is None:
            self._index = ix.read(self.spark, f"{self.root}/index")
        return self._index

    def search(self, query: str, page: int = 1, page_size: int = 10, use_cache: bool = True) -> SearchResponse:
        began = time.perf_counter()
        if not 1 <= len(query) <= 500 or not query.strip():
            raise ValueError("a query has 1 to 500 characters")
        compat = self.settings.compat
        page, size = max(1, page), max(1, min(page_size, self.settings.page_size if compat else self.settings.max_page_size))
        parsed = qy.parse(query, self.settings.stemmer)
        key = ResultCache.compat_key(query, page, size) if compat else ResultCache.key(parsed, page, size)
        ms = lambda: round((time.perf_counter() - began) * 1000, 2)
        if use_cache and (held := self.cache.get(key)):
            return SearchResponse(query, held.results, held.total_found, page, size, held.total_pages, ms(), True)
        if not parsed.terms:
            return SearchResponse(query, page=page, page_size=size, query_time_ms=ms())
        matches = qy.search(self.index, parsed, self.settings).persist()
        try:
            total = matches.count()
            rows = hydrate(page_of(matches, page, size, compat), self.store.read(), parsed.terms, compat).orderBy("rank").collect() if total else []
        finally:
            matches.unpersist()
        results = [SearchResult(**r.asDict()) for r in rows]
        response = SearchResponse(query, results, total, page, size, total_pages(total, size, compat=compat), ms())
        if use_cache and results:
            self.cache.put(key, response)
        log.info("search query=%s found=%d ms=%s", query, total, response.query_time_ms)
        return response

    def flush_cache(self) -> dict:
        return {"status": "flushed", "keys_deleted": self.cache.clear()}

    def health(self) -> dict:
        ok = self.store.healthy()
        return {"status": "healthy" if ok else "degraded", "store": ok}

    def metrics(self) -> DataFrame:
        """One row of corpus, crawl and index counters."""
        c = counts(self.store.read())
        seen = self.last_crawl.seen.count() if self.last_crawl else 0
        i = self.index
        return c.select(
            F.col("total").alias("total_documents"), F.col("processed").alias("processed_documents"), F.lit(i.term_stats.count()).alias("indexed_terms"), F.lit(round(i.avg_doc_length, 2)).alias("avg_doc_length"),
            F.lit(self.last_crawl.frontier if self.last_crawl else 0).alias("frontier_size"), F.lit(seen).alias("seen_urls"), F.lit(i.shards).alias("num_shards"), F.lit(i.total_docs).alias("total_docs_indexed"),
        )

    def admin_stats(self) -> dict:
        c, i = counts(self.store.read()).first(), self.index
        return {
            "documents": {"total": c["total"], "processed": c["processed"], "avg_token_count": round(c["avg_token_count"], 2)},
            "index": {"shards": i.shards, "unique_terms": i.term_stats.count(), "avg_doc_length": round(i.avg_doc_length, 2)},
            "ranking": {"algorithm": "BM25", "k1": self.settings.k1, "b": self.settings.b},
        }
