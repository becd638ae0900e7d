"""The documents table on Parquet: versions, upsert, scans and counts."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.folder import has_files, versions

DOCUMENTS = (
    "doc_id string, url string, title string, raw_html string, clean_text string, tokens array<struct<term:string,tf:int,positions:array<int>>>, token_count int, "
    "crawled_at timestamp, processed_at timestamp, depth int, domain string, status string"
)
CRAWL_JOBS = "job_id string, seed_url string, started_at timestamp, finished_at timestamp, pages_crawled int, status string"
MANIFEST = "bucket int, version int"
#: Buckets of a new store; a store keeps the number that it was made with.
BUCKETS = 64
#: Columns that an upsert takes from the new row; all others keep the old row's values.
REPLACED = ("title", "clean_text", "tokens", "token_count", "processed_at", "status")


def empty(spark: SparkSession, schema: str = DOCUMENTS) -> DataFrame:
    return spark.createDataFrame([], schema)


def upsert(old: DataFrame, new: DataFrame, refresh_html: bool = False) -> DataFrame:
    """``old`` with ``new`` merged in by url, both of the documents' columns. Of several new rows with one url that of
    the latest crawl counts. ``refresh_html`` also replaces raw_html and crawled_at."""
    take = set(REPLACED) | ({"raw_html", "crawled_at"} if refresh_html else set())
    one = new.groupBy("url").agg(F.max_by(F.struct(*new.columns), F.coalesce("crawled_at", F.timestamp_seconds(F.lit(0)))).alias("r")).select("r.*")
    x = old.alias("o").join(one.alias("n"), F.col("o.url") == F.col("n.url"), "full_outer")
    is_new, is_old = F.col("n.url").isNotNull(), F.col("o.url").isNotNull()
    return x.select(*[F.when(is_new & (F.lit(c in take) | ~is_old), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def get(docs: DataFrame, doc_id) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def unprocessed(docs: DataFrame, limit: int = 100) -> DataFrame:
    return docs.where("status = 'raw'").orderBy("crawled_at", "doc_id").limit(limit)


def processed(docs: DataFrame) -> DataFrame:
    return docs.where("status = 'processed'").select("doc_id", "url", "title", "tokens", "token_count", "domain")


def processed_page(docs: DataFrame, offset: int = 0, limit: int = 1000) -> DataFrame:
    return processed(docs).orderBy("doc_id").offset(offset).limit(limit)


def counts(docs: DataFrame) -> DataFrame:
    """One row: total, processed, avg_token_count over processed rows (0 if there are none)."""
    done = F.col("status") == "processed"
    return docs.agg(F.count("*").alias("total"), F.count_if(done).alias("processed"), F.coalesce(F.avg(F.when(done, F.col("token_count"))), F.lit(0.0)).alias("avg_token_count"))


class DocumentStore:
    """The documents table as numbered versions. Rows are dealt to buckets by a hash of their URL; a version holds the
    buckets that it changes, and last its manifest, which says for every bucket the version that has it. A version cut
    short has no manifest and does not count. ``meta`` (document metadata for result pages) is a projection."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def init(self) -> None:
        """An empty first version, where there is none yet."""
        if self._version() is None:
            self._put(None, dict.fromkeys(range(self.buckets), 0))

    def _version(self) -> int | None:
        found = versions(self.spark, self.root, "manifest/_SUCCESS")
        return found[-1] if found else None

    def _held(self) -> dict[int, int]:
        return {r["bucket"]: r["version"] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/v{self._version()}/manifest").collect()}

    def _bucket(self, url: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")

    def _put(self, docs: DataFrame | None, held: dict[int, int]) -> None:
        """Writes ``docs`` as the buckets they belong to; all other buckets stay where ``held`` has them."""
        version = max(versions(self.spark, self.root), default=0) + 1
        if docs is not None:
            data = f"{self.root}/v{version}/data"
            x = docs.withColumn("bucket", self._bucket(F.col("url"), len(held)))
            x.repartitionByRange("bucket", "url").write.partitionBy("bucket").parquet(data)
            there = self.spark.read.schema("bucket int").option("basePath", data).parquet(data).select("bucket").distinct().collect() if has_files(self.spark, data) else []
            held = held | {r["bucket"]: version for r in there}
        self.spark.createDataFrame(list(held.items()), MANIFEST).coalesce(1).write.parquet(f"{self.root}/v{version}/manifest")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All documents, or those of some buckets."""
        paths = [f"{self.root}/v{v}/data/bucket={b}" for b, v in sorted(self._held().items()) if v and (buckets is None or b in set(buckets))]
        schema = empty(self.spark).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else empty(self.spark)

    def write(self, docs: DataFrame) -> None:
        """A version of ``docs`` alone."""
        self._put(docs, dict.fromkeys(self._held(), 0))

    def upsert(self, new: DataFrame, refresh_html: bool = False) -> None:
        """Merges ``new`` in; only the buckets of its URLs are read and written."""
        held = self._held()
        touched = [r[0] for r in new.select(self._bucket(F.col("url"), len(held))).distinct().collect()]
        if touched:
            self._put(upsert(self.read(touched), new, refresh_html), held)

    def add_job(self, seeds: list[str], started: float, finished: float, pages: int, status: str) -> None:
        """Records a crawl: a row per seed URL, with one job_id."""
        job = uuid.uuid4().hex
        times = [datetime.fromtimestamp(t, timezone.utc) for t in (started, finished)]
        rows = [(job, s, *times, pages, status) for s in seeds]
        self.spark.createDataFrame(rows, CRAWL_JOBS).coalesce(1).write.mode("append").parquet(f"{self.root}/jobs")

    def jobs(self) -> DataFrame:
        """All crawls recorded."""
        return self.spark.read.schema(CRAWL_JOBS).parquet(f"{self.root}/jobs") if has_files(self.spark, f"{self.root}/jobs") else empty(self.spark, CRAWL_JOBS)

    def meta(self, ids: DataFrame) -> DataFrame:
        """``ids`` (ord, doc_id) with url, title, domain, depth; nulls where there is no such document."""
        return ids.join(self.read().select("doc_id", "url", "title", "domain", "depth"), "doc_id", "left")

    def healthy(self) -> bool:
        try:
            self.spark.sql("SELECT 1").first()
            return self._version() is not None
        except Exception:
            return False
