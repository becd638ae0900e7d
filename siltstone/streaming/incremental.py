"""Incremental indexing: a stream of page files, each page once, into the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import urls
from siltstone.operators.process import process
from siltstone.sources.store import DocumentStore, empty

PAGES = "page_id bigint, url string, html string"


def raw_documents(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) to raw rows of the documents table; URLs that can't be normalised are dropped."""
    x = pages.withColumn("url", urls.normalise(F.col("url"))).where(F.col("url").isNotNull())
    tokens = empty(pages.sparkSession).schema["tokens"].dataType
    return x.select(
        F.sha2(F.col("url").cast("binary"), 256).alias("doc_id"), "url", F.lit(None).cast("string").alias("title"), F.col("html").alias("raw_html"), F.lit(None).cast("string").alias("clean_text"),
        F.array().cast(tokens).alias("tokens"), F.lit(0).alias("token_count"), F.current_timestamp().alias("crawled_at"), F.lit(None).cast("timestamp").alias("processed_at"), F.lit(0).alias("depth"),
        urls.domain(F.col("url")).alias("domain"), F.lit("raw").alias("status"),
    )


def index_stream(spark: SparkSession, source: str, store: DocumentStore, checkpoint: str) -> StreamingQuery:
    """Starts a query that processes new Parquet files of ``source`` as they come. The stream's state is the seen set:
    a URL is taken once. Restarting from ``checkpoint`` goes on where the last batch ended."""
    pages = spark.readStream.schema(PAGES).parquet(source)
    once = pages.withColumn("url", urls.normalise(F.col("url"))).where(F.col("url").isNotNull()).dropDuplicates(["url"])

    def batch(rows: DataFrame, number: int) -> None:
        done = process(raw_documents(rows)).drop("error", "unique_terms").persist()
        store.upsert(done)
        done.unpersist()

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
