"""Raw pages to processed documents: fields, tokens, payload; failures keep their reason."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import html
from siltstone.functions import text as tx
from siltstone.sources.folder import shared_dir


def payload(docs: DataFrame, stemmer: str = "suffix", compose: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, tokens: array of (term, tf, positions) in order of first appearance, and
    unique_terms; without a shuffle, unless rows share a doc_id. Texts without terms give no row."""
    if tx.repeated(docs):
        x = tx.token_rows(docs, stemmer, compose).groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("position")).alias("positions"))
        x = x.groupBy("doc_id").agg(F.collect_list(F.struct("term", "positions")).alias("each"))
    else:
        x = tx.term_arrays(docs, stemmer, compose).select("doc_id", tx.grouped(F.col("terms")).alias("each"))
    entry = lambda e: F.struct(e["positions"][0].alias("first"), F.struct(e["term"].alias("term"), F.size(e["positions"]).alias("tf"), e["positions"].alias("positions")).alias("t"))
    tokens = F.sort_array(F.transform("each", entry))["t"]
    # The outer explode of one value keeps the optimiser from finding it again for the filter.
    x = x.select("doc_id", F.explode_outer(F.array(tokens)).alias("tokens")).where(F.size("tokens") > 0)
    return x.withColumn("unique_terms", F.size("tokens"))


def _parsed(fields: DataFrame) -> DataFrame:
    """``fields`` written to the shared folder and read back: what follows reads them three times, and parses once."""
    spark = fields.sparkSession
    path = f"{shared_dir(spark)}/siltstone/fields-{uuid.uuid4().hex}"
    fields.write.parquet(path)
    return spark.read.schema(fields.schema).parquet(path)


def process(raw: DataFrame, stemmer: str = "suffix") -> DataFrame:
    """Rows of the documents table to the same rows processed, or with status ``failed``: and error, unique_terms."""
    fields = _parsed(html.parse_pages(raw.select("doc_id", "url", F.col("raw_html").alias("html")), "doc_id").drop("url"))
    full = fields.where("error is null").select("doc_id", F.col("full_text").alias("text"))
    counts = tx.token_counts(full).select("doc_id", F.col("token_count").alias("n"))
    made = payload(full, stemmer)
    x = raw.drop("tokens", "token_count", "clean_text", "processed_at", "status").withColumnRenamed("title", "crawl_title")
    x = x.join(fields.select("doc_id", "title", "body_text", "error"), "doc_id").join(counts, "doc_id", "left").join(made, "doc_id", "left")
    done = F.col("error").isNull()
    none = F.array().cast(raw.schema["tokens"].dataType)
    values = {
        "title": F.when(done, F.coalesce("title", F.lit(""))).otherwise(F.col("crawl_title")), "clean_text": F.when(done, F.col("body_text")), "tokens": F.coalesce("tokens", none),
        "token_count": F.coalesce("n", F.lit(0)), "processed_at": F.when(done, F.current_timestamp()), "status": F.when(done, "processed").otherwise("failed"),
    }
    return x.select(*[values[c].alias(c) if c in values else F.col(c) for c in raw.columns], "error", F.coalesce("unique_terms", F.lit(0)).alias("unique_terms"))
