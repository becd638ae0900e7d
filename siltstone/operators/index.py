"""Positional inverted index: postings a row per (term, document), statistics, and a versioned store."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.functions import text as tx
from siltstone.sources.folder import versions

STATS = "total_docs bigint, total_tokens bigint, avg_doc_length double, shards int, stemmer string"


def shard(term: Column, shards: int | None = 4) -> Column:
    """First four bytes of the term's SHA-256 as a number, modulo the shards (0 or None: the default)."""
    return F.pmod(F.conv(F.substring(F.sha2(term.cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(shards or 4)).cast("int")


def py_shard(term: str, shards: int | None = 4) -> int:
    return int.from_bytes(hashlib.sha256(term.encode()).digest()[:4], "big") % (shards or 4)


def term_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))


def postings(tokens: DataFrame, shards: int = 4) -> DataFrame:
    """Token rows to postings: shard, term, doc_id, tf, positions (ascending), doc_len."""
    x = tokens.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"), F.first("doc_len").alias("doc_len"))
    return x.select(shard(F.col("term"), shards).alias("shard"), "term", "doc_id", "tf", "positions", "doc_len")


def document_postings(docs: DataFrame, stemmer: str = "suffix", shards: int = 4, compose: bool = True, repeated: bool | None = None) -> DataFrame:
    """The same postings from ``docs`` (doc_id, text): each text's within its row, without a shuffle. Only where rows share
    a doc_id (``repeated``; None: it is looked up) all tokens are grouped."""
    if tx.repeated(docs) if repeated is None else repeated:
        return postings(tx.token_rows(docs, stemmer, compose), shards)
    x = tx.term_arrays(docs, stemmer, compose).select("doc_id", "doc_len", F.explode_outer(tx.grouped(F.col("terms"))).alias("e")).where(F.col("e").isNotNull())
    return x.select(shard(F.col("e.term"), shards).alias("shard"), "e.term", "doc_id", F.size("e.positions").alias("tf"), "e.positions", "doc_len")


def postings_from_payload(docs: DataFrame, shards: int = 4) -> DataFrame:
    """Processed documents (doc_id, tokens array<struct<term,tf,positions>>, token_count) to postings. A term that comes
    twice in a payload counts with its last entry; missing tf is 1, missing positions none."""
    x = docs.select("doc_id", F.col("token_count").alias("doc_len"), F.posexplode_outer("tokens").alias("i", "t")).where(F.col("t").isNotNull())
    x = x.groupBy("doc_id", "doc_len", F.col("t.term").alias("term")).agg(F.max_by("t", "i").alias("t"))
    positions = F.coalesce(F.sort_array("t.positions"), F.array().cast("array<int>"))
    return x.select(shard(F.col("term"), shards).alias("shard"), "term", "doc_id", F.coalesce("t.tf", F.lit(1)).alias("tf"), positions.alias("positions"), "doc_len")


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """``counts`` (token_count a row per document, documents without tokens too) to one row of statistics."""
    total = F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint")
    return counts.agg(F.count("*").alias("total_docs"), total.alias("total_tokens")).withColumn("avg_doc_length", F.when(F.col("total_docs") > 0, F.col("total_tokens") / F.col("total_docs")).otherwise(F.lit(0.0)))


def shard_sizes(post: DataFrame, docs: int) -> DataFrame:
    """Terms and postings of each shard; every shard sees all documents' lengths."""
    x = post.groupBy("shard").agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"))
    return x.withColumn("docs", F.lit(docs).cast("bigint"))


@dataclass
class Index:
    """An index version: tables and the statistics that plans embed as literals."""

    postings: DataFrame
    term_stats: DataFrame
    total_docs: int
    total_tokens: int
    avg_doc_length: float
    shards: int = 4
    stemmer: str = "suffix"

    def lookup(self, terms: list[str]) -> DataFrame:
        """Postings of the given terms; shard literals prune partitions, the terms reach the Parquet scan."""
        terms = sorted(set(terms))
        shards = sorted({py_shard(t, self.shards) for t in terms})
        return self.postings.where(F.col("shard").isin(*shards) & F.col("term").isin(*terms)) if terms else self.postings.limit(0)


def build(docs: DataFrame, settings: Settings = Settings(), compose: bool = True) -> Index:
    """An index in memory of nothing but plans over ``docs`` (doc_id, text)."""
    each = tx.token_counts(docs, compose).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    total, tokens, most = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.max("n")).first()
    post = document_postings(docs, settings.stemmer, settings.num_shards, compose, (most or 0) > 1)
    return Index(post, term_stats(post), total, tokens, tokens / total if total else 0.0, settings.num_shards, settings.stemmer)


def write(index: Index, root: str) -> int:
    """Writes a new version beside older ones and returns its number. The statistics come last and make it count, so
    readers never see half an index, and terms that are gone are gone. Postings are dealt by ranges of shard, term and
    document, as many as their size calls for, so a frequent term is no single task's; lookups prune shards and skip files
    and row groups by term."""
    spark = index.postings.sparkSession
    version = max(versions(spark, root), default=0) + 1
    at = f"{root}/v{version}"
    index.postings.write.parquet(f"{at}/unsorted")  # finding the ranges reads them a first time
    unsorted = spark.read.schema(index.postings.schema).parquet(f"{at}/unsorted")
    ranged = unsorted.repartitionByRange("shard", "term", "doc_id").sortWithinPartitions("shard", "term", "doc_id")
    ranged.write.partitionBy("shard").parquet(f"{at}/postings")
    stored = spark.read.schema(index.postings.schema).parquet(f"{at}/postings")
    term_stats(stored).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/term_stats")
    row = [(index.total_docs, index.total_tokens, float(index.avg_doc_length), index.shards, index.stemmer)]
    spark.createDataFrame(row, STATS).coalesce(1).write.parquet(f"{at}/stats")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/unsorted")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return version


def read(spark: SparkSession, root: str) -> Index:
    """The latest version that was written whole."""
    found = versions(spark, root, "stats/_SUCCESS")
    if not found:
        raise FileNotFoundError(f"no index in {root}")
    at = f"{root}/v{found[-1]}"
    stats = spark.read.schema(STATS).parquet(f"{at}/stats").first()
    return Index(spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/term_stats"), *stats)
