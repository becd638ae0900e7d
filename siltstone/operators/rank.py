"""BM25 over postings, deterministic order, pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import Settings


def idf(df: Column, total_docs: int) -> Column:
    if not total_docs:
        return F.lit(0.0)
    return F.when(df == 0, 0.0).otherwise(F.log((F.lit(float(total_docs)) - df + 0.5) / (df + 0.5) + 1.0))


def py_idf(df: int, total_docs: int) -> float:
    return math.log((total_docs - df + 0.5) / (df + 0.5) + 1) if total_docs and df else 0.0


def tf_norm(tf: Column, doc_len: Column, avg_doc_length: float, k1: float = 1.5, b: float = 0.75) -> Column:
    if not avg_doc_length:
        return F.lit(0.0)
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * (doc_len / F.lit(float(avg_doc_length)))))


def contributions(index, count: dict[str, int], order: dict[str, int], settings: Settings) -> DataFrame:
    """A row per (term, document) of the query: doc_id, ord, term, part of the score. Terms whose idf isn't positive
    give none. The statistics of the few terms join as a hash table."""
    post = index.lookup(list(count)) if count else index.postings.limit(0)
    stats = index.term_stats.where(F.col("term").isin(*count)) if count else index.term_stats.limit(0)
    few = F.broadcast(stats.limit(len(count) or 1))  # a row per term of the query, and there are no more
    length = F.lit(0) if settings.compat else F.col("doc_len")
    weight = idf(F.col("df"), index.total_docs)
    pick = lambda values, default: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("term")) if values else F.lit(default)
    x = post.join(few, "term").withColumn("idf", weight).where("idf > 0")
    part = F.col("idf") * tf_norm(F.col("tf"), length, index.avg_doc_length, settings.k1, settings.b) * pick(count, 1)
    return x.select("doc_id", pick(order, 0).alias("ord"), "term", part.alias("part"))


def ranked(parts: DataFrame) -> DataFrame:
    """Scores by document: doc_id, score rounded before sorting, first_ord, matched_terms in query order."""
    matched = F.transform(F.array_sort(F.collect_set(F.struct("ord", "term"))), lambda x: x["term"])
    return parts.groupBy("doc_id").agg(F.round(F.sum("part"), 6).alias("score"), F.min("ord").alias("first_ord"), matched.alias("matched_terms"))


def page(matches: DataFrame, number: int = 1, size: int = 10, compat: bool = False) -> DataFrame:
    """A page of matches with rank. Ties come by the first matching term's place, then doc_id."""
    number, size = max(1, number), max(1, size)
    start = (number - 1) * size
    top = matches.orderBy(F.desc("score"), "first_ord", "doc_id").offset(start).limit(size)
    place = F.row_number().over(_order())
    return top.withColumn("rank", (place + (0 if compat else start)).cast("int"))


def _order():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), "first_ord", "doc_id")  # a page's rows only


def total_pages(total: int, size: int, early: bool = False, compat: bool = False) -> int:
    """None without matches; compat: one, unless the query ended early."""
    if total == 0:
        return 1 if compat and not early else 0
    return -(-total // size)
