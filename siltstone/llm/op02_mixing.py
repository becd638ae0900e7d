"""Mixing sources to target weights, with DataFrame functions only.

Each row has a 60-bit hash of its doc_id and text. Words are summed by source and hash bucket; running sums over at most
2**LEVEL_BITS buckets a source find the bucket in which the budget is used up; only the rows of that one bucket are summed
by finer buckets, until it holds a single hash. Rows below the threshold are taken, and of the rows at it, which are equal,
as many as come nearest: nothing is sorted, and every level but the first touches a 2**-LEVEL_BITS part of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, apart, small, stage

HASH_BITS = 60
LEVEL_BITS = 10


def _key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def _hash(doc_id: Column, text: Column) -> Column:
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Staged ``sizes`` with ``place``, from 0 by code point of the source, null last: sources are dealt by ranges, and only
    the number in each range is summed up in one place."""
    order = [F.col("source").isNull(), F.col("source")]
    x = stage(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = x.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return x.withColumn("part", part).join(ranges.select("part", "first"), "part").withColumn("place", F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1)).drop("part", "first", "id")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``sizes`` (key, source, source_size) with ``target`` double and ``budget`` long, its whole words.

    Sources by code point, null last, get the weights in turn. All targets add up to all sizes; one that would be above
    ``most`` times its source's size stops there and the excess is shared by weight, again and again: each time only two
    sums over the sources are needed, what is left to share and the weights that share it. No words at all: targets of 0."""
    big = "decimal(38,0)"
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    x = stage(_numbered(sizes).withColumn("w", w.cast("bigint")), "mix-weights")
    total, weight = x.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    left, open_ = total, weight
    while True:
        capped = F.col("source_size").cast(big) * most * F.lit(open_).cast(big) < F.lit(left).cast(big) * F.col("w")
        fixed, gone = x.where(capped).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if (total - most * fixed, weight - gone) == (left, open_) or gone == weight:
            break
        left, open_ = total - most * fixed, weight - gone
    share = F.col("w") * F.lit(left).cast("bigint")
    return x.select(
        "key", "source", "source_size",
        F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(share.cast("double") / F.lit(float(open_ or 1))).alias("target"),
        F.when(capped, F.col("source_size") * most).otherwise(F.floor(share.cast(big) / F.lit(open_ or 1).cast(big)).cast("bigint")).alias("budget"),
    )


def thresholds(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``sized`` (key, source, size, h) to a row a source: key, source_size, target, repeats (whole passes over the
    source), limit and quota: rows with h < limit, and ``quota`` of those with h = limit, are taken once more, as many as
    end nearest to the target."""
    sizes = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    found = source_targets(sizes, weights, most)
    whole = F.expr("if(source_size > 0, budget div source_size, 0L)")
    found = stage(
        found.withColumn("repeats", whole)
        .select("key", "source_size", "target", "repeats", (F.col("budget") - F.col("repeats") * F.col("source_size")).alias("rest"))
        .withColumns({"prefix": F.lit(0).cast("bigint"), "taken": F.lit(0).cast("bigint"), "last": F.lit(0).cast("bigint"), "rows": F.lit(0).cast("bigint"), "single": F.col("source_size") == 0}),
        "mix-targets",
    )
    state = ["key", "source_size", "target", "repeats", "rest", "prefix", "taken", "last", "rows", "single"]
    shift = HASH_BITS
    while shift > 0:
        outer, shift = shift, shift - LEVEL_BITS
        edge = small(found.select("key", "prefix", "rest", "taken"))
        inside = sized.join(edge, "key").where(F.shiftright("h", outer) == F.col("prefix"))
        bucket = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = Window.partitionBy("key").orderBy("bucket")
        bucket = bucket.join(edge, "key").withColumn("upto", F.sum("words").over(run) + F.col("taken"))
        first = bucket.where(F.col("upto") > F.col("rest")).groupBy("key").agg(F.min(F.struct("bucket", "words", "rows", "upto", "low", "high")).alias("b"))
        found = found.join(first, "key", "left").select(
            "key", "source_size", "target", "repeats", "rest",
            F.coalesce("b.bucket", F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"), F.coalesce(F.col("b.upto") - F.col("b.words"), "taken").alias("taken"),
            F.coalesce("b.words", F.lit(0)).alias("last"), F.coalesce("b.rows", F.lit(0)).alias("rows"), (F.coalesce(F.col("b.low") == F.col("b.high"), F.lit(True))).alias("single"), F.col("b.low").alias("low"),
        )
        found = stage(found, "mix-level")
        done = found.agg(F.coalesce(F.bool_and("single"), F.lit(True))).first()[0]
        if done:
            break
        found = found.select(*state)
    # of the rows at the limit, equal in size, as many as end nearest, fewer if two ends are as near
    quota = F.expr("if(last > 0, (2 * (rest - taken) + each - 1) div (2 * each), 0L)")
    return found.withColumn("each", F.expr("if(rows > 0, last div rows, 0L)")).select("key", "source_size", "target", "repeats", F.coalesce("low", F.lit(0)).alias("limit"), quota.alias("quota"))


def _at_limit(rows: DataFrame) -> DataFrame:
    """Staged ``rows`` (key, quota) at their source's limit, numbered: with ``once``, whether they are taken. Ranges of the
    staged rows are counted, and numbered each by itself, so that very many equal rows are no single task's."""
    x = stage(rows.withColumn("__id", F.monotonically_increasing_id()), "mix-limit").withColumn("__part", F.shiftright("__id", 33))
    before = Window.partitionBy("key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy("key", "__part").agg(F.count("*").alias("n")).withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("key", "__part").orderBy("__id")) - 1
    x = x.withColumn("__place", place).join(parts, ["key", "__part"])
    return x.withColumn("once", F.col("__first") + F.col("__place") < F.col("quota")).drop("__id", "__part", "__place", "__first")


def _taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` (key, h) with what their source's cut has, and ``times``, how often each is taken."""
    x = rows.join(cut, "key")
    rest = x.where(F.col("h") != F.col("limit")).withColumn("once", F.col("h") < F.col("limit"))
    return rest.unionByName(_at_limit(x.where(F.col("h") == F.col("limit")))).withColumn("times", F.col("repeats") + F.col("once").cast("int"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    A document is taken whole: ``taken`` is a multiple of its size, at most ``most`` times. The hash is of doc_id and
    text, so reruns agree, and rows of one doc_id are told apart; of equal rows some may be taken once more than others.
    Null or empty text: size and taken 0. A null source is a source of its own, a null doc_id hashes as the empty text.
    No rows: no rows."""
    sized = stage(docs.select("doc_id", "source", _key(F.col("source")).alias("key"), _size(F.col("text")).alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-sizes")
    cut = small(stage(thresholds(sized, weights, most), "mix-cut"))
    return _taken(sized, cut).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it (see :func:`mix_sources`); all columns stay, also extra ones
    whose names clash with those here. Texts without words add nothing to a target and stay or go with their hash; a source
    without any words goes. No rows: no rows."""
    x, back = apart(docs, "doc_id", "text", "source")
    keyed = x.withColumns({"key": _key(F.col("source")), "h": _hash(F.col("doc_id"), F.col("text"))})
    sized = stage(keyed.select("source", "key", _size(F.col("text")).alias("size"), "h"), "mix-sizes")
    cut = small(stage(thresholds(sized, weights, most), "mix-cut"))
    return back(_taken(keyed, cut).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for :func:`mix_sources`: the same cut, found by sorting."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15) AS h, row_number() OVER () AS r
  FROM {docs}),
s AS (SELECT k, any_value(source) AS source, sum(size)::HUGEINT AS ss FROM d GROUP BY k),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
x AS (SELECT *, sum(ss) OVER () AS tot,
        3 * coalesce(sum(ss) OVER (ORDER BY ss / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        sum(w) OVER (ORDER BY ss / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM w),
y AS (SELECT *, 3 * ss * op < (tot - below) * w AS capped FROM x),
z AS (SELECT *, sum(CASE WHEN capped THEN 3 * ss ELSE 0 END) OVER () AS fixed, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS free FROM y),
t AS (SELECT k, ss, CASE WHEN capped THEN (3 * ss)::DOUBLE ELSE (w * (tot - fixed))::BIGINT::DOUBLE / free::BIGINT::DOUBLE END AS target,
        CASE WHEN capped THEN (3 * ss)::BIGINT ELSE (w * (tot - fixed))::BIGINT // free::BIGINT END AS budget FROM z),
r AS (SELECT *, CASE WHEN ss > 0 THEN budget // ss::BIGINT ELSE 0 END AS rep FROM t),
g AS (SELECT d.k, h, sum(size)::BIGINT AS words, count(*) AS n FROM d GROUP BY d.k, h),
c AS (SELECT g.*, words // n AS each, sum(words) OVER (PARTITION BY g.k ORDER BY h)::BIGINT AS upto, budget - rep * ss::BIGINT AS rest
      FROM g JOIN r USING (k)),
e AS (SELECT *, CASE WHEN upto <= rest THEN n WHEN upto - words <= rest AND each > 0 THEN (2 * (rest - (upto - words)) + each - 1) // (2 * each) ELSE 0 END AS quota FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY k, h ORDER BY r) AS place FROM d)
SELECT p.doc_id, p.size, r.ss::BIGINT AS source_size, r.target, (p.size * (r.rep + CASE WHEN place <= e.quota AND r.ss > 0 THEN 1 ELSE 0 END))::BIGINT AS taken, p.source
FROM p JOIN r USING (k) JOIN e ON e.k = p.k AND e.h = p.h"""


QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": oracle()}
