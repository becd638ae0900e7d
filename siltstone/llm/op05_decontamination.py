"""Benchmark decontamination by a positional index of the training documents, with DataFrame functions only.

One pass over the texts cuts them into words and stores the postings (term, document, position) of every word that the
benchmark has, and of the end of each document, whose position is its number of words. Everything else reads that index.
Each window of benchmark words is looked for by its two rarest words, by their counts over all documents: their postings,
shifted by a word's place in its item, meet at one offset of the item in the document. Where they agree, the whole item is
intersected with the document's postings at that offset, and runs of a window or more are occurrences.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import apart, small, stage

WINDOW = 13
#: ASCII characters that no word has.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Stands for the end of a document; no word has this character.
_END = "."


def _words(text: Column) -> Column:
    """Words of a text with A-Z as a-z: everything between is made a space, then cut there (a regular expression for
    the words takes four times as long)."""
    plain = F.translate(text, _BETWEEN + string.ascii_uppercase, " " * len(_BETWEEN) + string.ascii_lowercase)
    return F.array_remove(F.split(plain, " "), "")


def _key(docs: DataFrame) -> DataFrame:
    """``docs`` with k1 and k2, which tell different (doc_id, text) apart; equal rows share them."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "k2": F.xxhash64(F.col("text"), F.col("doc_id").isNull())})


def item_words(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``items`` (item_id, text), staged: places (item, a number for each different text; n words; j, t) and the item_ids
    (item, id) of each item; and of their words and the end mark the number t of each term, -1 of the mark."""
    x = items.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), _words(F.col("text")).alias("w"))
    x = stage(x.where(F.size("w") > 0).withColumn("item", F.xxhash64(F.array_join("w", " "), F.size("w"))), "bench-items")
    return x.select("item", "id").distinct(), x.select("item", F.size("w").alias("n"), F.posexplode("w").alias("j", "term")).distinct()


def vocabulary(places: DataFrame) -> DataFrame:
    """Staged (term, t) of all words of ``places`` and of the end of a document, -1."""
    words = places.select("term").distinct().withColumn("t", F.monotonically_increasing_id())
    end = words.sparkSession.range(1).select(F.lit(_END).alias("term"), F.lit(-1).cast("bigint").alias("t"))
    return stage(words.union(end), "bench-terms")


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Staged postings (t, k1, k2, doc_id, pos) of the ``terms`` in ``docs`` (with keys), and of each row's end."""
    words = F.concat(F.coalesce(_words(F.col("text")), F.array().cast("array<string>")), F.array(F.lit(_END)))
    each = docs.select("k1", "k2", F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(words).alias("pos", "term"))
    return stage(each.join(small(terms), "term").select("t", "k1", "k2", "doc_id", "pos"), "bench-index")


def rarest(index: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """Staged anchors (item, n, j, t): for every window of every item its two rarest words by their counts in the index;
    of equally rare ones those whose place divides best by the window, which serve most windows. Windows with a word that
    no document has can't occur and get none."""
    counts = stage(index.where("t >= 0").groupBy("t").agg(F.count("*").alias("cf")), "bench-counts")
    placed = places.join(small(counts), "t", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("j") - window + 1), F.least(F.col("j"), F.greatest(F.lit(0), F.col("n") - window)))
    each = placed.select("item", "n", "j", "t", "cf", F.explode(starts).alias("start"))
    rank = Window.partitionBy("item", "start").orderBy("cf", F.col("j") % window, "j")
    each = each.withColumns({"rank": F.row_number().over(rank), "least": F.min("cf").over(Window.partitionBy("item", "start"))})
    return stage(each.where("rank <= 2 and least > 0").select("item", "n", "j", "t").distinct(), "bench-anchors")


def occurrences(index: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """Staged maximal runs of at least a window (an item shorter than that: whole) of each item (``places``: item, n, j,
    t) in each document of the index: k1, k2, item, first, last (positions in the document)."""
    anchors = small(rarest(index, places, window))
    agree = index.join(anchors, "t").groupBy("k1", "k2", "item", "n", (F.col("pos") - F.col("j")).alias("delta")).agg(F.countDistinct("j").alias("rare"))
    found = stage(agree.where(F.col("rare") >= F.least(F.lit(2), "n")).select("k1", "k2", "item", "delta"), "bench-offsets")
    keys = small(stage(found.select("k1", "k2").distinct(), "bench-docs"))
    there = index.select("k1", "k2", "pos", "t").join(keys, ["k1", "k2"], "left_semi")
    wanted = found.join(small(places), "item").withColumn("pos", F.col("delta") + F.col("j"))
    same = there.join(wanted, ["k1", "k2", "pos", "t"]).select("k1", "k2", "item", "n", "delta", "j").distinct()  # equal rows of docs
    run = F.row_number().over(Window.partitionBy("k1", "k2", "item", "delta").orderBy("j"))
    runs = same.withColumn("run", F.col("j") - run).groupBy("k1", "k2", "item", "n", "delta", "run").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    runs = runs.where(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), "n"))
    return stage(runs.select("k1", "k2", "item", (F.col("a") + F.col("delta")).alias("first"), (F.col("b") + F.col("delta")).alias("last")), "bench-runs")


def proximity(docs: DataFrame, items: DataFrame, within: int = 2 * WINDOW) -> DataFrame:
    """Documents in which all different words of an item (item_id, text) come within ``within`` positions: doc_id,
    item_id, from_pos. Postings of all item words are gathered in overlapping blocks of positions, so that no document
    is one group; best for items of rare words. Null and wordless texts have no match, items without words neither; equal
    rows count as one; a null item_id is the empty string. No rows: no rows."""
    ids, places = item_words(items)
    terms = vocabulary(places)
    index = positional_index(_key(docs), terms)
    wanted = ids.withColumnRenamed("id", "item_id").join(places.join(terms, "term"), "item").select("item_id", "t").distinct()
    need = wanted.groupBy("item_id").agg(F.count("*").alias("need"))
    hits = index.join(wanted, "t")
    block = F.floor(F.col("pos") / within)
    hits = hits.withColumn("block", F.explode(F.array(block, block - 1)))
    span = Window.partitionBy("k1", "k2", "item_id", "block").orderBy("pos").rangeBetween(0, within - 1)
    hits = hits.withColumn("got", F.size(F.collect_set("t").over(span))).join(need, "item_id").where(F.col("got") == F.col("need"))
    return hits.groupBy("doc_id", "k1", "k2", "item_id").agg(F.min("pos").alias("from_pos")).select("doc_id", "item_id", "from_pos")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, k1, k2.

    n_hit counts words inside occurrences, each once; contaminated if that is at least 1/share of the words. Null or
    wordless text: no words, never contaminated. Items without words never occur; a null item_id is the empty string;
    items of equal item_id count once. Equal rows get equal results. No rows: no rows."""
    ids, places = item_words(items)
    terms = vocabulary(places)
    index = positional_index(_key(docs.select("doc_id", "text")), terms)
    runs = occurrences(index, stage(places.join(small(terms), "term").select("item", "n", "j", "t"), "bench-places"), window)
    hits = runs.select("k1", "k2", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    which = runs.select("k1", "k2", "item").distinct().join(small(ids), "item").select("k1", "k2", "id").distinct()
    which = which.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    which = which.select("k1", "k2", F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
    found = small(stage(hits.join(which, ["k1", "k2"]), "bench-found"))
    x = index.where("t < 0").select("doc_id", "k1", "k2", F.col("pos").cast("bigint").alias("n_words")).join(found, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return x.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(b""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "k1", "k2",
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without contaminated rows (see :func:`decontaminate`); all columns stay, also extra ones whose names clash
    with those here. Null and wordless texts stay, equal rows stay or go together, no rows: no rows."""
    x, back = apart(docs, "doc_id", "text")
    bad = stage(decontaminate(x, items, window, share).where("contaminated").select("k1", "k2").distinct(), "bench-bad")
    return back(_key(x).join(small(bad), ["k1", "k2"], "left_anti"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items).drop("k1", "k2")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS x FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM v),
c AS (SELECT r, s, n, list_slice(w, s, s + n - 1) AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, l WHERE len(w) >= n)),
h AS (SELECT c.r, c.s, c.n, v.item_id FROM c JOIN v ON c.n = v.n AND c.x = v.x),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r)"""

QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {"op5_decontamination": ORACLE}
