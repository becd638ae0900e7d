"""N-gram Jaccard join as a blocked sparse matrix product.

A text's set is a row of the document by shingle matrix. Rows that are equal are one class. First the product is taken
over few columns only: of each row the first columns in one global order (columns known to be frequent last, by grades, the
rest by hash), as many as two rows that link must share one of. What is frequent is learned twice, from a fixed share of the
texts and then from exact counts of the first columns, so that the pairs a row is in stay as many when the table grows. Overlaps over these columns are added up by pair, and pairs are
discarded whose overlap can't reach what their sizes call for. Columns that more than RUN rows still have add no pairs;
they tie their rows together. What is left falls into families; each family's full rows are multiplied block by block, so
a family of any size takes bounded memory and sends each row once per block, and every pair in it is decided exactly.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import apart, batches_of, small, stage, sweep
from siltstone.llm.components import components
from siltstone.llm.textkit import U, chunks, mix, powers, tidy, windows, words

SHINGLE, PERCENT = 3, 90
#: Rows of one column that are paired with one another.
RUN = 512
#: Frequent are columns that SEEN texts of one in SAMPLED have, and then those that are among the first of COMMON rows; at most
#: FREQUENT of each are broadcast. From GRADES rows on they come later still. The order changes the work, never the result.
SAMPLED, SEEN, COMMON, FREQUENT, GRADES = 16, 3, 16, 1 << 20, (512, 8192)
#: Rows exchanged at once with Python.
BATCH_ROWS = 2000
#: Rows and entries of a block of the full product.
BLOCK_ROWS, BLOCK_ENTRIES, BLOCK_COLUMNS = 1024, 1 << 21, 4096
_MASK, _TOP = U((1 << 62) - 1), U(1 << 63)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted different 62-bit hashes of the k-word shingles of each text, A-Z as a-z; a shorter text is one shingle, a
    text without words none."""
    w = words(texts, lower=True)
    h, whole = windows(w, k)
    out = []
    for i in range(len(texts)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= k:
            out.append(np.unique(h[a:b][whole[a:b]] & _MASK))
        elif b > a:
            power, _ = powers(b - a)
            out.append(mix((w.hashes[a:b] * power).sum(keepdims=True, dtype=U) + U(b - a)) & _MASK)
        else:
            out.append(np.zeros(0, U))
    return out


def _class(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


FEATURES = "k1 bigint, k2 bigint, doc_id bigint, th bigint, c bigint, n int"


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch):
                sets = shingle_sets(texts, k)
                keys = [batch.column(x).slice(a, b - a) for x in ("k1", "k2", "doc_id", "th")]
                columns = [*keys, pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FEATURES.split(", ")])

    return tidy(run)


COUNTS = "mark int, rows int"


def _marks(s: np.ndarray) -> np.ndarray:
    """32 bits of each column, by which frequent ones are listed; a column taken for another is only ordered otherwise."""
    return (s >> U(30)).astype(np.uint32)


def _counts(k: int, percent: int | None = None, frequent=None):
    """Marks of the texts' columns, or of the first ones by ``frequent``, and how many rows of a chunk have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in chunks(batch):
                sets = list({_class(s): s for s in shingle_sets(texts, k) if len(s)}.values())
                if percent is not None:
                    sets = [_first(s, percent, frequent.value) & _MASK for s in sets]
                if sets:
                    mark, rows = np.unique(_marks(np.concatenate(sets)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int32)), pa.array(rows.astype(np.int32))], names=["mark", "rows"])

    return tidy(run)


def listed(counts: DataFrame, least: int, share: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted marks of at most FREQUENT columns of ``least`` rows or more, the most frequent ones, and their grades if one row
    stands for ``share``."""
    counts = stage(counts.groupBy("mark").agg(F.sum("rows").alias("n")).where(F.col("n") >= least), "jaccard-columns")
    below, seen = 1 << 62, 0
    step = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int").alias("b")
    for _, n, low in sorted(map(tuple, counts.groupBy(step).agg(F.count("*"), F.min("n")).collect()), reverse=True):
        seen += n
        if seen > FREQUENT:
            break
        below = low
    grade = F.lit(1) + sum(F.when(F.col("n") * share >= g, 1).otherwise(0) for g in GRADES)
    got = counts.where(F.col("n") >= below).select("mark", grade.cast("tinyint").alias("grade")).toArrow()
    mark = got.column("mark").to_numpy().view(np.uint32)
    order = np.argsort(mark)
    return mark[order], got.column("grade").to_numpy()[order].astype(np.uint8)


def _both(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists as one, with the higher grade of a mark in both."""
    mark, place = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    grade = np.zeros(len(mark), np.uint8)
    np.maximum.at(grade, place, np.concatenate([x[1], y[1]]))
    return mark, grade


def frequent_columns(texts: DataFrame, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks and grades of frequent columns. ``texts``: th, text. A fixed share of the different texts shows the columns of
    about SAMPLED * SEEN rows or more; among the first columns by that list those of COMMON rows are counted exactly."""
    few = texts.where(F.pmod("th", F.lit(SAMPLED)) == 0).dropDuplicates(["th"]).select("text")
    sampled = listed(few.mapInArrow(_counts(k), COUNTS), SEEN, SAMPLED)
    held = texts.sparkSession.sparkContext.broadcast(sampled)
    found = listed(texts.select("text").mapInArrow(_counts(k, percent, held), COUNTS), COMMON)
    return _both(sampled, found)


def _first(s: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first columns of a set in the order of all columns, with the grade above their 62 bits."""
    mark, grade = frequent
    if len(mark):
        own = _marks(s)
        at = np.minimum(np.searchsorted(mark, own), len(mark) - 1)
        s = s | np.where(mark[at] == own, grade[at], 0).astype(U) << U(62)
    m = prefix(len(s), percent)
    return np.sort(np.partition(s, m - 1)[:m]) if m < len(s) else np.sort(s)


def prefix(n: int, percent: int) -> int:
    """Two sets that link, one of size n, share one of its first so many columns."""
    return n - -(-percent * n // 100) + 1


POSTINGS = "key bigint, n int, c bigint, last bigint"


def _postings(k: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()
            for _, _, texts in chunks(batch):
                out: list[tuple[np.ndarray, int, int]] = []
                for s in shingle_sets(texts, k):
                    if not len(s) or (c := _class(s)) in done:
                        continue
                    done.add(c)
                    out.append((_first(s, percent, frequent.value), len(s), c))
                if out:
                    m = [len(x[0]) for x in out]
                    last = np.array([x[0][-1] for x in out], U) ^ _TOP  # signed numbers in the order of columns
                    columns = [
                        pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), pa.array(np.repeat([x[1] for x in out], m).astype(np.int32)),
                        pa.array(np.repeat(np.array([x[2] for x in out], np.int64), m)), pa.array(np.repeat(last.view(np.int64), m)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "c", "last"])

    return tidy(run)


PAIRS = "u bigint, v bigint, need int"


def _pairs(percent: int, most: int):
    """Rows by (key, n, c): of each key the pairs of classes near in size with the number of first columns they must
    share, or for more than ``most`` rows ties (of 0) of each row to the first of those it may be near to. No more than
    ``most`` rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAIRS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32()]
        held: list[tuple] = []
        key = before = start = None
        over = False
        out: list[tuple] = []

        def ties(row: tuple) -> None:
            nonlocal before, start
            if before is None or 100 * before[0] < percent * row[0]:
                start = row
            elif start[1] != row[1]:
                out.append((min(start[1], row[1]), max(start[1], row[1]), 0))
            before = row

        def pairs() -> None:
            for i, x in enumerate(held):
                for y in held[i + 1 :]:
                    if 100 * x[0] < percent * y[0]:
                        break
                    size = x[0] if x[2] <= y[2] else y[0]  # of the one whose first columns end first
                    need = -(-percent * (x[0] + y[0]) // (100 + percent)) - size + prefix(size, percent)
                    out.append((min(x[1], y[1]), max(x[1], y[1]), max(1, need)))

        for batch in batches:
            keys = batch.column("key").to_numpy()
            n = len(keys)
            if not n:
                continue
            alone = np.ones(n, bool)  # rows whose key has no other row, as most have
            same = keys[1:] == keys[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            alone[[0, -1]] = False
            rest = np.flatnonzero(~alone)
            columns = [batch.column(c).to_numpy()[rest].tolist() for c in ("n", "c", "last")]
            for k, row in zip(keys[rest].tolist(), zip(*columns)):
                if k != key:
                    if not over:
                        pairs()
                    held, key, over, before = [], k, False, None
                if held and held[-1][1] == row[1] or over and before[1] == row[1]:
                    continue
                if not over and len(held) == most:
                    over = True
                    for x in held:
                        ties(x)
                    held = []
                if over:
                    ties(row)
                else:
                    held.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out.clear()
        if not over:
            pairs()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return tidy(run)


def candidates(postings: DataFrame, percent: int, run_rows: int = RUN) -> DataFrame:
    """Pairs of classes (u, v) that may link by the overlap over their first columns, and ties."""
    rows = postings.repartition("key").sortWithinPartitions("key", "n", "c").mapInArrow(_pairs(percent, run_rows), PAIRS)
    return rows.groupBy("u", "v").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("u", "v")


MEMBER = "f bigint, c bigint, copies bigint, b int, blocks int, entries binary"


def _sets(k: int):
    """Whole rows of family members, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEMBER.split(", ")]
        for batch in batches:
            own = batch.column("c").to_pylist()
            first = pa.array(sorted({c: i for i, c in reversed(list(enumerate(own)))}.values()), pa.int64())
            batch = batch.take(first)
            for a, b, texts in chunks(batch):
                columns = [batch.column(x).slice(a, b - a) for x in names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())], names=names)

    return tidy(run)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of left with right sets, or with one another: products over columns that at least two
    sets have, BLOCK_COLUMNS at a time."""
    every = left + (right or [])
    entries = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, column, count = np.unique(entries, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    m = len(left)
    total = np.zeros((m, len(right) if right else m), np.float64)
    width = int(shared.sum())
    for a in range(0, width, BLOCK_COLUMNS):
        i, j = np.searchsorted(column, [a, a + BLOCK_COLUMNS])
        block = np.zeros((len(every), min(BLOCK_COLUMNS, width - a)), np.float32)
        block[row[i:j], column[i:j] - a] = 1
        total += block[:m] @ block[m if right else 0 :].T
    return total.astype(np.int64)


LINKS = "c bigint, root bigint, links bigint"


def _decide(percent: int):
    """Rows by (f, i, j, side, c): for each block pair the rows' least reachable row and number of linked documents."""

    def decide(rows: list[tuple]) -> list[tuple]:
        left = [r for r in rows if r[0] == 0]
        right = [r for r in rows if r[0] == 1]
        sets = [[np.frombuffer(r[3], U) for r in side] for side in (left, right)]
        if len(rows) < 2 or not left:
            return []
        cross = bool(right)
        both = overlaps(sets[0], sets[1] if cross else None)
        size = [np.array([len(s) for s in x], np.int64) for x in sets]
        near = 100 * both >= percent * (size[0][:, None] + (size[1] if cross else size[0])[None, :] - both)
        if not cross:
            np.fill_diagonal(near, False)
        weight = [np.array([r[2] for r in x], np.int64) for x in (left, right)]
        c = np.array([r[1] for r in rows], np.int64)
        count = np.concatenate([near @ weight[1], near.T @ weight[0]]) if cross else near @ weight[0]
        if cross:
            m = len(left)
            full = np.zeros((len(rows), len(rows)), bool)
            full[:m, m:], full[m:, :m] = near, near.T
            near = full
        root = c.copy()
        while True:
            reach = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
            if (reach == root).all():
                break
            root = reach
        return [(int(x), int(r), int(n)) for x, r, n in zip(c, root, count) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["c", "root", "links"])
        for batch in batches:
            for f, i, j, side, c, copies, entries in zip(*(batch.column(x).to_pylist() for x in ("f", "i", "j", "side", "c", "copies", "entries"))):
                if (f, i, j) != key:
                    out += decide(rows)
                    key, rows = (f, i, j), []
                if not rows or rows[-1][:2] != (side, c):
                    rows.append((side, c, copies, entries))
            if len(out) > 10_000:
                yield flush()
                out = []
        out += decide(rows)
        if out:
            yield flush()

    return tidy(run)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with k1 and k2, which tell different (doc_id, text) apart."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "k2": F.xxhash64(F.col("text"), F.col("doc_id").isNull())})


def link_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, run_rows: int = RUN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links, k1, k2, root (tells components apart,
    also those whose least doc_id is the same).

    Two documents link if their sets' Jaccard similarity is at least percent / 100. component_id is the least doc_id
    reachable by links, its own included; n_links is the number of linked other rows. Null or wordless text: no shingle,
    no link. Rows of equal doc_id are rows of their own; a null doc_id is never a component's id unless all are null.
    Equal rows get equal results. No rows: no rows."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _link_components(docs, k, percent, run_rows, block_rows)


def _link_components(docs: DataFrame, k: int, percent: int, run_rows: int, block_rows: int) -> DataFrame:
    spark = docs.sparkSession
    x = _keyed(docs.select("doc_id", "text")).withColumn("th", F.xxhash64("text"))
    features = stage(x.select("k1", "k2", F.col("doc_id").cast("bigint").alias("doc_id"), "th", "text").mapInArrow(_features(k), FEATURES), "jaccard-features")
    classes = stage(features.where("n > 0").groupBy("c", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("th").alias("th")), "jaccard-classes")
    late = spark.sparkContext.broadcast(frequent_columns(x.select("th", "text"), k, percent))
    sweep(spark)
    postings = docs.select("text").mapInArrow(_postings(k, percent, late), POSTINGS)
    pairs = stage(candidates(postings, percent, run_rows), "jaccard-candidates")
    sweep(spark)
    family = components(pairs)
    members = family.select(F.col("node").alias("c"), F.col("root").alias("f")).union(family.select(F.col("root").alias("c"), F.col("root").alias("f")).distinct())
    members = stage(members.join(classes, "c"), "jaccard-members")
    blocks = members.groupBy("f").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / BLOCK_ENTRIES)).cast("int").alias("blocks"))
    members = members.join(blocks, "f").withColumn("b", F.pmod("c", "blocks").cast("int"))
    members = small(stage(members.select("th", "f", "c", "copies", "b", "blocks"), "jaccard-wanted"))
    full = x.join(members, "th").select("f", "c", "copies", "b", "blocks", "text").mapInArrow(_sets(k), MEMBER)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    full = full.select("c", "f", "copies", "entries", "b", other)
    full = full.select("f", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "c", "copies", "entries")
    found = full.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j", "side", "c").mapInArrow(_decide(percent), LINKS)
    found = stage(found, "jaccard-links")
    sweep(spark)
    root = components(found.select(F.col("c").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links")).join(root, F.col("c") == F.col("node"), "left").select("c", "links", F.coalesce("root", "c").alias("root"))
    linked = stage(counts.join(classes, "c"), "jaccard-linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(least, "root").select("c", "n", "component", "links", "root")
    of = classes.where("copies > 1").select("c", "n", "first", "copies").join(linked, ["c", "n"], "full")
    of = small(stage(of.select("c", "n", F.coalesce("component", "first").alias("component"), F.coalesce("root", "c").alias("root"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links")), "jaccard-components"))
    own = features.select("doc_id", "k1", "k2", "c", "n").join(of, ["c", "n"], "left")
    return own.select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), "k1", "k2", F.coalesce("root", "c").alias("root"),
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of linked ones, the one of least doc_id; all columns stay. Of rows with
    that doc_id one stays. Documents without words stay."""
    x, back = apart(docs, "doc_id", "text")
    keys = stage(link_components(x, k, percent), "jaccard-keep")
    of_own = F.col("component_id").eqNullSafe(F.col("doc_id"))
    drop = small(stage(keys.where(~of_own).select("k1", "k2").distinct(), "jaccard-drop"))
    out = _keyed(x).join(drop, ["k1", "k2"], "left_anti")
    first = keys.where(of_own & (F.col("n_shingles") > 0))
    twice = stage(first.groupBy("root").agg(F.count("*").alias("n"), F.collect_set(F.struct("k1", "k2")).alias("of")).where("n > 1"), "jaccard-twice")
    if not twice.isEmpty():  # several rows of one doc_id link to one another
        twice = twice.select(F.monotonically_increasing_id().alias("g"), F.explode("of").alias("k")).select("g", "k.k1", "k.k2")
        marked = out.join(small(stage(twice, "jaccard-rows")), ["k1", "k2"], "left")
        out = marked.where("g is null").drop("g").unionByName(marked.where("g is not null").dropDuplicates(["g"]).drop("g"))
    return back(out)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("k1", "k2", "root")


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 2), ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS cut FROM s AS a JOIN s AS b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT u, v FROM p JOIN n AS a ON a.r = u JOIN n AS b ON b.r = v WHERE 100 * cut >= 90 * (a.n + b.n - cut)),
c AS (SELECT r AS node, r AS reach FROM n UNION SELECT c.node, l.v FROM c JOIN l ON c.reach = l.u),
m AS (SELECT node, min(doc_id) AS component FROM c JOIN d ON d.r = c.reach GROUP BY node),
k AS (SELECT u, count(*) AS links FROM l GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(k.links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (r) LEFT JOIN m ON m.node = d.r LEFT JOIN k ON k.u = d.r"""

QUERIES = {"op6_jaccard": op6_jaccard}
ORACLES = {"op6_jaccard": ORACLE}
