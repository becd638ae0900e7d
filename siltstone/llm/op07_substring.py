"""Substring dedup by recompression.

Every text is parsed in ROUNDS rounds: runs of one symbol get a name, then each pair of a left and a right symbol gets
one. Names and sides are hashes of what they stand for, so the naming is global without a table, and whether two symbols
pair depends on these two alone: inside equal passages all texts have the same symbols, but for a few at the ends. Each
window of WINDOW words is represented by the least symbol that its own words determine. A symbol that no other text has
rules its windows out; windows of shared symbols are verified by hashes of all their words.

Both searches are one shuffle each. Before it, a batch of texts settles among itself: of all rows with one name only
those of its smallest document go out, so a passage that very many documents share sends a row per batch, not per
document. After it rows of one name stream by in order; only the first document of each is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import small, stage
from siltstone.llm.textkit import U, Words, chunks, mix, sums, windows, words

WINDOW = 13
ROUNDS = 2
#: Bytes of text that settle among themselves.
BATCH = 4 << 20
_RUN, _PAIR, _SPREAD = U(0xD1B54A32D192ED03), U(0xABC98388FB8FAC03), U(0x8CB92BA72F3D8DD7)


class Symbols:
    """Symbols over the words of several texts: names, first and last word, and the text of each."""

    def __init__(self, names: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray):
        self.names, self.first, self.last, self.doc = names, first, last, doc

    def compress(self, number: int) -> Symbols:
        """One round: maximal runs, then pairs. A symbol's side is that of what it repeats, whatever the run's length."""
        if not len(self.names):
            return self
        new = np.concatenate([[True], (self.names[1:] != self.names[:-1]) | (self.doc[1:] != self.doc[:-1])])
        at = np.flatnonzero(new)
        length = np.diff(np.concatenate([at, [len(new)]]))
        base, first, last, doc = self.names[at], self.first[at], self.last[at + length - 1], self.doc[at]
        names = np.where(length > 1, mix(base ^ (length.astype(U) * _RUN)), base)
        right = (base >> U(20 + number) & U(1)).astype(bool)
        pair = np.zeros(len(at), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1])
        i = np.flatnonzero(pair)
        names[i] = mix(names[i] * _PAIR + names[i + 1])
        last[i] = last[i + 1]
        keep = np.ones(len(at), bool)
        keep[i + 1] = False
        return Symbols(names[keep], first[keep], last[keep], doc[keep])


def parse(w: Words, rounds: int = ROUNDS) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Symbols of the last round and the words, from low to high, that determine each: its own, and in every round the
    neighbour on either side. At the ends of a text that reaches beyond it."""
    n = len(w.hashes)
    doc = np.repeat(np.arange(len(w.first) - 1), w.counts())
    now = Symbols(w.hashes, np.arange(n), np.arange(n), doc)
    low, high = np.arange(n), np.arange(n)
    for r in range(rounds if n else 0):
        before, now = now, now.compress(r)
        same = now.doc[1:] == now.doc[:-1]
        previous = np.searchsorted(before.first, now.first) - 1
        following = np.searchsorted(before.last, now.last, side="right")
        low = np.where(np.concatenate([[False], same]), low[np.maximum(previous, 0)], now.first - 1)
        high = np.where(np.concatenate([same, [False]]), high[np.minimum(following, len(high) - 1)], now.last + 1)
    return now, low, high


def representatives(w: Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, the key of each one's symbol (the words that determine it, hashed), and whether it has
    one. The key is a function of the window's words alone."""
    n = len(w.hashes)
    left = np.repeat(w.first[1:], w.counts()) - np.arange(n)
    at = np.flatnonzero(left >= window)
    symbols, low, high = parse(w, rounds)
    if not len(at) or not len(low):
        return at, np.zeros(len(at), U), np.zeros(len(at), bool)
    a, b = np.maximum(low, 0), np.minimum(high + 1, n)
    before, through, inverse = sums(w.hashes, [a, b])
    keys = mix((through - before) * inverse + (symbols.names ^ (b - a).astype(U)))
    rank = mix(keys * _SPREAD)
    p = np.searchsorted(low, at)
    q = np.searchsorted(high, at + window - 1, side="right")
    has = p < q
    best = np.minimum(p, len(low) - 1)
    for k in range(1, int((q - p).max(initial=0))):
        other = np.minimum(p + k, len(low) - 1)
        best = np.where((p + k < q) & (rank[other] < rank[best]), other, best)
    return at, keys[best], has


def _settle(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows (name, doc): the smallest doc among the rows of a name, and whether several docs have it."""
    _, group = np.unique(name, return_inverse=True)
    n = int(group.max(initial=-1)) + 1
    least = np.full(n, np.iinfo(np.int64).max)
    most = np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, group, doc)
    np.maximum.at(most, group, doc)
    return least[group], (least < most)[group], group


#: p deals rows: the name, or for settled ones anything. Of one p, rows come by doc.
ROW = "p bigint, settled boolean, doc bigint, k bigint, pos int"
_NAMES = ["p", "settled", "doc", "k", "pos"]


def _rows(p: np.ndarray, settled: np.ndarray, doc: np.ndarray, k: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = [pa.array(p.view(np.int64)), pa.array(settled), pa.array(doc), pa.array(k), pa.array(pos.astype(np.int32))]
    yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _symbol_rows(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ks = batch.column("doc").to_numpy(), batch.column("k").to_numpy()
            for a, b, texts in chunks(batch, size=BATCH):
                w = words(texts)
                at, keys, has = representatives(w, window, rounds)
                of = np.searchsorted(w.first, at, side="right") - 1
                # one row for each text and symbol; a window without one stays a row of its own, settled as shared
                code = mix(keys ^ of.astype(U) * _PAIR)
                _, one = np.unique(code[has], return_index=True)
                one = np.flatnonzero(has)[one]
                doc, k, name = docs[a:b][of[one]], ks[a:b][of[one]], keys[one]
                _, several, _ = _settle(name, doc)
                least = _settle(name, doc)[0]
                out = several & (doc > least)
                pos = at[one] - w.first[of[one]]
                yield from _rows(np.where(out, mix(name ^ U(1) * doc.astype(U)), name), several, doc, k, pos)
                bare = np.unique(of[~has])
                if len(bare):
                    yield from _rows(mix(bare.astype(U)), np.ones(len(bare), bool), docs[a:b][bare], ks[a:b][bare], np.full(len(bare), -1))

    return run


def _shared(batches: Iterator[pa.RecordBatch], smaller_only: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (p, doc): those that are settled, those of a p with several docs, or with ``smaller_only`` of
    these not the ones of its first doc. Between batches only rows of the last p's first doc are kept."""
    names = ("doc", "k", "pos")
    last_p = last_first = None
    kept = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]
    for batch in batches:
        if not batch.num_rows:
            continue
        p, settled, *own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "settled", *names))
        goes_on = last_p is not None and p[0] == last_p
        if goes_on and len(kept[0]):
            n = len(kept[0])
            p, settled = np.concatenate([np.full(n, last_p), p]), np.concatenate([np.zeros(n, bool), settled])
            own = [np.concatenate(x) for x in zip(kept, own)]
        doc = own[0]
        new = np.concatenate([[True], p[1:] != p[:-1]])
        group = np.cumsum(new) - 1
        first = doc[new]
        if goes_on:
            first[0] = last_first
        out = doc > first[group]
        if not smaller_only:
            out = (np.bincount(group, out, len(first)) > 0)[group]
        out |= settled
        wait = (group == group[-1]) & ~out & (not smaller_only)
        last_p, last_first, kept = p[-1], first[-1], [x[wait] for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in own], names=list(names))


def _match(smaller_only: bool):
    return lambda batches: _shared(batches, smaller_only)


def _window_rows(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ks, marks = batch.column("doc").to_numpy(), batch.column("k").to_numpy(), batch.column("marks")
            for a, b, texts in chunks(batch, size=BATCH):
                w = words(texts)
                at, keys, has = representatives(w, window, rounds)
                hashes, _ = windows(w, window)
                of = np.searchsorted(w.first, at, side="right") - 1
                own = marks.slice(a, b - a)
                flat = own.flatten().to_numpy(zero_copy_only=False)
                sizes = np.asarray(own.value_lengths().fill_null(0))
                row = np.repeat(np.arange(b - a), sizes)
                real = flat >= 0
                code = lambda d, k: mix(k ^ d.astype(U) * _PAIR)
                place = w.first[row[real]] + flat[real]
                marked = keys[np.searchsorted(at, place)]
                wanted = np.unique(code(row[real], marked))
                chosen = ~has
                if len(wanted):
                    mine = code(of, keys)
                    i = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                    chosen |= wanted[i] == mine
                at, of, name = at[chosen], of[chosen], hashes[at[chosen]]
                doc, k = docs[a:b][of], ks[a:b][of]
                least = _settle(name, doc)[0]
                settled = doc > least
                yield from _rows(np.where(settled, mix(name ^ doc.astype(U)), name), settled, doc, k, at - w.first[of])

    return run


def covered_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc, k, text; doc not null; k tells texts of one doc apart) to staged rows (doc, k, at): ascending first
    words of the windows that also start in a smaller doc."""
    x = docs.select("doc", "k", "text")
    rows = x.mapInArrow(_symbol_rows(window, rounds), ROW).repartition("p").sortWithinPartitions("p", "doc")
    shared = rows.mapInArrow(_match(False), "doc bigint, k bigint, pos int")
    marks = stage(shared.groupBy("doc", "k").agg(F.collect_list("pos").alias("marks")), "substring-symbols")
    rows = x.join(marks, ["doc", "k"]).mapInArrow(_window_rows(window, rounds), ROW).repartition("p").sortWithinPartitions("p", "doc")
    found = rows.mapInArrow(_match(True), "doc bigint, k bigint, pos int")
    return stage(found.groupBy("doc", "k").agg(F.sort_array(F.collect_list("pos")).alias("at")), "substring-windows")


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("at")
            copies = batch.column("copy").to_pylist()
            for a, b, texts in chunks(batch):
                w = words(texts)
                sizes = w.counts()
                gone = np.zeros(len(w.hashes) + 1, np.int64)
                own = starts.slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.asarray(own.value_lengths().fill_null(0)))
                place = w.first[row] + own.flatten().to_numpy(zero_copy_only=False)
                np.add.at(gone, place, 1)
                np.add.at(gone, place + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = []
                for i in range(b - a):
                    s, e = w.first[i], w.first[i + 1]
                    if copies[a + i] and e - s >= window:
                        gone[s:e] = True
                    if gone[s:e].any():
                        kept.append(b" ".join(w.buffer[w.starts[j] : w.ends[j]] for j in np.flatnonzero(~gone[s:e]) + s))
                    else:
                        kept.append(b" ".join(texts[i].split()))
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first]) if len(w.hashes) else np.zeros(b - a, np.int64)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed and kept, the words joined by one space that
    no window covers whose words also start in a document of smaller doc_id.

    Copies of a whole text are found first and not searched again. Null text has no words. A null doc_id comes after
    all others, rows of equal doc_id don't count against one another, and equal rows get equal results. A text of less
    than a window keeps its words. No rows: no rows."""
    last = F.lit((1 << 63) - 1)
    x = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), last).alias("doc"), F.xxhash64("text").alias("k"))
    twin = F.xxhash64(F.reverse("text"), F.octet_length("text"))
    groups = x.where(F.col("text").isNotNull()).groupBy("k", twin.alias("k2")).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    copies = stage(groups.where("least < most").select(F.col("k").alias("__k"), F.col("k2").alias("__k2"), "least"), "substring-copies")
    x = x.join(small(copies), (F.col("k") == F.col("__k")) & (twin == F.col("__k2")), "left")
    x = x.withColumn("copy", F.coalesce(F.col("doc") > F.col("least"), F.lit(False))).select("doc_id", "text", "doc", "k", "copy")
    at = covered_windows(x.where(~F.col("copy")).dropDuplicates(["doc", "k"]) if _repeats(docs) else x.where(~F.col("copy")), window, rounds)
    return x.join(at, ["doc", "k"], "left").select("doc_id", "text", "copy", "at").mapInArrow(_remove(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id comes twice or is null: only then must equal rows be put together first."""
    r = docs.groupBy("doc_id").count().agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
    return (r[0] or 0) > 1 or r[1] > 0


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return x.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, o, s, list_slice(w, s, s + 12) AS x FROM (SELECT r, o, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
m AS (SELECT x, min(o) AS first FROM s GROUP BY x),
c AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS i FROM s JOIN m USING (x) WHERE first < o),
k AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

QUERIES = {"op7_substring": op7_substring}
ORACLES = {"op7_substring": ORACLE}
