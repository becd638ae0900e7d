"""Language-model scores by deleted interpolation.

All words and all pairs of adjacent words are counted over all training documents, in two parts: maximum-likelihood
estimates of the first (bigram, unigram, uniform) are mixed by weights that depend on how frequent the context is, and
expectation-maximisation finds the weights that make the second, deleted part most likely. Final estimates use both
parts. The model is a proper distribution over all words seen and one more that stands for any other.

Documents are taken in chunks of about TOKENS tokens. A chunk sends its different words and pairs, dealt by hash, to
buckets; a bucket adds up what all chunks sent and answers each with the totals of what it sent. A word or pair, however
frequent, is one entry a chunk, so no bucket is larger than others. Only the cells of EM come to the driver: buckets of
contexts by quarter octaves of the estimates, with their means.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import crc_fold, stage
from siltstone.llm.textkit import U, Words, chunks, mix, tidy, words

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Tokens of a chunk, about; a longer text is a chunk of its own.
TOKENS = 1 << 21
#: Words or pairs that a bucket has about, counted a chunk each. A task holds one bucket, what all chunks have in it, so the
#: number of buckets grows with the input.
ENTRIES = 1 << 19
_ZSTD = pa.Codec("zstd", compression_level=5)
#: Cells of EM an octave of an estimate.
STEPS = 4
#: Words and pairs are told apart by the upper 56 bits of their hashes.
_KEPT = ~U(0xFF)
END = U(0x5EED0FE4D0C50000)
CHUNK = "chunk bigint, doc_id array<bigint>, held_out array<boolean>, deleted array<boolean>, lengths array<int>, n_train bigint, n_deleted bigint, n_words int, words binary, seen binary, ids binary"
SENT = "bucket int, chunk bigint, size int, keys binary, counts binary"
TOTALS = "bucket int, chunk bigint, size int, kinds bigint, counts binary"
RESOLVED = "doc_id array<bigint>, held_out array<boolean>, lengths array<int>, kinds bigint, words binary, pairs binary, cells array<bigint>, events array<bigint>, bigrams array<double>, unigrams array<double>"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [x.split()[1] for x in schema.split(", ")]
    types = [pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t] for t in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_names(schema))


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end, and the text of each token."""
    n, d = len(w.hashes), len(w.first) - 1
    doc = np.repeat(np.arange(d), w.counts())
    out, of = np.empty(n + d, U), np.empty(n + d, np.int64)
    at = np.arange(n) + doc
    ends = w.first[1:] + np.arange(d)
    out[at], out[ends] = w.hashes & _KEPT, END
    of[at], of[ends] = doc, np.arange(d)
    return out, of


def _pack(x: np.ndarray, plain: int = 0) -> bytes:
    """Integers from 0 by planes of bytes, compressed but for the ``plain`` lowest."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    return planes[:plain].tobytes() + _ZSTD.compress(planes[plain:].tobytes(), asbytes=True)


def _unpack(data: bytes, n: int, plain: int = 0, kind=np.int64) -> np.ndarray:
    rest = _ZSTD.decompress(data[plain * n :], (8 - plain) * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data[: plain * n] + rest, np.uint8).reshape(8, n).T).view(kind).reshape(n)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes, as differences of what is kept of them."""
    return _pack(np.diff(keys >> U(8), prepend=U(0)), 4)


def _unpack_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, 4, U), dtype=U) << U(8)


def _pack_counts(n: np.ndarray, d: np.ndarray) -> bytes:
    """Counts and those of the deleted part among them: a byte for both, and what doesn't fit behind."""
    big = n > 14
    return int(big.sum()).to_bytes(4, "little") + _pack(np.concatenate([np.where(big, 255, n * 16 + d), n[big], d[big]]))


def _unpack_counts(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    more = int.from_bytes(data[:4], "little")
    x = _unpack(data[4:], size + 2 * more)
    n, d, big = x[:size] >> 4, x[:size] & 15, x[:size] == 255
    n[big], d[big] = x[size : size + more], x[size + more :]
    return n, d


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each token of a chunk and the one before it; a text's first follows an end."""
    return mix(np.roll(h, 1) * U(0x9E3779B97F4A7C15) + h) & _KEPT


@tidy
def _make_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: list[tuple[np.ndarray, np.ndarray, list, list, list]] = []

    def out() -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        lengths = np.concatenate([x[1] for x in held])
        ids, out_of, deleted = ([v for x in held for v in x[i]] for i in (2, 3, 4))
        keys, at, seen = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-seen, kind="stable")] = np.arange(len(keys))
        train = int(lengths[~np.array(out_of, bool)].sum())
        return _batch(CHUNK, [[x] for x in (number, ids, out_of, deleted, lengths, train, int(lengths[np.array(deleted, bool)].sum()), len(keys), _pack_keys(keys), _pack(seen), _pack(rank[at]))])

    size = 0
    for batch in batches:
        for a, b, texts in chunks(batch):
            w = words(texts, lower=True)
            held.append((_tokens(w)[0], w.counts() + 1, *(batch.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "held_out", "deleted"))))
            size += len(held[-1][0])
            if size >= TOKENS:
                yield out()
                held, size, number = [], 0, number + 1
    if held:
        yield out()


class Chunk:
    """Words of a chunk in the order of their hashes, and the places of its tokens and pairs among its own."""

    def __init__(self, row: dict):
        n = row["n_words"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.words = _unpack_keys(row["words"], n)
        order = np.argsort(-_unpack(row["seen"], n), kind="stable")
        self.word_at = order[_unpack(row["ids"], int(self.lengths.sum()))]
        self.pairs, self.pair_at = np.unique(_pairs(self.words[self.word_at]), return_inverse=True)
        self.deleted = np.repeat(np.array(row["deleted"], bool), self.lengths)
        self.train = np.repeat(~np.array(row["held_out"], bool), self.lengths)


def buckets_for(entries: int) -> int:
    """A power of two, 16 at least."""
    return max(16, 1 << max(0, (entries - 1) // ENTRIES).bit_length())


def _send(word_buckets: int, pair_buckets: int):
    """Words go to the buckets from 0, pairs to those after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                for keys, at, buckets, first in ((c.words, c.word_at, word_buckets, 0), (c.pairs, c.pair_at, pair_buckets, word_buckets)):
                    n, d = (np.bincount(at[x], minlength=len(keys)).astype(np.int64) for x in (c.train, c.deleted))
                    edge = np.searchsorted(keys >> U(65 - buckets.bit_length()), np.arange(buckets + 1).astype(U))
                    cuts = [(i, a, b) for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if a < b]
                    yield _batch(SENT, [
                        [first + i for i, _, _ in cuts], [row["chunk"]] * len(cuts), [b - a for _, a, b in cuts],
                        [_pack_keys(keys[a:b]) for _, a, b in cuts], [_pack_counts(n[a:b], d[a:b]) for _, a, b in cuts],
                    ])

    return tidy(run)


def _total(word_buckets: int):
    """Answers of a bucket to all chunks; its number of different trained words goes with the first."""

    def run(sent: pa.Table) -> pa.Table:
        rows = sent.to_pydict()
        sizes = rows["size"]
        keys, at = np.unique(np.concatenate([_unpack_keys(x, s) for x, s in zip(rows["keys"], sizes)]), return_inverse=True)
        n, d = (np.bincount(at, np.concatenate(x), len(keys)).astype(np.int64) for x in zip(*map(_unpack_counts, rows["counts"], sizes)))
        bucket = rows["bucket"][0]
        kinds = [int((n > 0).sum()) if bucket < word_buckets else 0, *[0] * (len(sizes) - 1)]
        places = np.split(at, np.cumsum(sizes)[:-1])
        return pa.Table.from_batches([_batch(TOTALS, [rows["bucket"], rows["chunk"], sizes, kinds, [_pack_counts(n[p], d[p]) for p in places]])])

    return run


def octave(n: np.ndarray) -> np.ndarray:
    """0 for contexts that never come, else one more than the octave of their count."""
    return np.where(n > 0, 1 + np.log2(np.maximum(n, 1)).astype(int), 0)


def _cells(pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Cells of tokens of the deleted part by what the kept part has of them, the tokens in each, and sums of the logarithms
    of pair / context and of word."""
    x, y = np.log2(np.maximum(pair, 1) / np.maximum(context, 1)), np.log2(np.maximum(word, 1))
    i, j = np.where(pair > 0, 1 + np.floor(-x * STEPS), 0), np.where(word > 0, 1 + np.floor(y * STEPS), 0)
    code = ((octave(context) * 64 * STEPS + i) * 64 * STEPS + j).astype(np.int64)
    codes, at = np.unique(code, return_inverse=True)
    return [codes, np.bincount(at, minlength=len(codes)), np.bincount(at, x, len(codes)), np.bincount(at, y, len(codes))]


def _resolve(word_buckets: int):
    """Counts of each token of a chunk and of its pair, and the cells of its deleted tokens."""

    def run(totals: pa.Table, own: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        c = Chunk(row)
        sent = sorted(totals.to_pylist(), key=lambda x: x["bucket"])
        counts = []
        for side, keys in ((False, c.words), (True, c.pairs)):
            mine = [x for x in sent if (x["bucket"] >= word_buckets) == side]
            n, d = map(np.concatenate, zip(*(_unpack_counts(x["counts"], x["size"]) for x in mine)))
            if len(n) != len(keys):
                raise ValueError("answers don't match the chunk")
            counts += [n, d]
        word, word_d, pair, pair_d = counts[0][c.word_at], counts[1][c.word_at], counts[2][c.pair_at], counts[3][c.pair_at]
        kept = word - word_d
        cells = _cells((pair - pair_d)[c.deleted], np.roll(kept, 1)[c.deleted], kept[c.deleted])
        return pa.Table.from_batches([_batch(RESOLVED, [[x] for x in (row["doc_id"], row["held_out"], row["lengths"], sum(x["kinds"] for x in sent), _pack(word), _pack(pair), *cells)])])

    return run


def fit_weights(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (64, 3) of bigram, unigram and uniform estimates ``p`` under which ``n`` deleted tokens of each row are most
    likely. Frequencies without any take the weights of the next lower."""
    weights = np.full((64, 3), 1 / 3)
    if len(n):
        for _ in range(rounds):
            share = p * weights[bucket]
            share *= (n / share.sum(1))[:, None]
            new = np.stack([np.bincount(bucket, share[:, i], 64) for i in range(3)], 1) + 1e-3
            weights = new / new.sum(1, keepdims=True)
        there = np.bincount(bucket, n, 64) > 0
        for i in range(2, 64):
            if not there[i]:
                weights[i] = weights[i - 1]
    weights[0] = (0, weights[0][1:].sum() and weights[0][1] / weights[0][1:].sum(), 0)  # contexts never seen have no bigrams
    weights[0][2] = 1 - weights[0][1]
    return weights


class Model:
    """The same model from dense counts (context, word) of a small vocabulary, whole in memory."""

    def __init__(self, kept: np.ndarray, deleted: np.ndarray, rounds: int = 30):
        k = len(kept)
        parts, bucket = self._parts(kept), octave(kept.sum(1))
        ctx, w = np.nonzero(deleted)
        p = np.stack([parts[0][ctx, w], parts[1][w], np.full(len(w), 1 / k)], 1)
        self.weights = weights = fit_weights(bucket[ctx], p, deleted[ctx, w].astype(float), rounds)
        total = kept + deleted
        b = octave(total.sum(1))
        bigram, unigram = self._parts(total)
        mixed = weights[b][:, :1] * bigram + weights[b][:, 1:2] * unigram[None, :] + weights[b][:, 2:] / k
        if not total.any():
            mixed = np.full((k, k), 1 / k)
        self.logs = np.log10(mixed / mixed.sum(1, keepdims=True))

    @staticmethod
    def _parts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = counts.sum(1, keepdims=True)
        return counts / np.maximum(n, 1), counts.sum(0) / max(1, n.sum())


def fit(resolved: DataFrame, kept: int, kinds: int) -> np.ndarray:
    """Weights from the cells of all chunks; ``kept`` tokens and ``kinds`` different words."""
    each = resolved.select(F.explode(F.arrays_zip("cells", "events", "bigrams", "unigrams")).alias("c")).select("c.*")
    t = each.groupBy("cells").agg(*(F.sum(c).alias(c) for c in ("events", "bigrams", "unigrams"))).orderBy("cells").toArrow()
    code, n, x, y = (t.column(i).to_numpy() for i in range(4))
    side = 64 * STEPS
    n = n.astype(float)
    bigram = np.where(code // side % side > 0, 2.0 ** (x / n), 0.0)
    unigram = np.where(code % side > 0, 2.0 ** (y / n) / max(1, kept), 0.0)
    return fit_weights(code // side**2, np.stack([bigram, unigram, np.full(len(n), 1 / (kinds + 1))], 1), n)


def _score(weights: np.ndarray, tokens: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                docs, size = len(lengths), int(lengths.sum())
                of = np.repeat(np.arange(docs), lengths)
                word, pair = _unpack(row["words"], size), _unpack(row["pairs"], size)
                context = np.roll(word, 1)
                mine = weights[octave(context)]
                model = mine[:, 0] * pair / np.maximum(context, 1) + mine[:, 1] * word / max(1, tokens) + mine[:, 2] / (kinds + 1)
                base = np.bincount(of, np.log10(word + 1.0), docs) - lengths * math.log10(tokens + kinds + 1)
                yield _batch(SCORED, [row["doc_id"], row["held_out"], lengths, np.bincount(of[word > 0], minlength=docs), np.full(docs, tokens), base, np.bincount(of, np.log10(model), docs)])

    return tidy(run)


def score_documents(docs: DataFrame, training: str = "training", top: int | None = None) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text and the boolean column ``training``): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score; log10 throughout.

    Null text counts as empty: one token, the end. Equal rows get equal results. Without training documents no token is
    known and both models are uniform. A null doc_id is kept. No rows: no rows. ``top`` has no effect: no word is left out."""
    held_out = ~F.col(training)
    deleted = F.col(training) & (crc_fold("doc_id", FOLDS) == DELETED)
    own = stage(docs.select(F.col("doc_id").cast("bigint"), "text", held_out.alias("held_out"), deleted.alias("deleted")).mapInArrow(_make_chunks, CHUNK), "lm-chunks")
    length = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    tokens, gone, kinds, every = own.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_deleted", "n_words", length))).first()
    words_in, pairs_in = buckets_for(kinds), buckets_for(every)
    totals = own.mapInArrow(_send(words_in, pairs_in), SENT).groupBy("bucket").applyInArrow(_total(words_in), TOTALS)
    resolved = stage(totals.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_resolve(words_in), RESOLVED), "lm-resolved")
    kinds = resolved.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    weights = fit(resolved, tokens - gone, kinds) if tokens else np.tile([0.0, 0.0, 1.0], (64, 1))
    return resolved.select("doc_id", "held_out", "lengths", "words", "pairs").mapInArrow(_score(weights, tokens, kinds), SCORED)


def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs.select("doc_id", "text", (crc_fold("doc_id", FOLDS) != HELD_OUT).alias("training")))


QUERIES = {"op9_scoring": op9_scoring}
