"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams are counted over all training rows. The classifier is fitted by
follow-the-regularised-leader with elastic-net penalties on a sample of about SAMPLE texts a language, part of which is
kept back to calibrate a temperature. The model, DIMS weights a language, is broadcast; prediction is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import apart, batches_of, crc_fold, small, stage
from siltstone.llm.textkit import chunks, tidy

#: Hashed n-grams of up to GRAMS characters; a space stands for any run of other characters.
BITS, GRAMS = 15, 3
DIMS = 1 << BITS
#: Training rows for the classifier: about so many different texts of each language, chosen by a hash of the row.
SAMPLE = 400
#: Languages that the driver can hold the weights of; with more, training fails.
LANGUAGES = 500
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Rows exchanged at once with Python.
BATCH_ROWS = 2000
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: bytes) -> np.ndarray:
    """Hashed n-grams of a UTF-8 text in lower case, one for each place and length; none if it has no letter."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    out, h = [], np.zeros(len(points), np.uint32)
    for n in range(GRAMS):
        h = h[: len(points) - n] * np.uint32(0x01000193) + points[n:] * _MULTIPLIERS[n % 4]
        g = h ^ (h >> np.uint32(15))
        out.append((g * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))[: None if n else -1])
    return np.concatenate(out)


def term_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@tidy
def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(DIMS + 1, np.int64), 0
    for batch in batches:
        for _, _, texts in chunks(batch):
            for t in texts:
                df[term_counts(t)[0]] += 1
            rows += len(texts)
    if rows:
        df[DIMS] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["gram", "df"])


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        for a, b, texts in chunks(batch):
            pairs = [term_counts(t) for t in texts]
            columns = [batch.column("lang").slice(a, b - a), batch.column("r").slice(a, b - a), pa.array([p[0] for p in pairs], kinds[2]), pa.array([p[1] for p in pairs], kinds[3])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "r", "grams", "counts"])


class Model:
    """Weights (DIMS, languages), idf and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf, self.temperature = langs, idf.astype(np.float32), 1.0
        self.weights, self.bias = np.zeros((DIMS, len(langs)), np.float32), np.zeros(len(langs), np.float32)

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[at]
        return v / (np.sqrt((v * v).sum()) or 1.0)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 5, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        """Follow-the-regularised-leader: weights are the closed-form leader of all gradients so far, exactly zero
        where those don't exceed ``l1``."""
        k = len(self.langs)
        z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))

        def leader(at: np.ndarray) -> np.ndarray:
            zi = z[at]
            penalty = np.where(at == DIMS, 0.0, l1)[:, None]
            return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                y, at, counts = rows[i]
                x = np.append(self.vector(at, counts), 1.0)
                at = np.append(at, DIMS)
                w = leader(at)
                p = softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p
                more = n[at] + g * g
                z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
                n[at] = more
        every = np.arange(DIMS + 1)
        w = leader(every)
        self.weights, self.bias = w[:DIMS].astype(np.float32), w[DIMS].astype(np.float32)

    def calibrate(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """The temperature under which the kept-back rows are most likely."""
        if not rows:
            return
        logits = np.stack([self.logits(at, c) for _, at, c in rows]).astype(float)
        y = np.array([r[0] for r in rows])

        def loss(t: float) -> float:
            x = logits / t
            top = x.max(1, keepdims=True)
            return float((np.log(np.exp(x - top).sum(1)) + top[:, 0] - x[np.arange(len(y)), y]).mean())

        self.temperature = min(np.geomspace(0.05, 10, 120), key=loss)

    def predict(self, text: bytes) -> tuple[str, float]:
        at, counts = term_counts(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, counts).astype(float) / self.temperature)
        i = int(p.argmax())
        return self.langs[i], float(p[i])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (text, lang; rows with a null in either teach nothing). What comes to the driver is bounded
    by DIMS, LANGUAGES and ``sample``. Equal rows are sampled together and count once: of a language of at most ``sample``
    different texts all are learned, however often each comes."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    r = F.xxhash64("text", "lang")
    count = rows.select("lang", r.alias("r")).groupBy("lang").agg(F.countDistinct("r").alias("n")).limit(LANGUAGES + 1).collect()
    if len(count) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: their weights don't fit the driver, and none is left out")
    langs = sorted(r["lang"] for r in count)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        df = rows.select("text").mapInArrow(_document_frequencies, "gram int, df bigint").groupBy("gram").agg(F.sum("df").alias("df")).toArrow()
    dense = np.zeros(DIMS + 1)
    dense[df.column("gram").to_numpy()] = df.column("df").to_numpy()
    model = Model(langs, np.log((1 + dense[DIMS]) / (1 + dense[:DIMS])) + 1)
    if not langs:
        return model
    shares = {"lang": pa.array([c["lang"] for c in count], pa.string()), "share": pa.array([min(1.0, sample / c["n"]) for c in count], pa.float64())}
    share = docs.sparkSession.createDataFrame(pa.table(shares))  # a list would be an RDD, for which executors keep further Python workers
    chosen = rows.withColumn("r", r).join(F.broadcast(share), "lang").where((F.shiftrightunsigned("r", 11) / F.lit(float(1 << 53))) < F.col("share")).dropDuplicates(["r"])
    with batches_of(docs.sparkSession, BATCH_ROWS):
        got = chosen.select("text", "lang", "r").mapInArrow(_features, "lang string, r bigint, grams array<int>, counts array<int>").toArrow().to_pylist()
    got.sort(key=lambda x: x["r"])
    number = {x: i for i, x in enumerate(langs)}
    made = [(number[x["lang"]], np.array(x["grams"], np.int64), np.array(x["counts"], float)) for x in got if x["grams"]]
    model.fit([x for i, x in enumerate(made) if i % 5])
    model.calibrate(made[::5])
    return model


def _predict(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch):
                out = [model.value.predict(t) for t in texts]
                new = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), *new], names=[*keep, "lang_pred", "score"])

    return tidy(run)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with lang_pred and score, from its text alone. Null text or text without a letter:
    ``und``, 0."""
    if "lang_pred" in docs.columns or "score" in docs.columns:
        raise ValueError("lang_pred and score are made here")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), "lang_pred string, score double"])
    return docs.mapInArrow(_predict(shared, keep), schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score. Learns from rows that are
    not held out. Equal texts get equal predictions; without training rows all are ``und``. No rows: no rows."""
    held = crc_fold("doc_id", FOLDS) == HELD_OUT
    model = train(docs.where(~held), sample)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def known_language(docs: DataFrame, least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose language can't be told: null or empty text, no letter, or a score below ``least``. All
    columns stay, also extra ones whose names clash with those here; repeated rows stay or go together; a null lang teaches
    nothing and is no reason to go; without any labelled row all go. No rows: no rows."""
    model = train(docs.where(crc_fold("doc_id", FOLDS) != HELD_OUT), sample)
    if not model.langs:
        return docs.where(F.lit(False))
    x, back = apart(docs, "text")
    x = x.where(F.col("text").isNotNull()).withColumns({"h1": F.xxhash64("text"), "h2": F.crc32("text")})
    with batches_of(docs.sparkSession, BATCH_ROWS):  # what goes is staged here, as no more than keys come back from Python
        told = predict(x.select("h1", "h2", "text"), model, ["h1", "h2"])
        gone = told.where(~((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)))
        gone = stage(gone.select("h1", "h2").distinct(), "language-unknown")
    return back(x.join(small(gone), ["h1", "h2"], "left_anti"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_language": op1_language}
