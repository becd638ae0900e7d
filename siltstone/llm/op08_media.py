"""Media columns: bytes stored as lossless WebP images and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import webp
from siltstone.llm.textkit import chunks, tidy

MEDIA = "doc_id bigint, n_bytes bigint, media binary"
PIXELS = "doc_id bigint, image int, width int, height int, pixels binary"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def payload(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of webp.SAMPLES."""
    return text + b"\0" * (-len(text) % webp.SAMPLES if text else webp.SAMPLES)


@tidy
def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in chunks(batch):
            different = list(dict.fromkeys(texts))  # copies are made once
            made = dict(zip(different, webp.encode_all([payload(t) for t in different])))
            media = [made[t] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_bytes and media, the UTF-8 bytes as WebP images.

    Null text: empty, which is one row of zero pixels. A text of over 1 MiB takes several images, one after the other.
    Equal texts have equal media, repeated rows stay rows of their own, other columns are not read. No rows: no rows."""
    return docs.select("doc_id", "text").mapInArrow(_encode, MEDIA)


def _rows(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    media = batch.column("media")
    a = 0
    while a < batch.num_rows:
        b, got, total = a, [], 0
        while b < batch.num_rows and (b == a or total < size):
            got.append(media[b].as_py())
            total += len(got[-1])
            b += 1
        yield a, got
        a = b


@tidy
def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIXELS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        for a, media in _rows(batch):
            for i, m in enumerate(media):
                doc, at, number = batch.column("doc_id")[a + i].as_py(), 0, 0
                while at < len(m):
                    image, at = webp.decode(m, at)
                    rgba = image[..., [webp.RED, webp.GREEN, webp.BLUE, webp.ALPHA]].tobytes()
                    row = (doc, number, image.shape[1], image.shape[0], rgba)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)
                    number += 1


def decode_pixels(media: DataFrame) -> DataFrame:
    """Every image of every row (doc_id, media): doc_id, image (its number in the row), width, height and pixels as RGBA
    bytes, row by row. Any lossless WebP file will do, a null or empty medium has no image, a broken one is an error, and
    images are held one at a time. No rows: no rows."""
    return media.where("media is not null").select("doc_id", "media").mapInArrow(_pixels, PIXELS)


def feature(data: np.ndarray) -> str:
    """Samples in sixteen ranges, and the mean step from one row of pixels to the next."""
    counts = np.bincount(data >> 4, minlength=16)
    rows = data.reshape(-1, webp.SAMPLES)
    step = np.abs(rows[1:].astype(np.int16) - rows[:-1]).mean() if len(rows) > 1 else 0.0
    return f"{'-'.join(map(str, counts.tolist()))}:{step:.4f}"


def _describe(media: bytes) -> tuple:
    data = webp.samples(media)
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(data, np.uint8))


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for a, media in _rows(batch):
            ids, sizes = batch.column("doc_id").slice(a, len(media)), batch.column("n_bytes").slice(a, len(media))
            known = {m: _describe(m) for m in set(media)}
            out = [known[m] for m in media]
            yield pa.RecordBatch.from_arrays([ids, sizes, *[pa.array(c, t) for c, t in zip(zip(*out), types[2:])]], names=names)


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored images of ``media`` (doc_id, n_bytes, media) and describes what they hold: the samples' number,
    digest, last 64 and feature, the stored form's size and digest. Equal media have equal rows. No rows: no rows."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op8_media": op8_media}
