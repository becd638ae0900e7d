"""Token ids in Arrow stream files of fixed-size lists.

Documents are dealt by ranges of doc_id, encoded, and packed end to end into sequences of one length. Each task writes
an Arrow IPC file whose record batches hold BATCH sequences in fixed-size lists (ids and a mask that is false on the
padding of the last one), and an index file of its documents. Sequence k is in batch k // BATCH at k % BATCH, so a
memory map reaches it without copying. A manifest row per file, of the attempts that counted, says where ids start.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import batches_of, new_folder, stage
from siltstone.llm.textkit import chunks, tidy, trim

LENGTH = 2048
BATCH = 64
END_ID = 2
MANIFEST = "part int, file string, docs bigint, tokens bigint"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
TOKENIZER = "byte_bpe_50k.json"

#: Kinds of bytes: white space, letters, digits, other visible ASCII but the apostrophe, the apostrophe, beyond ASCII.
SPACE, LETTER, DIGIT, SIGN, QUOTE, HIGH = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = LETTER
_KIND[0x30:0x3A] = DIGIT
_KIND[0x27] = QUOTE
_KIND[0x80:] = HIGH

#: Characters that byte-level BPE has for bytes: visible ones of Latin-1 for themselves, then the rest in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
#: Words of letters below this are one pre-token and go to the model directly.
_LATIN = "\u0250"
#: Bytes of text encoded at once.
CODED = 2 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the tokenizers library, which encodes each different piece of text once.

    A batch is cut into pieces where byte-level pre-tokenisation always ends a token, whatever follows (see :func:`cuts`).
    Pieces already known are found in one pass over Arrow arrays; what is new goes to the library. At most ``keep`` pieces
    and ``keep_bytes`` of them stay known from batch to batch; beyond that, those that the last batch used."""

    def __init__(self, path: str, keep: int = 250_000, keep_bytes: int = 8 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.keep, self.keep_bytes = keep, keep_bytes
        self.known, self.ids, self.sizes = pa.array([], pa.large_binary()), np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _library(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            text = p.decode("utf-8", "replace")
            word = text[1:] if text[0] == " " else text
            if word.isalpha() and (word.isascii() or max(word) < _LATIN):
                out[i] = [t.id for t in self.tokenize(p.decode("latin-1").translate(_BYTES))]
            else:
                rest.append((i, text))
        for (i, _), e in zip(rest, self.library.encode_batch_fast([x for _, x in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _learn(self, pieces: pa.LargeBinaryArray) -> None:
        parts, sizes = [self.ids], [self.sizes]
        for a in range(0, len(pieces), 1 << 14):
            coded = self._library(pieces.slice(a, 1 << 14).to_pylist())
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            parts.append(np.fromiter(chain.from_iterable(coded), self.dtype, int(sizes[-1].sum())))
        self.known = pa.concat_arrays([self.known, pieces])
        self.ids, self.sizes = np.concatenate(parts), np.concatenate(sizes)

    def _forget(self, used: np.ndarray) -> None:
        """Keeps the pieces of these numbers alone."""
        self.known, (self.ids, self.sizes) = self.known.take(pa.array(used)), (_gather(self.ids, self.sizes, used), self.sizes[used])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        data = b"".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not data:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        bounds = np.concatenate([[0], ends])
        cut = cuts(np.frombuffer(data, np.uint8))
        cut[bounds] = True
        at = np.flatnonzero(cut)
        for special in self.special:  # texts with an added token's string are the library's alone
            if special in data:
                for i, t in enumerate(texts):
                    if special in t:
                        at = at[(at <= bounds[i]) | (at >= bounds[i + 1])]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        place = pa.compute.index_in(pieces.dictionary, value_set=self.known)
        if place.null_count:
            new = place.is_null()
            number = np.cumsum(np.asarray(new)) - 1 + len(self.known)
            self._learn(pieces.dictionary.filter(new))
            place = pa.compute.if_else(new, pa.array(number.astype(np.int32)), place)
        place = place.to_numpy()
        which = place[pieces.indices.to_numpy()]
        ids, sizes = _gather(self.ids, self.sizes, which), self.sizes[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        if len(self.known) > self.keep or self.known.nbytes > self.keep_bytes:
            self._forget(place if len(place) <= self.keep and pieces.dictionary.nbytes <= self.keep_bytes else place[:0])
        return ids, np.diff(total[np.searchsorted(at, bounds)])


def _gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``flat``, sizes[i] long each, of the given numbers, end to end."""
    starts = np.cumsum(sizes) - sizes
    size = sizes[which]
    place = np.repeat(starts[which] - (np.cumsum(size) - size), size)
    place += np.arange(len(place))
    return flat[place]


def cuts(a: np.ndarray) -> np.ndarray:
    """Places in UTF-8 where a pre-token ends whatever the text around: before white space that follows anything visible;
    after a lone line end or tab between visible characters; between an ASCII letter and a sign other than the apostrophe
    (contractions hold that). What stands before such a place is cut alike with or without what follows, and the rest
    alike with or without what stands before."""
    kind = _KIND[a]
    before, here = kind[:-1], kind[1:]
    cut = (before == LETTER) & (here == SIGN) | (before == SIGN) & (here == LETTER)
    gap = here == SPACE
    cut |= gap & (before >= LETTER) & (before <= QUOTE)
    high = np.flatnonzero(gap & (before == HIGH))  # the last byte of a character that may be white space
    cut[high[~_blank(a, high)]] = True
    lone = np.flatnonzero((before[1:] == SPACE) & (a[1:-1] != 0x20) & cut[:-1] & (here[1:] >= LETTER) & (here[1:] <= QUOTE)) + 1
    cut[lone] = True
    return np.concatenate([[True], cut, [True]])


def _blank(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is at each place is white space beyond ASCII."""
    z, y, x = a[at], a[np.maximum(at - 1, 0)], a[np.maximum(at - 2, 0)]
    two = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
    ogham = (x == 0xE1) & (y == 0x9A) & (z == 0x80)
    general = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    return two | ogham | general | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This Python worker's encoder: Spark reuses workers, so what one task learns serves the next. What it knows is bounded."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Packer:
    """Writes ids end to end into one file of fixed-size lists."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        self.item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer, self.length, self.batch, self.dtype = ipc.new_file(sink, self.schema), length, batch, dtype
        self.held, self.tokens = np.zeros(0, dtype), 0

    def add(self, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        self.held = np.concatenate([self.held, ids])
        full = self.length * self.batch
        whole = len(self.held) // full * full
        for a in range(0, whole, full):
            self._write(self.held[a : a + full], full)
        self.held = self.held[whole:].copy()

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if len(self.held):
            padded = np.zeros(-(-len(self.held) // self.length) * self.length, self.dtype)
            padded[: len(self.held)] = self.held
            self._write(padded, len(self.held))
        self.writer.close()


def _write(folder: str, path: str, end_id: int, length: int, batch_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"
        store, place = fs.FileSystem.from_uri(name)
        encoder = packer = None
        documents = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if packer is None:
                store.create_dir(place.rpartition("/")[0], recursive=True)
                encoder = encoder_of(path)
                sink = store.open_output_stream(place + ".arrow", compression=None)
                index = store.open_output_stream(place + ".docs.arrow", compression=None)
                packer = _Packer(sink, encoder.dtype, length, batch_size)
                writer = ipc.new_file(index, INDEX)
            for a, b, texts in chunks(batch, size=CODED):
                ids, sizes = encoder.encode(texts)
                start = packer.tokens + np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
                packer.add(np.insert(ids, np.cumsum(sizes), end_id))
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(start), pa.array(sizes + 1)], schema=INDEX))
                documents += b - a
                trim()
        if packer is not None:
            packer.close()
            writer.close()
            sink.close()
            index.close()
            row = [(TaskContext.get().partitionId(),), (name,), (documents,), (packer.tokens,)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "docs", "tokens"])

    return tidy(run)


def write_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None, end_id: int = END_ID, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Encodes every whole text of ``docs`` (doc_id, text; null: empty) in ascending doc_id order and writes the files.

    Returns the staged manifest: part (files in order), file (name without suffix), docs, tokens, start (ids in files
    before it). ``end_id`` follows every document, so an empty text has one id. A null doc_id sorts first; rows of equal
    doc_id are in order of their texts. The string of an added token in a text is that token, as the library has it. No
    rows: no file."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    x = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    with batches_of(docs.sparkSession, 2000):
        manifest = stage(x.mapInArrow(_write(folder, path or tokenizer_path(), end_id, length, batch), MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stage(manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("bigint")), "token-files")


class TokenFile:
    """Random access to one file: sequences and masks are views of the memory map (or of one batch read)."""

    def __init__(self, name: str):
        store, place = fs.FileSystem.from_uri(name)
        source = pa.memory_map(place + ".arrow") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place + ".arrow")
        self.reader = ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.index = ipc.open_file(store.open_input_file(place + ".docs.arrow"))

    def docs(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)

    def batches(self) -> Iterator[np.ndarray]:
        for i in range(self.reader.num_record_batches):
            yield self.reader.get_batch(i).column(0).flatten().to_numpy()

    def sequence(self, k: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        got = self.reader.get_batch(k // batch)
        at = slice(k % batch * self.length, (k % batch + 1) * self.length)
        return got.column(0).flatten().to_numpy()[at], got.column(1).flatten().to_numpy(zero_copy_only=False)[at]


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file = TokenFile(row["file"])
            parts = file.batches()
            now, at = np.zeros(0, "<u2"), 0
            for docs in file.docs():
                sums = []
                for n in docs.column("n_tokens").to_pylist():
                    crc = 0
                    while n:
                        if at == len(now):
                            now, at = next(parts), 0
                        take = min(n, len(now) - at)
                        crc = zlib.crc32(now[at : at + take].astype("<u4"), crc)
                        at, n = at + take, n - take
                    sums.append(crc)
                start = pa.array(docs.column("start").to_numpy() + row["start"])
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row per document of the files: doc_id, start over all files, n_tokens with the end id, ids_crc32."""
    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files, "file").mapInArrow(_read, READ)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op4_tokens": op4_tokens}
