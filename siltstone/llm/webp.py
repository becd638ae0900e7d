"""Lossless WebP (VP8L): a decoder of the whole format and the encoder that media columns use.

The decoder reads canonical prefix codes by tables, meta prefix groups, back-references and the colour cache, and inverts
the predictor, cross-colour, subtract-green and palette transforms. Images of one channel, as the encoder writes them, go
through a shorter loop over the same codes and references.

The encoder writes one sample to a pixel, in GREEN. It chooses the palette transform where the samples have few values and
a predictor where that makes them more even, finds back-references by equal six samples, and writes canonical codes of the
symbols' own counts. The cache and the colour transforms gain nothing on pixels of one channel and are only read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of the format: order of code length codes, and the neighbours named by the first 120 distances.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
HASH_MULTIPLIER = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
LONGEST_CODE = 15
#: Bits of the longest code that the encoder writes; longer ones make larger tables for rare symbols.
WRITTEN_CODE = 10
#: Channel of each sample of a pixel in the bit stream; arrays of pixels are (height, width, 4) in this order.
GREEN, RED, BLUE, ALPHA = range(4)


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.base, self.near = data, 0, 0, int.from_bytes(data[:64], "little")

    def peek(self, n: int) -> int:
        """The next n bits, at most 64, zeros beyond the end, without going on."""
        shift = self.at - self.base
        if shift > 448:
            self.base = self.at & ~7
            self.near = int.from_bytes(self.data[self.base >> 3 : (self.base >> 3) + 64], "little")
            shift = self.at - self.base
        return self.near >> shift & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.skip(n)
        return out


_reversals: dict[int, np.ndarray] = {}


def _reversed_bits(n: int) -> np.ndarray:
    """All numbers of n bits with their bits in reverse order."""
    if n not in _reversals:
        x, out = np.arange(1 << n, dtype=np.uint16), np.zeros(1 << n, np.uint16)
        for _ in range(n):
            out, x = out << np.uint16(1) | x & np.uint16(1), x >> np.uint16(1)
        _reversals[n] = out
    return _reversals[n]


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in the order of their codes, and their lengths."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    return order, lengths[order]


class Code:
    """A canonical prefix code from the bit lengths of its symbols; a lone symbol takes no bits. ``table`` has for the
    next ``depth`` bits, least significant first, 16 times the symbol plus its length (``entries`` as an array)."""

    def __init__(self, lengths: list[int] | np.ndarray):
        symbols, sizes = _canonical(np.asarray(lengths, np.int64))
        if not len(symbols):
            raise ValueError("a prefix code has no symbol")
        self.only = int(symbols[0]) if len(symbols) == 1 else None
        self.depth, self._table = 0, [16 * (self.only or 0)]
        if self.only is None:
            if int((1 << (LONGEST_CODE - sizes)).sum()) != 1 << LONGEST_CODE:
                raise ValueError("a prefix code is not complete")
            self.depth = int(sizes[-1])
            self.entries = np.repeat(symbols << 4 | sizes, 1 << (self.depth - sizes))[_reversed_bits(self.depth)]
            self._table = None

    @property
    def table(self) -> list[int]:
        if self._table is None:
            self._table = self.entries.tolist()
        return self._table

    @classmethod
    def of_one(cls, symbol: int) -> Code:
        code = cls.__new__(cls)
        code.only, code.depth, code._table = symbol, 0, [16 * symbol]
        return code

    @classmethod
    def of_one(cls, symbol: int) -> Code:
        code = cls.__new__(cls)
        code.only, code.depth, code._table = symbol, 0, [16 * symbol]
        return code

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        entry = self.table[bits.peek(self.depth)]
        bits.skip(entry & 15)
        return entry >> 4

    def pairs(self) -> list[int]:
        """The table of a GREEN code by which more is read at once where it fits: 16 times what follows, plus the bits.
        Numbers of _SOME are one or two literals, from _REFERS on lengths, from _SYMBOLS on symbols with further bits."""
        if self.only is not None:
            return [16 * (self.only if self.only < LITERALS else self.only - LITERALS + _SYMBOLS)]
        place = np.arange(len(self.entries))
        first, size = self.entries >> 4, self.entries & 15
        other = self.entries[place >> size]
        second, both = other >> 4, size + (other & 15)
        kind = np.maximum(first - LITERALS, 0)
        more = _FURTHERS[kind] + size
        out = np.where(first < LITERALS, first, kind + _SYMBOLS) << 4 | size
        two = (first < LITERALS) & (second < LITERALS) & (both <= self.depth)
        out = np.where(two, (LITERALS + first * LITERALS + second) << 4 | both, out)
        known = (first >= LITERALS) & (more <= self.depth)
        length = _LEASTS[kind] + (place >> size & ((1 << _FURTHERS[kind]) - 1))
        return np.where(known, (_REFERS + length) << 4 | more, out).tolist()


@lru_cache(256)
def _length_code(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


def read_code(bits: Bits, symbols: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        named = [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]
        if len(set(named)) == 1:
            return Code.of_one(named[0])
        return Code(np.bincount(named, minlength=symbols))
    first = [0] * len(CODE_LENGTH_ORDER)
    count = 4 + bits.read(4)
    sizes = bits.read(3 * count)
    for i in range(count):
        first[CODE_LENGTH_ORDER[i]] = sizes >> (3 * i) & 7
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    code, before, lengths = _length_code(tuple(first)), 8, []
    table, mask = code.table, (1 << code.depth) - 1
    # no length takes more than 7 bits and 7 further ones
    w, begin = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * symbols + 8], "little") >> (bits.at & 7), 0
    while len(lengths) < symbols and left:
        left -= 1
        entry = table[w & mask]
        s, n = entry >> 4, entry & 15
        w >>= n
        begin += n
        if s < 16:
            lengths.append(s)
            before = s or before
            continue
        more, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        lengths += [before if s == 16 else 0] * (least + (w & ((1 << more) - 1)))
        w >>= more
        begin += more
    bits.skip(begin)
    if len(lengths) > symbols:
        raise ValueError("code lengths run over")
    return Code(lengths)


def _amount(bits: Bits, symbol: int) -> int:
    return _LEAST[symbol] + bits.read(_FURTHER[symbol])


def _read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray | Green:
    """Pixels (height, width, 4) before transforms; ``top``: the main image, which may have groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    side, groups, of = 0, 1, None
    if top and bits.read(1):
        side = bits.read(3) + 2
        of = _read_image(bits, -(-width >> side), -(-height >> side), False)
        of = of[..., RED].astype(int) << 8 | of[..., GREEN]
        groups = int(of.max()) + 1
    green = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    codes = [[read_code(bits, n) for n in (green, LITERALS, LITERALS, LITERALS, DISTANCES)] for _ in range(groups)]
    if top and groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][RED : ALPHA + 1]):
        return _read_green(bits, width, height, codes[0])
    total = width * height
    argb = [0] * total
    cache = [0] * (1 << cache_bits)
    at = 0
    while at < total:
        y, x = divmod(at, width)
        g, r, b, a, d = codes[int(of[y >> side, x >> side]) if of is not None else 0]
        s = g.read(bits)
        if s < LITERALS:
            red, blue, alpha = r.read(bits), b.read(bits), a.read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < LITERALS + LENGTHS:
            length, far = _amount(bits, s - LITERALS), _amount(bits, d.read(bits))
            if far > len(NEIGHBOURS):
                far -= len(NEIGHBOURS)
            else:
                dx, dy = NEIGHBOURS[far - 1]
                far = max(1, dx + dy * width)
            if far > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + length):
                argb[i] = argb[i - far]
            new = argb[at : at + length]
        else:
            new = [cache[s - LITERALS - LENGTHS]]
        for p in new:
            argb[at] = p
            at += 1
            if cache_bits:
                cache[(HASH_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    p = np.array(argb, np.uint32)
    return np.stack([p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24], -1).astype(np.uint8).reshape(height, width, 4)


#: What a length or distance symbol stands for at least, and its further bits.
_FURTHER = [0 if s < 4 else (s - 2) >> 1 for s in range(DISTANCES)]
_LEAST = [s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(DISTANCES)]
_LEASTS, _FURTHERS = np.array(_LEAST), np.array(_FURTHER)
#: Bytes of bit stream that are taken apart at once.
STRIDE = 1 << 16


def _windows(data: bytes, byte: int) -> list[int]:
    """The 56 bits from every byte of a stride on; zeros beyond the end."""
    n = min(STRIDE, len(data) - byte)
    a = np.zeros(n + 7, np.int64)
    part = np.frombuffer(data, np.uint8, min(n + 7, len(data) - byte), byte)
    a[: len(part)] = part
    out = a[:n].copy()
    for i in range(1, 7):
        out |= a[i : n + i] << (8 * i)
    return out.tolist()


@dataclass
class Green:
    """An image whose RED, BLUE and ALPHA are always the same."""

    plane: np.ndarray
    red: int
    blue: int
    alpha: int

    def full(self) -> np.ndarray:
        pixels = np.empty((*self.plane.shape, 4), np.uint8)
        pixels[:] = (0, self.red, self.blue, self.alpha)
        pixels[..., GREEN] = self.plane
        return pixels


#: All runs of one and of two literals; numbers after them stand for lengths, and numbers after those for symbols.
_SOME = [bytes([i]) for i in range(LITERALS)] + [bytes([i, j]) for i in range(LITERALS) for j in range(LITERALS)]
_REFERS = len(_SOME)
_SYMBOLS = _REFERS + (1 << 12) + 1


def _read_green(bits: Bits, width: int, height: int, codes: list[Code]) -> Green:
    """A main image whose RED, BLUE and ALPHA are always the same: literals of GREEN and references. The main image comes
    last, so what is read beyond its samples is only cut off."""
    green, red, blue, alpha, far = codes
    total = width * height
    out = bytearray()
    if green.only is not None and green.only < LITERALS:
        out = bytes([green.only]) * total
    table, mask, d_table, d_mask = green.pairs(), (1 << green.depth) - 1, far.table, (1 << far.depth) - 1
    some, refers, symbols, least, further, near = _SOME, _REFERS, _SYMBOLS, _LEAST, _FURTHER, len(NEIGHBOURS)
    while len(out) < total:
        first, p = divmod(bits.at, 8)
        if first >= len(bits.data):
            raise ValueError("the image ends early")
        windows = _windows(bits.data, first)
        # a token takes 15 + 10 + 15 + 18 bits at most; before the stride's last bytes unless the stream ends there
        stop = 8 * (len(windows) - (0 if first + len(windows) >= len(bits.data) else 8))
        windows += [0] * 8
        while p < stop:
            entry = table[windows[p >> 3] >> (p & 7) & mask]
            p += entry & 15
            n = entry >> 4
            if n < refers:
                out += some[n]
                continue
            at = len(out)
            if at >= total:  # bits that fill the last byte
                break
            w = windows[p >> 3] >> (p & 7)
            if n < symbols:
                n -= refers
            else:
                more = further[n - symbols]
                n = least[n - symbols] + (w & ((1 << more) - 1))
                w >>= more
                p += more
            d = d_table[w & d_mask]
            more = further[d >> 4]
            p += more + (d & 15)
            d = least[d >> 4] + (w >> (d & 15) & ((1 << more) - 1)) - near
            if d <= 0:
                dx, dy = NEIGHBOURS[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            out += out[at - d : at - d + n] if n <= d else (out[at - d :] * (n // d + 1))[:n]
        bits.at = 8 * first + p
        if len(out) < total and bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
    return Green(np.frombuffer(out, np.uint8, total).reshape(height, width), red.only, blue.only, alpha.only)


def _half(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, top_left, top_right):
    """Prediction from neighbours as int arrays of four channels (GREEN, RED, BLUE, ALPHA)."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode <= 9:
        return _half(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = _half(left, top)
    return np.clip(mean + np.trunc((mean - top_left) / 2).astype(int), 0, 255)


def _undo_predictor(image: np.ndarray, modes: np.ndarray, side: int) -> np.ndarray:
    height, width = image.shape[:2]
    out = image.copy()
    out[0, :1, ALPHA] += np.uint8(255)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    if not height > 1:
        return out
    if (modes == 2).all():  # each pixel adds to the one above it
        return np.cumsum(out, axis=0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    wide = out.astype(int)
    for y in range(1, height):
        above, row = wide[y - 1], wide[y]
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else row[0]
            row[x] = row[x] + _predict(int(modes[y >> side, x >> side]), row[x - 1], above[x], above[x - 1], right) & 255
    return wide.astype(np.uint8)


def _undo_cross_colour(image: np.ndarray, factors: np.ndarray, side: int) -> np.ndarray:
    height, width = image.shape[:2]
    f = factors[np.ix_(np.arange(height) >> side, np.arange(width) >> side)].view(np.int8).astype(int)
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(int)
    out = image.astype(int)
    green = signed(out[..., GREEN])
    out[..., RED] += f[..., BLUE] * green >> 5
    out[..., BLUE] += (f[..., GREEN] * green >> 5) + (f[..., RED] * signed(out[..., RED] & 255) >> 5)
    return (out & 255).astype(np.uint8)


def _undo_palette(image: np.ndarray, palette: np.ndarray, packed: int, width: int) -> np.ndarray:
    x = np.arange(width)
    depth = 8 >> packed
    index = image[:, x >> packed, GREEN].astype(int) >> ((x & ((1 << packed) - 1)) * depth) & ((1 << depth) - 1)
    table = np.zeros((256, 4), np.uint8)
    table[: len(palette)] = palette
    return table[index]


def _read_vp8l(data: bytes) -> tuple[np.ndarray | Green, list]:
    """The main image of a VP8L bit stream, and the transforms to undo, the last one first."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L bit stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            side = bits.read(3) + 2
            blocks = _read_image(bits, -(-now >> side), -(-height >> side), False)
            undo.append((_undo_predictor, blocks[..., GREEN] & 15, side) if kind == PREDICTOR else (_undo_cross_colour, blocks, side))
        elif kind == SUBTRACT_GREEN:
            undo.append((_undo_subtract_green,))
        else:
            size = bits.read(8) + 1
            palette = np.cumsum(_read_image(bits, size, 1, False)[0], axis=0, dtype=np.uint8)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((_undo_palette, palette, packed, now))
            now = -(-now >> packed)
    return _read_image(bits, now, height, True), undo[::-1]


def decode_vp8l(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4), channels GREEN, RED, BLUE, ALPHA, of a VP8L bit stream."""
    image, undo = _read_vp8l(data)
    image = image.full() if isinstance(image, Green) else image
    for f, *args in undo:
        image = f(image, *args)
    return image


def _undo_subtract_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., RED] += image[..., GREEN]
    out[..., BLUE] += image[..., GREEN]
    return out


def _stream(data: bytes, start: int) -> tuple[bytes, int]:
    """The VP8L bit stream of the WebP file in ``data`` that starts at ``start``, and where the file ends."""
    if data[start : start + 4] != b"RIFF" or data[start + 8 : start + 12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = start + 8 + int.from_bytes(data[start + 4 : start + 8], "little")
    at = start + 12
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return bytes(data[at + 8 : at + 8 + size]), end
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode(data: bytes, start: int = 0) -> tuple[np.ndarray, int]:
    """Pixels of the WebP file in ``data`` that starts at ``start``, and where it ends."""
    stream, end = _stream(data, start)
    return decode_vp8l(stream), end


class _Out:
    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, *fields: tuple[int, int]) -> _Out:
        """Pairs of value and number of bits."""
        for value, n in fields:
            self.value |= value << self.n
            self.n += n
        return self


def code_lengths(counts: np.ndarray, most: int = WRITTEN_CODE) -> np.ndarray:
    """Bit lengths, at most ``most``, of a prefix code for symbols that come so often; 0: never, 1 for a lone symbol."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].tolist()
    n = len(weights)
    while True:
        parent, made, i, j = [0] * (2 * n - 1), [], 0, 0
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):  # the lighter of the next symbol and the next node made
                if i < n and (j == len(made) or weights[i] <= made[j]):
                    total += weights[i]
                    parent[i] = node
                    i += 1
                else:
                    total += made[j]
                    parent[n + j] = node
                    j += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= most:
            out[order] = depth[:n]
            return out
        weights = [(w + 1) // 2 for w in weights]  # flatter counts give a flatter code


def _codewords(lengths: np.ndarray) -> np.ndarray:
    """For every row of lengths the code of each symbol, first bit least significant."""
    out = np.zeros(lengths.shape, np.int64)
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol]
    order = np.argsort(row << 10 | size, kind="stable")
    row, symbol, size = row[order], symbol[order], size[order]
    step = 1 << (LONGEST_CODE - size)
    before = np.cumsum(step) - step
    first = before - before[np.searchsorted(row, row)]
    out[row, symbol] = _reversed_bits(LONGEST_CODE)[np.minimum(first, (1 << LONGEST_CODE) - 1)]
    return out


def _length_codewords(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """Code and bits of each symbol of a short code."""
    out, code, last = [(0, 0)] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s], last = (int(f"{code:0{n}b}"[::-1], 2), n), n
        code += 1
    return out


#: The code in which code lengths are written: 0 to 10, and runs of zeros (17 and 18).
_LENGTH_SIZES = tuple(3 if s in (6, 7, 8) else 4 if s <= WRITTEN_CODE or s > 16 else 0 for s in range(19))
_LENGTH_WORDS = _length_codewords(_LENGTH_SIZES)
_LENGTH_HEAD = [(0, 1), (len(CODE_LENGTH_ORDER) - 4, 4), *[(_LENGTH_SIZES[s], 3) for s in CODE_LENGTH_ORDER]]


def _put_code(out: _Out, lengths: np.ndarray) -> None:
    """Writes a code: one or two symbols of at most eight bits by name, else all lengths, runs of zeros shortened."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < LITERALS):
        names = used.tolist() or [0]
        out.put((1, 1), (len(names) - 1, 1), (1, 1), *[(s, 8) for s in names])
        return
    whole = n = count = at = 0
    for u, size in zip(used.tolist(), lengths[used].tolist()):
        gap = u - at
        while gap:
            if gap < 3:
                (word, bits), run, more = _LENGTH_WORDS[0], 1, 0
                value = 0
            elif gap < 11:
                (word, bits), run, value, more = _LENGTH_WORDS[17], gap, gap - 3, 3
            else:
                run = min(gap, 138)
                (word, bits), value, more = _LENGTH_WORDS[18], run - 11, 7
            whole |= (word | value << bits) << n
            n += bits + more
            gap -= run
            count += 1
        word, bits = _LENGTH_WORDS[size]
        whole |= word << n
        n += bits
        count += 1
        at = u + 1
    bits = max(2, (count - 2).bit_length() + 1 & ~1)
    out.put(*_LENGTH_HEAD, (1, 1), ((bits - 2) // 2, 3), (count - 2, bits), (whole, n))


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of lengths or distance codes, their further bits and how many those are."""
    symbol = np.searchsorted(_LEASTS, values, side="right") - 1
    return symbol, values - _LEASTS[symbol], _FURTHERS[symbol]


#: Samples that make a reference (shorter ones take as many bits as their samples), and those of the longest one.
SHORTEST, LONGEST = 6, 4096
#: Bits of a sample's place among those coded together, beside which a hash is sorted.
_PLACE = 22


def references(a: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For samples of several images, one after the other, the distance back to the last place of the same image with the
    same SHORTEST samples, 0 if none, and for how many samples on that distance holds, at most LONGEST."""
    n = len(a)
    far, length = np.zeros(n, np.int64), np.ones(n, np.int64)
    m = n - SHORTEST + 1
    if m > 1:
        wide = a.astype(np.uint64)
        key = image[:m].astype(np.uint64) << np.uint64(8 * SHORTEST)
        for i in range(SHORTEST):
            key |= wide[i : m + i] << np.uint64(8 * i)
        placed = key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(m, dtype=np.uint64)
        placed.sort()
        order = (placed & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        same = (key[order[1:]] == key[order[:-1]]) & (image[order[1:]] == image[order[1:] + SHORTEST - 1])
        far[order[1:][same]] = (order[1:] - order[:-1])[same]
        ends = np.append(np.flatnonzero(far[1:] != far[:-1]) + 1, n)  # of runs of one distance
        run = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
        length = np.where(far > 0, np.minimum(run + SHORTEST - 1, LONGEST), 1)
    return far, length


def _put_pixels(out: _Out, pixels: np.ndarray) -> None:
    """A small image (n, 4) of literals, for palettes and the blocks of transforms."""
    out.put((0, 1))
    tables = []
    for c in (GREEN, RED, BLUE, ALPHA):
        sizes = code_lengths(np.bincount(pixels[:, c], minlength=LITERALS + LENGTHS if c == GREEN else LITERALS))
        _put_code(out, sizes)
        tables.append((_codewords(sizes[None])[0], sizes if np.count_nonzero(sizes) > 1 else sizes * 0))
    _put_code(out, np.zeros(DISTANCES, np.int64))
    for p in pixels.tolist():
        out.put(*[(int(words[p[c]]), int(sizes[p[c]])) for c, (words, sizes) in enumerate(tables)])


#: Pixels in a row, and rows at most; more samples go to further files, one after the other.
WIDTH, ROWS = 64, (1 << 14) - 1
SAMPLES = WIDTH
#: Samples that are coded together, about.
TOGETHER = 1 << 18


def encode(samples: bytes) -> bytes:
    """WebP files, one after the other, with the given bytes, a positive multiple of SAMPLES, as 8-bit samples."""
    return encode_all([samples])[0]


def encode_all(samples: list[bytes]) -> list[bytes]:
    """:func:`encode` of each; what can be done for many images in one step is."""
    most, parts, owner = ROWS * SAMPLES, [], []
    for i, x in enumerate(samples):
        if not x or len(x) % SAMPLES:
            raise ValueError(f"the samples must be a positive multiple of {SAMPLES}")
        for at in range(0, len(x), most):
            parts.append(x[at : at + most])
            owner.append(i)
    out: list[list[bytes]] = [[] for _ in samples]
    at = 0
    while at < len(parts):
        end, total = at, 0
        while end < len(parts) and (end == at or total + len(parts[end]) <= TOGETHER):
            total += len(parts[end])
            end += 1
        for i, coded in zip(owner[at:end], _encode(parts[at:end])):
            out[i].append(coded)
        at = end
    return [b"".join(x) for x in out]


def _bits_alone(values: np.ndarray, image: np.ndarray, images: int) -> np.ndarray:
    """Bits that each image's values would take one by one."""
    counts = np.bincount(image * LITERALS + values, minlength=images * LITERALS).reshape(images, -1)
    return -(counts * np.log2(np.maximum(counts, 1) / counts.sum(1, keepdims=True))).sum(1)


def _encode(parts: list[bytes]) -> list[bytes]:
    """A file for each of some images' samples."""
    images = len(parts)
    rows = np.array([len(x) // WIDTH for x in parts])
    whole = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WIDTH)
    top = np.cumsum(rows) - rows  # first row of each image
    of = np.repeat(np.arange(images), rows)
    image = np.repeat(of, WIDTH)
    kinds = [whole, whole.copy(), whole.copy()]  # as it is, and less the sample to the left, or the one above
    kinds[1][:, 1:] -= whole[:, :-1]
    kinds[1][1:, 0] -= whole[:-1, 0]
    kinds[2][1:] -= whole[:-1]
    for k in kinds[1:]:
        k[top, 0] = whole[top, 0]
        k[top, 1:] = whole[top, 1:] - whole[top, :-1]
    mode = np.stack([_bits_alone(k.reshape(-1), image, images) for k in kinds]).argmin(0)
    there = np.bincount(image * LITERALS + whole.reshape(-1), minlength=images * LITERALS).reshape(images, -1) > 0
    few = there.sum(1) <= 16
    heads, planes = [], []
    for i in range(images):
        out = _Out().put((0x2F, 8), (WIDTH - 1, 14), (int(rows[i]) - 1, 14), (0, 1), (0, 3))
        own = slice(top[i], top[i] + rows[i])
        alpha, plane = 255, kinds[mode[i] if not few[i] else 0][own]
        if few[i]:
            values = np.flatnonzero(there[i])
            packed = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
            out.put((1, 1), (PALETTE, 2), (len(values) - 1, 8))
            colours = np.zeros((len(values), 4), np.uint8)
            colours[:, GREEN] = np.diff(values, prepend=0)
            colours[0, ALPHA] = 255
            _put_pixels(out, colours)
            index = np.searchsorted(values, plane).astype(np.uint8).reshape(len(plane), -1, 1 << packed)
            plane = np.bitwise_or.reduce(index << (np.arange(1 << packed, dtype=np.uint8) * np.uint8(8 >> packed)), axis=2)
        elif mode[i]:
            alpha = 0
            blocks = np.zeros((-(-len(plane) >> 9), 4), np.uint8)
            blocks[:] = (mode[i], 0, 0, 255)
            out.put((1, 1), (PREDICTOR, 2), (7, 3))
            _put_pixels(out, blocks)
        heads.append((out.put((0, 1)), alpha))
        planes.append(plane.reshape(-1))
    out = []
    for data in _entropy_coded(heads, planes):
        padded = data + b"\0" * (len(data) & 1)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded)
    return out


def _entropy_coded(heads: list[tuple[_Out, int]], planes: list[np.ndarray]) -> list[bytes]:
    """Main images behind what their heads have: GREEN samples and references, RED and BLUE 0, ALPHA as given, one group of
    codes, no cache."""
    images = len(planes)
    image = np.repeat(np.arange(images), [len(x) for x in planes])
    a = np.concatenate(planes)
    far, length = references(a, image)
    may = np.flatnonzero(far)
    following = np.searchsorted(may, may + length[may]).tolist()
    taken, k, n = [], 0, len(may)
    while k < n:  # the first reference, then the first one after it, and so on
        taken.append(k)
        k = following[k]
    starts = may[taken]
    inside = np.zeros(len(a) + 1, np.int8)
    inside[starts + 1] += 1
    inside[starts + length[starts]] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
    refer = np.zeros(len(a), bool)
    refer[starts] = True
    refer, of = refer[at], image[at]
    values, sizes = np.zeros((len(at), 4), np.int64), np.zeros((len(at), 4), np.int64)
    green = a[at].astype(np.int64)
    size, values[refer, 1], sizes[refer, 1] = _prefixed(length[at[refer]])
    green[refer] = LITERALS + size
    distance, values[refer, 3], sizes[refer, 3] = _prefixed(far[at[refer]] + len(NEIGHBOURS))
    for column, symbol, which, kinds in ((0, green, of, LITERALS + LENGTHS), (2, distance, of[refer], DISTANCES)):
        counts = np.bincount(which * kinds + symbol, minlength=images * kinds).reshape(images, kinds)
        bits = np.zeros((images, kinds), np.int64)
        for i, (out, alpha) in enumerate(heads):
            lengths = code_lengths(counts[i])
            if not column:
                out.put((0, 1), (0, 1))
            _put_code(out, lengths)
            if not column:
                for value in (0, 0, alpha):
                    out.put((1, 1), (0, 1), (1, 1), (value, 8))
            if np.count_nonzero(lengths) > 1:
                bits[i] = lengths
        words = _codewords(bits)
        into = slice(None) if not column else refer
        values[into, column], sizes[into, column] = words[which, symbol], bits[which, symbol]
    return _pack(values, sizes, of, [out for out, _ in heads])


def _pack(values: np.ndarray, sizes: np.ndarray, of: np.ndarray, heads: list[_Out]) -> list[bytes]:
    """For each image what its head has and then the values of its tokens, each of its number of bits, least significant
    first."""
    each = np.bincount(of, sizes.sum(1), len(heads)).astype(np.int64)
    first = np.array([h.n for h in heads])
    octets = (first + each + 7) // 8
    begin = np.cumsum(octets) - octets
    keep = sizes.reshape(-1) > 0
    bits = sizes.reshape(-1)[keep]
    data = values.reshape(-1)[keep].astype(np.uint64)
    shift = 8 * begin + first - (np.cumsum(each) - each)  # from the sum of all bits before to the place
    ends = np.cumsum(bits) + np.repeat(shift[of], 4)[keep]
    starts = ends - bits
    words = np.zeros(int(octets.sum()) // 8 + 2, np.uint64)
    if len(data):
        word, low = starts >> 6, (starts & 63).astype(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[new]] = np.bitwise_or.reduceat(data << low, new)
        over = np.flatnonzero((starts & 63) + bits > 64)
        words[word[over] + 1] |= data[over] >> (np.uint64(64) - low[over])
    stream = bytearray(words.tobytes())
    for h, b in zip(heads, begin.tolist()):
        head = h.value.to_bytes((h.n + 7) // 8, "little")
        last = stream[b + len(head) - 1] if h.n % 8 else 0
        stream[b : b + len(head)] = head
        if h.n % 8:
            stream[b + len(head) - 1] |= last
    return [bytes(stream[b : b + n]) for b, n in zip(begin.tolist(), octets.tolist())]


def samples(data: bytes) -> bytes:
    """The samples of all WebP files in ``data``, one after the other."""
    out, at = [], 0
    while at < len(data):
        stream, at = _stream(data, at)
        image, undo = _read_vp8l(stream)
        if isinstance(image, Green) and not undo:
            out.append(image.plane.tobytes())
            continue
        image = image.full() if isinstance(image, Green) else image
        for f, *args in undo:
            image = f(image, *args)
        out.append(image[..., GREEN].tobytes())
    return b"".join(out)
