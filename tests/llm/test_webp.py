"""The VP8L decoder on images built bit by bit with every feature."""

import numpy as np
import pytest

from siltstone.llm import webp
from siltstone.llm.webp import ALPHA, BLUE, GREEN, RED, _Out


def lone(out, s):
    return out.put((1, 1), (0, 1), (1, 1), (s, 8))


def lengths(out, per_symbol, symbols):
    """A normal code: all 16 length symbols have codes of four bits, each read most significant bit first."""
    out.put((0, 1), (15, 4))
    for s in webp.CODE_LENGTH_ORDER:
        out.put((4 if s < 16 else 0, 3))
    out.put((0, 1))
    for n in per_symbol + [0] * (symbols - len(per_symbol)):
        out.put((int(f"{n:04b}"[::-1], 2), 4))


def flat(symbols):
    """Lengths of a complete code: 2**k symbols of k bits, or with a few of k + 1."""
    k = symbols.bit_length() - 1
    more = symbols - (1 << k)
    return [k] * ((1 << k) - more) + [k + 1] * (2 * more)


def codes(per_symbol):
    table, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(per_symbol) if n):
        code <<= n - last
        table[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return table


class Image:
    """Entropy-coded pixels with arbitrary symbols."""

    def __init__(self, out, cache_bits=0, top=False, meta=None):
        self.out = out
        out.put(*((1, 1), (cache_bits, 4)) if cache_bits else ((0, 1),))
        if top:
            if meta is None:
                out.put((0, 1))
            else:
                out.put((1, 1), (0, 3))
                meta(out)
        size = 280 + (1 << cache_bits if cache_bits else 0)
        self.sizes = (size, 256, 256, 256, 40)
        self.groups = []

    def group(self):
        tables = []
        for n in self.sizes:
            per = flat(n)
            lengths(self.out, per, n)
            tables.append(codes(per))
        self.groups.append(tables)
        return self

    def put(self, *symbols, group=0):
        """Pairs of (which code, symbol), or raw (bits, count) with which None."""
        for which, s in symbols:
            self.out.put(self.groups[group][which][s] if which is not None else s)

    def pixel(self, p, group=0):
        self.put((0, int(p[GREEN])), (1, int(p[RED])), (2, int(p[BLUE])), (3, int(p[ALPHA])), group=group)


def start(width, height):
    return _Out().put((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3))


def data(out):
    return out.value.to_bytes((out.n + 7) // 8 + 4, "little")


def constant(out, p):
    out.put((0, 1))
    for c in (GREEN, RED, BLUE, ALPHA):
        lone(out, p[c])
    lone(out, 0)


RNG = np.random.default_rng(5)
PIXELS = RNG.integers(0, 256, (6, 5, 4), np.uint8)


def test_literals():
    out = start(5, 6).put((0, 1))
    image = Image(out, top=True).group()
    for p in PIXELS.reshape(-1, 4):
        image.pixel(p)
    assert (webp.decode_vp8l(data(out)) == PIXELS).all()
    with pytest.raises(ValueError):
        webp.decode_vp8l(data(out)[:40])


def test_back_references_and_cache():
    out = start(8, 4).put((0, 1))
    image = Image(out, cache_bits=3, top=True).group()
    p, q = PIXELS[0, 0], PIXELS[0, 1]
    image.pixel(p)
    image.pixel(q)
    key = lambda x: (webp.HASH_MULTIPLIER * (int(x[3]) << 24 | int(x[1]) << 16 | int(x[0]) << 8 | int(x[2])) & 0xFFFFFFFF) >> 29
    image.put((0, 280 + key(q)))
    image.put((0, 256 + 4), (None, (1, 1)), (4, 1))  # length 6, one left
    image.put((0, 256 + 2), (4, 0))  # length 3, one up
    got = [p, q, q] + [q] * 6
    for _ in range(3):
        got.append(got[len(got) - 8])
    while len(got) < 32:
        got.append(PIXELS.reshape(-1, 4)[len(got) % 30])
        image.pixel(got[-1])
    assert (webp.decode_vp8l(data(out)).reshape(-1, 4) == np.array(got)).all()


def test_back_reference_before_the_image():
    out = start(8, 4).put((0, 1))
    image = Image(out, top=True).group()
    image.pixel(PIXELS[0, 0])
    image.put((0, 256 + 2), (4, 0))  # one up, where nothing is
    with pytest.raises(ValueError):
        webp.decode_vp8l(data(out))


def test_groups():
    def meta(out):
        image = Image(out).group()
        for i in range(2 * 2):  # blocks of four of a 5 x 6 image
            image.pixel(np.array([i % 2, 0, 0, 0]))

    out = start(5, 6).put((0, 1))
    image = Image(out, top=True, meta=meta).group().group()
    for y in range(6):
        for x in range(5):
            image.pixel(PIXELS[y, x], group=(2 * (y >> 2) + (x >> 2)) % 2)
    assert (webp.decode_vp8l(data(out)) == PIXELS).all()


def average(a, b):
    return (a + b) // 2


def predict(mode, l, t, tl, tr):
    clamp = lambda x: max(0, min(255, x))
    if mode == 11:
        p = [l[c] + t[c] - tl[c] for c in range(4)]
        far = lambda o: sum(abs(p[c] - o[c]) for c in range(4))
        return l if far(l) < far(t) else t
    one = {
        0: lambda c: 255 if c == ALPHA else 0, 1: lambda c: l[c], 2: lambda c: t[c], 3: lambda c: tr[c], 4: lambda c: tl[c], 5: lambda c: average(average(l[c], tr[c]), t[c]), 6: lambda c: average(l[c], tl[c]),
        7: lambda c: average(l[c], t[c]), 8: lambda c: average(tl[c], t[c]), 9: lambda c: average(t[c], tr[c]), 10: lambda c: average(average(l[c], tl[c]), average(t[c], tr[c])),
        12: lambda c: clamp(l[c] + t[c] - tl[c]), 13: lambda c: clamp(average(l[c], t[c]) + int((average(l[c], t[c]) - tl[c]) / 2)),
    }[mode]
    return [one(c) for c in range(4)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    out = start(5, 6).put((1, 1), (webp.PREDICTOR, 2), (0, 3))
    constant(out, [mode, 0, 0, 255])
    out.put((0, 1))
    image = Image(out, top=True).group()
    px = PIXELS.astype(int).tolist()
    for y in range(6):
        for x in range(5):
            if y == 0:
                guess = px[0][x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = px[y - 1][0]
            else:
                guess = predict(mode, px[y][x - 1], px[y - 1][x], px[y - 1][x - 1], px[y - 1][x + 1] if x < 4 else px[y][0])
            image.pixel([(px[y][x][c] - guess[c]) % 256 for c in range(4)])
    assert (webp.decode_vp8l(data(out)) == PIXELS).all()


def test_colour_transforms():
    signed = lambda v: v - 256 if v > 127 else v
    g2r, g2b, r2b = 40, 200, 120
    out = start(5, 6).put((1, 1), (webp.CROSS_COLOUR, 2), (0, 3))
    constant(out, [g2b, r2b, g2r, 255])
    out.put((1, 1), (webp.SUBTRACT_GREEN, 2), (0, 1))
    image = Image(out, top=True).group()
    for p in PIXELS.reshape(-1, 4).astype(int).tolist():
        red = (p[RED] - (signed(g2r) * signed(p[GREEN]) >> 5)) % 256
        blue = (p[BLUE] - (signed(g2b) * signed(p[GREEN]) >> 5) - (signed(r2b) * signed(p[RED]) >> 5)) % 256
        image.pixel([p[GREEN], (red - p[GREEN]) % 256, (blue - p[GREEN]) % 256, p[ALPHA]])
    assert (webp.decode_vp8l(data(out)) == PIXELS).all()


@pytest.mark.parametrize("colours", [2, 3, 9, 40])
def test_palette(colours):
    palette = RNG.integers(0, 256, (colours, 4), np.uint8)
    index = RNG.integers(0, colours, (6, 5))
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    out = start(5, 6).put((1, 1), (webp.PALETTE, 2), (colours - 1, 8))
    image = Image(out).group()
    for i in range(colours):
        image.pixel(palette[i] - (palette[i - 1] if i else 0))
    out.put((0, 1))
    image = Image(out, top=True).group()
    depth = 8 >> packed
    for y in range(6):
        for x in range(0, 5, 1 << packed):
            green = sum(int(index[y, x + k]) << (k * depth) for k in range(1 << packed) if x + k < 5)
            image.pixel([green, 0, 0, 0])
    assert (webp.decode_vp8l(data(out)) == palette[index]).all()


def test_errors():
    for bad in (b"", b"RIFFxxxx", b"RIFF\x04\0\0\0WEBP"):
        with pytest.raises(ValueError):
            webp.decode(bad)
    with pytest.raises(ValueError):
        webp.encode(b"x")


def test_round_trips():
    """What the encoder writes reads back, whichever transform, code or reference it chose."""
    rng = np.random.default_rng(8)
    prose = b" ".join(rng.choice([b"the", b"of", b"house", b"and", b"Wasser", b"maison."], 3000).tolist())
    kinds = [
        b"\0", b"a", b"ab" * 40, b"abc" * 900, bytes(range(17)) * 9, bytes(range(256)) * 3, bytes(i * 3 % 256 for i in range(9000)), rng.integers(0, 256, 5000, np.uint8).tobytes(), rng.integers(0, 4, 5000, np.uint8).tobytes(),
        prose, prose * 40, b"x" * 200_000, np.minimum(rng.geometric(0.02, 70_000), 255).astype(np.uint8).tobytes(), bytes(range(200)) + b"q" * 10_000,
    ]
    for data_ in kinds:
        padded = data_ + b"\0" * (-len(data_) % webp.SAMPLES)
        coded = webp.encode(padded)
        assert webp.samples(coded) == padded
    assert len(webp.encode((prose * 2)[:16_000])) < 8_000
    whole = b"".join(webp.encode(bytes([i]) * 64) for i in range(5))
    assert webp.samples(whole) == b"".join(bytes([i]) * 64 for i in range(5))
    cut = webp.encode((prose)[:6400])
    for n in (40, 200, len(cut) - 3):
        with pytest.raises(ValueError):
            webp.samples(cut[:n])


def test_transforms_are_chosen():
    kinds = lambda d: {k for k in (webp.PREDICTOR, webp.PALETTE) if _uses(webp.encode(d), k)}

    def _uses(d, kind):
        bits = webp.Bits(d[20:])
        bits.read(40)
        return bool(bits.read(1)) and bits.read(2) == kind

    ramp = bytes(i % 256 for i in range(6400))
    assert kinds(b"abc" * 64) == {webp.PALETTE} and kinds(ramp) == {webp.PREDICTOR} and kinds((b"The quick brown fox jumps over 13 dogs. " * 8)) == set()


def test_code_lengths():
    rng = np.random.default_rng(3)
    for most in (9, 12):
        for n in (1, 2, 3, 19, 280):
            counts = rng.geometric(0.001, n) * (rng.random(n) < 0.8) * (1 << rng.integers(0, 30, n))
            sizes = webp.code_lengths(counts, most)
            used = sizes[sizes > 0]
            assert ((sizes > 0) == (counts > 0)).all() and sizes.max(initial=0) <= most and (len(used) < 2 or sum(2.0 ** -used) == 1)
