"""Porter stemming with the common extensions: irregular words, short ``ies``, ``y`` after consonants of longer stems,
and the extra second-step rules ``fulli`` and ``logi``. Written from the published description of the algorithm."""

from __future__ import annotations

from functools import lru_cache

# Words with stems of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """``v`` for each vowel and ``c`` for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _closed(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    shape = _shape(word)
    return len(word) > 2 and shape.endswith("cvc") and word[-1] not in "wxy" or len(word) == 2 and shape == "vc"


# The rules of the second, third and fourth step, longest endings first where they overlap.
SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    for end in ("ed", "ing"):
        if w.endswith(end) and "v" in _shape(w[: -len(end)]):
            stem = w[: -len(end)]
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem
    return w


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _second(w[:-2])
    for end, new in SECOND:
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if _measure(stem) else w
    return w[:-1] if w.endswith("logi") and _measure(w[:-3]) else w


def _fourth(w: str) -> str:
    for end in sorted(FOURTH, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else w
    return w


def _last(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or m == 1 and not _closed(stem):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _second(w)
    for end, new in THIRD:
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new if _measure(w[: len(w) - len(end)]) else w
            break
    return _last(_fourth(w))


@lru_cache(1 << 17)
def known_stem(word: str) -> str:
    """:func:`stem`, which knows the words of late; the rest is found again."""
    return stem(word)
