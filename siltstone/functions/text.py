"""Text to terms: the same rules as Column expressions for data and as plain Python for queries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siltstone.functions import porter

TOKEN = r"[a-z0-9]+(?:['\-][a-z0-9]+)*"
SHORTEST, LONGEST = 2, 64
#: White space as Unicode has it, for Java's regular expressions.
SPACE = r"(?U)\s+"

# The stop words, and the endings that the suffix stemmer takes off, the first that fits.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here "
    "there when where why how all both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y "
    "ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn http https www com org net edu gov html htm php "
    "click read see also via page site website web link url copyright rights reserved privacy policy cookie cookies terms"
).split()
SUFFIXES = ("ing", "tion", "ed", "er", "ly", "ness", "ment", "s")

_STOP = frozenset(STOP_WORDS)
_TOKEN = re.compile(TOKEN)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. Only texts with combining marks go to Python; for all others it changes no token."""
    marked = text.rlike(r"\p{M}")
    return F.when(marked, _nfc(F.when(marked, text))).otherwise(text)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def kept_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: F.length(x).between(SHORTEST, LONGEST) & ~x.isin(*STOP_WORDS))


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(*STOP_WORDS)


def suffix_stem(word: Column) -> Column:
    out = word
    for s in reversed(SUFFIXES):
        out = F.when(word.endswith(s) & (F.length(word) - len(s) > 2), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


@F.pandas_udf(StringType())
def _porter(words: pd.Series) -> pd.Series:
    return words.map(porter.stem)


def stem_column(rows: DataFrame, word: str, stemmer: str) -> DataFrame:
    """``rows`` with ``term``, the stem of column ``word``. Porter runs in Python once for each different word."""
    if stemmer == "suffix":
        return rows.withColumn("term", suffix_stem(F.col(word)))
    if stemmer != "porter":
        raise ValueError(f"unknown stemmer {stemmer}")
    vocabulary = rows.select(word).distinct().withColumn("term", _porter(F.col(word)))
    return rows.join(vocabulary, word)


@F.arrow_udf(ArrayType(StringType()))
def _porter_texts(words: pa.Array) -> pa.Array:
    each = words.values.dictionary_encode()
    stems = pa.array([porter.known_stem(w) for w in each.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(words.offsets, stems.take(each.indices))


def stems(words: Column, stemmer: str) -> Column:
    """The stems of an array of words, in its order."""
    if stemmer == "suffix":
        return F.transform(words, suffix_stem)
    if stemmer != "porter":
        raise ValueError(f"unknown stemmer {stemmer}")
    return _porter_texts(F.coalesce(words, F.array().cast("array<string>")))


def py_stem(word: str, stemmer: str = "suffix") -> str:
    if stemmer == "porter":
        return porter.stem(word)
    for s in SUFFIXES:
        if word.endswith(s) and len(word) - len(s) > 2:
            return word[: -len(s)]
    return word


def py_raw_tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFC", text).lower()) if text else []


def py_terms(text: str | None, stemmer: str = "suffix") -> list[str]:
    return [py_stem(w, stemmer) for w in py_raw_tokens(text) if SHORTEST <= len(w) <= LONGEST and w not in _STOP]


def token_rows(docs: DataFrame, stemmer: str = "suffix", compose: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) to a row per kept token: doc_id, doc_len (all tokens), position (kept tokens only), term.
    ``compose``: texts are composed first, as query words are.

    The outer explode keeps the optimiser from evaluating the token array again for a filter on its size."""
    text = nfc(F.col("text")) if compose else F.col("text")
    x = docs.select("doc_id", raw_tokens(text).alias("raw"))
    x = x.select("doc_id", F.size("raw").alias("doc_len"), F.posexplode_outer(kept_tokens(F.col("raw"))).alias("position", "word"))
    return stem_column(x.where(F.col("word").isNotNull()), "word", stemmer).select("doc_id", "doc_len", "position", "term")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is found once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def grouped(terms: Column) -> Column:
    """The terms of one text to an array of (term, positions ascending), by term: sorted, then cut where the term changes."""

    def starts(s: Column) -> Column:
        new = F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["term"] != x["term"]), i))
        return F.filter(new, lambda i: i.isNotNull())

    def cut(s: Column, at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(s))
        return F.transform(at, lambda b, k: F.struct(F.get(s, b)["term"].alias("term"), F.slice(s, b + 1, end(k) - b)["position"].alias("positions")))

    placed = F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("position"))))
    return _once(placed, lambda s: _once(starts(s), lambda at: cut(s, at)))


def term_arrays(docs: DataFrame, stemmer: str = "suffix", compose: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, doc_len (all tokens) and terms, the kept tokens' stems in their order."""
    text = nfc(F.col("text")) if compose else F.col("text")
    x = docs.select("doc_id", raw_tokens(text).alias("raw"))
    return x.select("doc_id", F.size("raw").alias("doc_len"), stems(kept_tokens(F.col("raw")), stemmer).alias("terms"))


def repeated(docs: DataFrame) -> bool:
    """Whether rows share a doc_id; then what belongs to it isn't in one row."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def token_counts(docs: DataFrame, compose: bool = True) -> DataFrame:
    """doc_id, token_count (all tokens) and kept_count of every row of ``docs`` (doc_id, text)."""
    raw = F.coalesce(raw_tokens(nfc(F.col("text")) if compose else F.col("text")), F.array().cast("array<string>"))
    x = docs.select("doc_id", raw.alias("raw"))
    return x.select("doc_id", F.size("raw").alias("token_count"), F.size(kept_tokens(F.col("raw"))).alias("kept_count"))
