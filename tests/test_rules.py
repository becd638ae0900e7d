"""Pure Python rules against hand-derived values."""

import pytest

from siltstone.functions import html, porter, urls
from siltstone.functions import text as tx
from siltstone.operators import rank
from siltstone.operators.crawl import allowed
from siltstone.operators.index import py_shard
from siltstone.operators.query import AND, OR, PHRASE, SINGLE, parse
from siltstone.plans.service import ResultCache, SearchResponse
from tests.plain import best_window


@pytest.mark.parametrize(
    ("text", "raw", "terms"),
    [
        ("The state of the art", 5, ["state", "art"]), ("café NAÏVE", 3, ["caf", "na"]), ("don't well-known x", 3, ["don't", "well-known"]),
        ("distributed systems running", 3, ["distribut", "system", "runn"]), ("being bed sing", 3, ["bed", "sing"]), (None, 0, []), ("", 0, []), ("café", 1, ["caf"]),
    ],
)
def test_terms(text, raw, terms):
    assert (len(tx.py_raw_tokens(text)), tx.py_terms(text)) == (raw, terms)


def test_stop_words():
    assert len(tx.STOP_WORDS) == len(set(tx.STOP_WORDS)) == 182


@pytest.mark.parametrize(("word", "stem"), [w.split(":") for w in "caresses:caress ponies:poni ties:tie cats:cat agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall happy:happi sky:sky skies:sky dying:die relational:relat conditional:condit digitizer:digit generalizations:gener formalize:formal electrical:electr hopefulness:hope adjustment:adjust adoption:adopt probate:probat rate:rate controll:control roll:roll flies:fli enjoy:enjoy".split()])
def test_porter(word, stem):
    assert porter.stem(word) == stem


@pytest.mark.parametrize(
    ("query", "kind", "terms", "negative"),
    [
        ('"inverted index"', PHRASE, ["invert", "index"], []), ("python OR java OR python", OR, ["python", "java"], []), ("python or java", AND, ["python", "java"], []),
        ("programming -java", SINGLE, ["programm"], ["java"]), ("a OR -b2", OR, ["b2"], []), ("search searches", AND, ["search", "searche"], []),
        ("walk walking", AND, ["walk", "walk"], []), ("-java", SINGLE, [], ["java"]), ('""', SINGLE, [], []), ("  ", SINGLE, [], []),
    ],
)
def test_parse(query, kind, terms, negative):
    q = parse(query)
    assert (q.kind, q.terms, q.negative) == (kind, terms, negative)


def test_shards():
    assert {t: py_shard(t) for t in "python java search index distribut system engine".split()} == {"python": 3, "java": 2, "search": 0, "index": 2, "distribut": 3, "system": 1, "engine": 1}
    assert py_shard("python", 0) == 3


def test_idf():
    assert rank.py_idf(2, 10) == pytest.approx(1.4816045409) and rank.py_idf(10, 10) == pytest.approx(0.0465200156)
    assert rank.py_idf(0, 10) == rank.py_idf(1, 0) == 0 and rank.py_idf(15, 10) < 0


def test_pages():
    assert [rank.total_pages(n, 10) for n in (0, 1, 10, 11)] == [0, 1, 1, 2]
    assert rank.total_pages(0, 10, compat=True) == 1 and rank.total_pages(0, 10, early=True, compat=True) == 0


@pytest.mark.parametrize(("url", "out"), [("HTTP://Ex.com/a/#f", "http://Ex.com/a"), ("https://ex.com/?q=a/", "https://ex.com/?q=a"), ("https://ex.com/a?", "https://ex.com/a"), ("http://ex.com/a|b", "http://ex.com/a|b"), ("mailto:x@y", None), ("ftp://a/b", None), ("//ex.com/a", None)])
def test_urls(url, out, spark):
    from pyspark.sql import functions as F

    assert urls.py_normalise(url) == out
    assert spark.createDataFrame([(url,)], "u string").select(urls.normalise(F.col("u"))).first()[0] == out


def test_links():
    assert urls.py_links([" /b ", "#x", "mailto:a@b", "c#f", "/b", "javascript:1", "", "HTTP://O.com/"], "http://e.com/a/") == ["http://e.com/b", "http://e.com/a/c", "http://O.com"]
    with pytest.raises(ValueError):
        urls.valid_seeds(["ftp://x"])
    with pytest.raises(ValueError):
        urls.valid_seeds([])


def test_html():
    page = '<html lang="EN-us"><head><title> T </title><meta name="twitter:description" content=" d "></head><body><nav>menu</nav><h2>two</h2><h1>o<i>ne</i></h1><main><article>in<nav>no</nav></article><script>var x = "</p>";</script>Hel<!-- c -->lo <b>w</b>orld <a href=x>ab</a><a href=y>abc</a></main>out</body></html>'
    got = html.parse(page)
    assert got["title"] == "T" and got["language"] == "en" and got["meta_description"] == "d" and got["headings"] == ["one", "two"]
    assert got["body_text"] == "in Hel lo w orld ab abc" and got["anchor_texts"] == ["abc"] and got["full_text"] == "T T T one two d in Hel lo w orld ab abc"
    assert html.parse("") is None and html.parse("  ") is None and html.parse("<body><h1>only</h1></body>") is None
    assert html.parse("<p>no body <b>tag<p>end")["body_text"] == "no body tag end"
    assert html.crawl_fields("<h1>a <b>b</b></h1><a href='/x'>l</a>", "http://e.com/p") == ("ab", ["http://e.com/x"])


def test_names_of_characters():
    got = html.parse('<title>a &quot</title><body><h1>b &quot</h1>&quot;c&quot; &amp d&lt; &copyright &am <a href="/x?a=1&copy=2">link</a></body>')
    assert got["title"] == "a &quot" and got["headings"] == ["b &quot"] and got["body_text"] == '"c" & d< &copyright &am link'
    assert html.crawl_fields('<a href="/x?a=1&copy=2&amp;b">l</a>', "http://e.com/p")[1] == ["http://e.com/x?a=1&copy=2&b"]


def test_snippet():
    words = [f"w{i}" for i in range(100)]
    words[70] = "Party"
    text = " ".join(words)
    assert best_window(text, ["art"]).startswith("...w41 ") and len(best_window(text, ["art"])) <= 200
    assert best_window(text, ["none"]).startswith("w0 ") and best_window("a b", ["a"]) == "a b" and best_window(None, ["a"]) == ""


def test_robots():
    rules = "User-agent: *\nDisallow: /no\n"
    assert allowed(rules, "http://e.com/yes", "bot") and not allowed(rules, "http://e.com/no/x", "bot") and allowed(None, "http://e.com/no", "bot")


def test_cache():
    now = [0.0]
    cache = ResultCache(10, most=2, clock=lambda: now[0])
    a, b = ResultCache.key(parse("x1 OR y1"), 1, 10), ResultCache.key(parse("x1 or y1"), 1, 10)
    assert a != b and ResultCache.compat_key("python", 1, 10) == "610017eb33e6af29"
    cache.put(a, SearchResponse("q"))
    assert cache.get(a) is not None and cache.get(b) is None
    now[0] = 10
    assert cache.get(a) is None
    for k in "abc":
        cache.put(k, SearchResponse(k))
    assert cache.clear() == 2
