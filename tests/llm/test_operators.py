"""Every operator on odd rows and on none, against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import common, labelled_pages, op01_language, op02_mixing, op03_html, op04_tokens, op05_decontamination, op06_jaccard, op07_substring, op08_media, op09_scoring, op10_warc, textkit, webp
from siltstone.llm.components import components
from tests.llm.conftest import A, B, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def bag(rows):
    return Counter(tuple(r) for r in rows)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def test_language(odd, none):
    got = op01_language.identify(odd).collect()
    assert len(got) == odd.count() and none.count() == op01_language.identify(none).count() == 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) and 0 <= r["score"] <= 1
    by = {(r[0], r[1]): any(c.isalpha() for c in r[1] or "") for r in rows()}
    pred = op01_language.predict(odd.select("doc_id", "text"), op01_language.train(odd)).collect()
    assert all((r["lang_pred"] != "und") == by[r["doc_id"], r["text"]] and r["lang_pred"] in ("en", "de", "und") for r in pred)
    assert {r["lang_pred"] for r in op01_language.identify(odd.where("lang is null")).collect()} == {"und"}
    assert op01_language.known_language(odd).columns == odd.columns


def test_language_accuracy(spark):
    rng = random.Random(1)
    vocabulary = {"aa": "the of and that with house water".split(), "bb": "der die und nicht haus wasser".split(), "cc": "le la et maison eau dans".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[x], k=rng.randint(3, 40))), x) for i in range(600) for x in [rng.choice(list(vocabulary))]]
    got = {r["doc_id"]: r for r in op01_language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=100).collect()}
    held = [x == got[i]["lang_pred"] for i, _, x in rows if got[i]["held_out"]]
    assert len(held) > 100 and sum(held) / len(held) > 0.99


def test_language_of_copies(spark):
    """A language of few texts copied very often is learned from all of them."""
    rng = random.Random(7)
    vocabulary = {"aa": "the of and that with house water".split(), "bb": "der die und nicht haus wasser".split(), "cc": "le la et maison eau dans".split()}
    text = lambda x: " ".join(rng.choices(vocabulary[x], k=12))
    few = [text("cc") for _ in range(8)]
    rows = [(i, text(x), x) for i in range(400) for x in [("aa", "bb")[i % 2]]] + [(1000 + i, few[i % 8], "cc") for i in range(8000)]
    model = op01_language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=40)
    assert model.langs == ["aa", "bb", "cc"] and all(model.predict(t.encode())[0] == "cc" for t in few)


def test_language_model_in_plain_python():
    """TF-IDF, follow-the-regularised-leader and the temperature against sums written out one by one."""
    rng, alpha, beta, l1, l2 = random.Random(11), 2.0, 1.0, 0.02, 0.02
    texts = [("".join(rng.choices(a, k=rng.randint(3, 12))).encode(), y) for y, a in enumerate(("abc ", "bcd ", "xyz é")) for _ in range(8)]
    rows = [(y, *op01_language.term_counts(t)) for t, y in texts]
    idf = np.ones(op01_language.DIMS) * np.linspace(0.5, 2, op01_language.DIMS)
    model = op01_language.Model(["a", "b", "c"], idf)
    model.fit(rows, epochs=2)
    z, n = defaultdict(float), defaultdict(float)

    def leader(i, k):
        penalty = 0.0 if i == "bias" else l1
        if abs(z[i, k]) <= penalty:
            return 0.0
        return -(z[i, k] - math.copysign(penalty, z[i, k])) / ((beta + math.sqrt(n[i, k])) / alpha + l2)

    def vector(at, counts):
        v = {int(i): float((1 + math.log(c)) * np.float32(idf[i])) for i, c in zip(at, counts)}
        size = math.sqrt(sum(a * a for a in v.values()))
        return {i: a / size for i, a in v.items()}

    for epoch in range(2):
        for j in np.random.default_rng(epoch).permutation(len(rows)):
            y, at, counts = rows[j]
            v = vector(at, counts) | {"bias": 1.0}
            w = {(i, k): leader(i, k) for i in v for k in range(3)}
            e = [math.exp(sum(v[i] * w[i, k] for i in v)) for k in range(3)]
            for i in v:
                for k in range(3):
                    g = v[i] * (e[k] / sum(e) - (k == y))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / alpha * w[i, k]
                    n[i, k] += g * g
    for i, k in list(z):
        got = model.bias[k] if i == "bias" else model.weights[i, k]
        assert got == pytest.approx(leader(i, k), abs=1e-4)
    assert np.count_nonzero(model.weights) < np.count_nonzero([v for (i, _), v in z.items() if i != "bias"])  # the elastic net leaves zeros
    model.calibrate(rows)
    loss = lambda t: -sum(math.log(op01_language.softmax(model.logits(at, c).astype(float) / t)[y]) for y, at, c in rows)
    assert all(loss(model.temperature) <= loss(t) + 1e-6 for t in np.geomspace(0.05, 10, 30))


def test_too_many_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words", f"l{i % 3}") for i in range(9)], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(op01_language, "LANGUAGES", 3)
    assert op01_language.train(docs).langs == ["l0", "l1", "l2"]
    monkeypatch.setattr(op01_language, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        op01_language.train(docs)


def mixed(rows):
    """The mix by sorting, in plain Python."""
    size = [(r[0], r[3], len(words(r[1]))) for r in rows]
    totals = Counter()
    for _, s, n in size:
        totals[s] += n
    return mixed_totals(totals | {x[1]: totals[x[1]] for x in size})


def mixed_totals(totals):
    order = sorted(s for s in totals if s is not None) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(totals.values()) - sum(3 * totals[s] for s in capped)
        target = {s: 3.0 * totals[s] if s in capped else weight[s] * left / sum(weight[x] for x in free) for s in order}
        more = {s for s in free if target[s] > 3 * totals[s]}
        if not more:
            return totals, target
        capped |= more


def test_mixing(odd, none, spark):
    got = op02_mixing.mix_sources(odd).collect()
    totals, target = mixed(rows())
    assert bag((r["doc_id"], r["size"]) for r in got) == bag((r[0], len(words(r[1]))) for r in rows())
    taken = Counter()
    for r in got:
        assert r["source_size"] == totals[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in totals)
    assert bag(got) == bag(op02_mixing.mix_sources(odd.repartition(7)).collect()) and op02_mixing.mix_sources(none).count() == 0
    copies = op02_mixing.mixed_documents(odd)
    assert copies.columns == odd.columns
    assert sum(len(words(r["text"])) for r in copies.collect()) == sum(taken.values())
    many = spark.createDataFrame([(i, "w " * (i % 7), None, f"s{i % 3}") for i in range(3000)], "doc_id bigint, text string, lang string, source string")
    totals, target = mixed([tuple(r) for r in many.collect()])
    taken = Counter()
    for r in op02_mixing.mix_sources(many).collect():
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 4 for s in totals)  # half a document and a word


def test_mixing_splits_equal_ids(spark):
    """Rows of one doc_id, and equal rows, are taken one by one."""
    same = [(None, "w " * 10, None, "b")] * 700 + [(None, "w " * 10 + f"{i}", None, "a") for i in range(100)] + [(5, "x y", None, "c")] * 300 + [(6, None, None, "d"), (6, "", None, None)]
    docs = spark.createDataFrame(same, "doc_id bigint, text string, lang string, source string").repartition(5)
    totals, target = mixed(same)
    got = op02_mixing.mix_sources(docs).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert len(got) == len(same) and all(abs(taken[s] - target[s]) <= 6 for s in totals) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert bag(got) == bag(op02_mixing.mix_sources(docs.repartition(3)).collect())
    assert Counter(r["source"] for r in op02_mixing.mixed_documents(docs).collect())["b"] == taken["b"] // 10


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    """Shares of many sources against the rule step by step."""
    rng = random.Random(seed)
    rows = [(f"s{s}", s, rng.choice([0, 1, 5, 40, 1000, 10**6, 10**9])) for s in rng.sample([*"abcdefghijklmnopqrstuvwxyz", "é", "漢", "A", ""], 20)] + [("n", None, 7)]
    totals, want = mixed_totals({s: n for _, s, n in rows})
    got = op02_mixing.source_targets(spark.createDataFrame(rows, "key string, source string, source_size bigint").repartition(4)).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want) and all(r["budget"] == pytest.approx(int(r["target"]), abs=1) for r in got)


S1 = "The harbour opened in spring after two years of work and a long debate about its cost."
S2 = "Ships of every size may now turn inside the outer wall, and the old pier serves walkers."
S3 = "Fishing boats keep the eastern basin, where nets are dried on the quay each evening."
#: Pages that no weight was learned from, and their main text.
PAGES = [
    (f"<html><body><form id=aspnetForm action=/><div class=page><h1>Harbour opens</h1><p>{S1}</p><p>{S2}</p><p>{S3}</p></div></form></body></html>", ["Harbour opens", S1, S2, S3]),
    ("".join(f'<div class="elementor-widget-container"><p>{x}</p></div>' for x in (S1, S2, S3)), [S1, S2, S3]),
    (f"<nav><a href=/>Home</a><a href=/n>News</a></nav><div><h1>Harbour opens</h1><p>{S1}</p><p>{S2}</p><p>{S3}</p></div><article><h3><a href=/b>Bread prices</a></h3><p>Short teaser text here.</p></article>", ["Harbour opens", S1, S2, S3]),
    (f"<article><p>Total is <label>five</label> kilos.</p><p>{S1}</p></article>", ["Total is five kilos.", S1]), (f"<body><div><a href=/>Home page of site</a></div><div><p>{S1}</p><p>{S2}</p></div>", [S1, S2]),
    ("plain words only", ["plain words only"]), (S1, [S1]), ("<nav>a b</nav><script>x</script>", []), ("<article><p>cut in the mid", ["cut in the mid"]), ("a < b and <c", ["a < b and"]), ("", []),
    (f"<article><p>{S1}</p> <div class='ad'>buy now this thing</div><p>{S2}</p></article><div class=comments><p>me too</p></div>", [S1, S2]),
    (f"<html><body><article><p>{S1}</p><p>{S2}</p></article><section><h3>Comments</h3><p>Great piece, thank you!</p><p>I was there as well and saw it.</p></section></body></html>", [S1, S2]),
    (f"<div class='cookie-notice'>We use cookies to remember you. <button>Accept</button></div><article><p><b>{S1}<br><p>{S3}</p></article><footer><p>Written by the editors</p><p>Terms of use</p></footer>", [S1, S3]),
    (f"<ul class='nav'><li><a href=/a>Start</a><li><a href=/b>Archive</a></ul><table><tr><td><p>{S2}</p><blockquote>{S3}</blockquote></td></tr></table>", [S2, S3]),
    (f"<p>{S1}</p><!-- advert --><div class='promo banner'>Subscribe today and save a third on your first year of the paper</div><p>{S2}</p><p>{S3}</p>", [S1, S2, S3]),
    ("<article><p>a &amp; b&nbsp;c &lt;d&gt; and more of it.<p>e<b>f</b>\n g goes on, too.</article><footer>x</footer>", ["a & b c <d> and more of it.", "ef g goes on, too."]),
    (f"<article><svg/><p title='a > b'>{S1}<p data-x=\"'\">{S2}<style>p{{}}</style></article><aside><h4>Related</h4><a href=/>Older stories about piers</a></aside><footer>&copy; Port office, all rights reserved</footer>", [S1, S2]),
]


def test_html(spark):
    weights = op03_html.learned()
    for html, text in PAGES:
        assert op03_html.main_text(html, weights) == "\n\n".join(text), html
    rows = [(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(99, None, None, None), (None, "u", PAGES[0][0], None), (0, "u", PAGES[0][0], "x"), (50, "u", "<article>" + "".join(f"<p>{S1}</p>" for _ in range(5000)), None)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = op03_html.extract(table)
    got = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    want = [(i, u, "" if h is None else "\n\n".join([S1] * 5000) if i == 50 else "\n\n".join(next(t for p, t in PAGES if p == h))) for i, u, h, _ in rows]
    assert bag((r["page_id"], r["url"], r["text"]) for r in got) == bag(want)
    assert op03_html.extract(table.limit(0)).count() == 0


def test_html_learns_other_sites():
    """Pages of another seed: almost every block is told right, and nothing hangs on the names of one kind."""
    weights, right, wrong, lost = op03_html.learned(), 0, 0, 0
    assert all(w < 0 for w in weights.tags.values()) and len(weights.keep) > 500
    for html, main in labelled_pages.pages(150, seed=7):
        got, want = Counter(x for x in op03_html.main_text(html, weights).split("\n\n") if x), Counter(main)
        right, wrong, lost = right + sum((got & want).values()), wrong + sum((got - want).values()), lost + sum((want - got).values())
    assert right / (right + wrong) > 0.97 and right / (right + lost) > 0.95


def test_html_region():
    rng = random.Random(4)
    for _ in range(300):
        v = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 3]) for _ in range(rng.randint(0, 14))]
        best = max([sum(v[a:b]) for a in range(len(v)) for b in range(a + 1, len(v) + 1)], default=0)
        a, b = op03_html.region(v)
        assert sum(v[a:b]) == max(best, 0) and ((a, b) == (0, 0)) == (best <= 0)


def test_html_takes_time_in_proportion():
    weights, took = op03_html.learned(), []
    for n in (20_000, 160_000):
        began = time.process_time()
        for part in ('<b "', "<b ='", "<!--", "<script>", "<div>", "<p><b><i>", "<li>", "<a href=x>", "</b>", "<", "&lt", '<b x="'):
            op03_html.main_text(part * (n // len(part)) + '">x', weights)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.05)


def test_tokens(odd, none):
    library = stock()
    manifest = op04_tokens.write_tokens(odd, length=64, batch=4)
    got = op04_tokens.read_tokens(manifest).collect()
    want = [np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows()]
    assert bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == bag((r[0], len(w), zlib.crc32(w.tobytes())) for r, w in zip(rows(), want))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    files = [op04_tokens.TokenFile(r["file"]) for r in manifest.orderBy("part").collect()]
    stream = np.concatenate([np.concatenate(list(f.batches())) for f in files])
    masks = np.concatenate([f.sequence(k, 4)[1] for f in files for k in range(sum(f.reader.get_batch(i).num_rows for i in range(f.reader.num_record_batches)))])
    assert len(stream) == len(masks) and masks.sum() == at
    assert op04_tokens.read_tokens(op04_tokens.write_tokens(none)).count() == 0


def stock():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op04_tokens.tokenizer_path())


@pytest.mark.parametrize("keep", [50, 500_000])
def test_encoder(keep):
    """Against the library as it comes, with white space of every kind, contractions and the added token anywhere."""
    rng = random.Random(2)
    encoder, library = op04_tokens.Encoder(op04_tokens.tokenizer_path(), keep=keep), stock()
    parts = ["a", "b c", " ", "  ", "\n", "\t", "\r\n", "\n\n", ".", ",", "'s", "don't", "'", "x'", "ll", "(", ")", "-", "é", "à", "É", "\u00a0", " \n", "\u3000", "\u2003", "\x85", "\x01", "\x1c", "\x7f", "<|endoftext|>", "#", "12", "漢", "🙂", "word,", "\u0301", "_", "“", "–", "\ufeff"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)]
    texts += ["<|endoftext|>", "<|endoftext|> b", "a <|endoftext|> b", "a<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext", ""]
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        ids, sizes = encoder.encode([t.encode() for t in part])
        for t, got in zip(part, np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_decontamination(odd, none, spark):
    items = [(1, A), (2, " ".join(B.split()[5:30])), (3, "One TWO"), (4, None), (5, ""), (6, "漢字"), (None, "x " * 20), (7, "never seen words"), (1, "y y y"), (8, "alpha0 alpha1"), (8, "alpha0 alpha1")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    def expected(text):
        w, hit, who = find(text), set(), set()
        for i, t in items:
            x = find(t)
            n = min(13, len(x))
            wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if x else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    who.add("" if i is None else str(i))
        return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)
    got = op05_decontamination.decontaminate(odd, bench).drop("k1", "k2").collect()
    assert bag(got) == bag((r[0], *expected(r[1])) for r in rows())
    assert bag(op05_decontamination.clean_documents(odd, bench).collect()) == bag(r for r in map(tuple, odd.collect()) if not expected(r[1])[-1])
    assert op05_decontamination.decontaminate(none, bench).count() == 0 and not any(r["contaminated"] for r in op05_decontamination.decontaminate(odd, bench.limit(0)).collect())
    near = op05_decontamination.proximity(odd, spark.createDataFrame([(1, "alpha5 alpha9"), (2, "alpha0 beta0")], "item_id bigint, text string"), 10)
    assert {r["item_id"] for r in near.collect()} == {"1"}
    again = spark.createDataFrame([(1, "x " * 40), (2, "a x " * 30), (3, "x"), (4, "Z\x00x.x")], "item_id bigint, text string")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["x " * 100, "x " * 12, "y a x " * 20, "x a " * 50, "X"])], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in op05_decontamination.decontaminate(texts, again).collect()}
    assert got == {0: (100, 100, 2), 1: (12, 12, 1), 2: (60, 20, 1), 3: (100, 100, 2), 4: (1, 1, 1)}


def test_hashes_of_long_texts(monkeypatch):
    """Blocks change nothing: equal words and windows hash alike wherever they stand."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab é \n", k=rng.randint(0, 400))).encode() for _ in range(30)] + [b"x" * 300, b"", b" y"]
    whole = textkit.words(texts, lower=True)
    hashes, inside = textkit.windows(whole, 3)
    for block in (1, 7, 64):
        monkeypatch.setattr(textkit, "BLOCK", block)
        monkeypatch.setattr(textkit, "_tables", [])
        part = textkit.words(texts, lower=True)
        assert all((getattr(part, x) == getattr(whole, x)).all() for x in ("starts", "ends", "first", "hashes"))
        got, at = textkit.windows(part, 3)
        assert (got == hashes).all() and (at == inside).all()
    by: dict = {}
    for a, b, h in zip(whole.starts, whole.ends, whole.hashes):
        by.setdefault(whole.buffer[a:b], set()).add(int(h))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_small(spark):
    table = spark.createDataFrame([(i, "x" * 100) for i in range(100)], "i int, s string")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.small(table)) and not hinted(common.small(table, rows=99)) and not hinted(common.small(table, size=10_000)) and hinted(common.small(table.select("i"), size=10_000))


def linked(rows, k, percent):
    sets = [(lambda w: frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))(words(r[1], True)) for r in rows]
    parent = list(range(len(rows)))
    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    degree = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
                degree[i] += 1
                degree[j] += 1
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(s), least.get(find(i), None) if s else r[0], degree[i], find(i)) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize(("k", "percent", "limits"), [(3, 90, {}), (5, 80, {"run_rows": 2, "block_rows": 3})])
def test_jaccard(odd, none, spark, k, percent, limits, monkeypatch):
    if limits:
        monkeypatch.setattr(op06_jaccard, "COMMON", 4)
    rng = random.Random(k)
    base = [f"v{i}" for i in range(60)]
    more = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"n{rng.randrange(9)}"
        more.append((100 + i, " ".join(w[: rng.choice([60, 60, 58, 30])]), None, None, None, None, None, None))
    every = [*rows(), *more]
    docs = spark.createDataFrame(every, odd.schema)
    got = op06_jaccard.link_components(docs, k, percent, **limits).drop("k1", "k2", "root").collect()
    assert bag(got) == bag(x[:4] for x in linked(every, k, percent))
    assert op06_jaccard.link_components(none, k, percent).count() == 0


def test_one_of_each(odd):
    kept = op06_jaccard.one_of_each(odd)
    want = linked(rows(), 5, 80)
    assert kept.columns == odd.columns
    group = {(r[0], r[1]): x[4] for r, x in zip(rows(), want) if x[1]}
    left = Counter(group.get((r["doc_id"], r["text"]), "wordless") for r in kept.collect())
    assert left == {**dict.fromkeys(group.values(), 1), "wordless": sum(not words(r[1]) for r in rows())}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100), (150, 200), (7, 7), (300, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 200: 100, 150: 100, 301: 300}


def test_substring(odd, none, spark):
    rng = random.Random(3)
    def expected(every):
        key = lambda i: 1 << 63 if i is None else i
        first: dict = {}
        for r in every:
            w = words(r[1])
            for j in range(len(w) - 12):
                x = tuple(w[j : j + 13])
                first[x] = min(key(r[0]), first.get(x, 1 << 64))
        out = []
        for r in every:
            w = words(r[1])
            gone = {p for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < key(r[0]) for p in range(j, j + 13)}
            out.append((r[0], len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
        return out
    assert bag(op07_substring.dedup_substrings(odd).collect()) == bag(expected(rows()))
    pool = [" ".join(rng.choices("abc", k=40)) for _ in range(12)] + ["q " * 25, "r s " * 20]
    every = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 4)) + rng.choices("abcd", k=rng.randint(0, 9))), *[None] * 6) for i in range(80)]
    assert bag(op07_substring.dedup_substrings(spark.createDataFrame(every, odd.schema).repartition(5)).collect()) == bag(expected(every))
    assert op07_substring.dedup_substrings(none).count() == 0


def test_media(odd, none, spark):
    media = op08_media.encode_media(odd)
    got = op08_media.media_features(media).collect()
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((r[0], len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert bag(tuple(r)[:5] for r in got) == bag(want)
    assert len({r["payload_sha256"] for r in got}) == len({(r["payload_sha256"], r["feature"], r["media_sha256"]) for r in got})
    sizes = op08_media.decode_pixels(media).collect()
    assert all(len(r["pixels"]) == 4 * r["width"] * r["height"] for r in sizes) and len(sizes) == len(rows()) and op08_media.media_features(op08_media.encode_media(none)).count() == 0
    big = bytes(range(256)) * 4100
    assert webp.samples(webp.encode(op08_media.payload(big))) == op08_media.payload(big)
    long = spark.createDataFrame([(1, "é" * 600_000), (2, None)], "doc_id bigint, text string")
    images = op08_media.decode_pixels(op08_media.encode_media(long)).collect()
    assert sorted((r["doc_id"], r["image"], r["width"]) for r in images) == [(1, 0, 64), (1, 1, 64), (2, 0, 64)]
    green = {i: b"".join(bytes(r["pixels"])[1::4] for r in sorted(images, key=lambda r: r["image"]) if r["doc_id"] == i) for i in (1, 2)}
    assert green == {1: ("é" * 600_000).encode(), 2: b"\0" * 64}


def test_scoring(odd, none, spark):
    from pyspark.sql import functions as F

    from siltstone.llm.common import crc_fold

    docs = odd.withColumn("training", crc_fold("doc_id", 7) != 2)
    got = op09_scoring.score_documents(docs, top=20).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    count = Counter()
    for r in rows():
        if not held(r[0]):
            count.update([*words(r[1], True), None])
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for r in rows():
        t = [*words(r[1], True), None]
        want[r[0]].append((held(r[0]), len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 6)))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((*tuple(r)[1:5], round(r["base_score"], 6)))
        assert r["score"] < 0
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    assert op09_scoring.score_documents(none.withColumn("training", F.lit(True))).count() == 0
    alone = op09_scoring.score_documents(odd.withColumn("training", F.lit(False))).collect()
    assert all(r["n_known"] == r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in alone)


def test_scoring_learns_rare_bigrams(spark):
    """Against the dense model over all words: pairs of words of any rank count."""
    rng = random.Random(6)
    every = []
    for i in range(300):
        w = [x for _ in range(15) for j in [rng.randrange(700)] for x in (f"a{j}", f"b{j}")] + [f"c{rng.randrange(5)}" for _ in range(9)]
        every.append((i, " ".join(w), i % 7 != 2))
    every += [(1000, " ".join(f"a{j} b{j}" for j in range(650, 690)), False), (1001, " ".join(f"a{j} b{j + 1}" for j in range(650, 690)), False), (1002, "a1 never b1", False)]
    got = {r["doc_id"]: r["score"] for r in op09_scoring.score_documents(spark.createDataFrame(every, "doc_id bigint, text string, training boolean").repartition(3)).collect()}
    number = {x: i for i, x in enumerate(sorted({x for _, t, training in every if training for x in t.split()}))}
    end, other = len(number), len(number) + 1
    counts = np.zeros((2, other + 1, other + 1), np.int64)
    ids = {i: [*(number.get(x, other) for x in t.split()), end] for i, t, _ in every}
    for i, _, training in every:
        if training:
            for a, b in zip([end, *ids[i]], ids[i]):
                counts[int(zlib.crc32(str(i).encode()) % 7 == 3), a, b] += 1
    model = op09_scoring.Model(*counts)
    for i, w in ids.items():
        assert got[i] == pytest.approx(sum(model.logs[a, b] for a, b in zip([end, *w], w)), rel=1e-3)
    assert got[1000] > got[1001] + 40  # 1,400 words: most rank below 1,023, and their pairs tell


def test_model_is_a_distribution():
    rng = np.random.default_rng(4)
    counts = [rng.poisson(2, (16, 16)) * (rng.random((16, 16)) < 0.5) for _ in range(2)]
    model = op09_scoring.Model(*counts)
    assert np.allclose((10.0 ** model.logs).sum(1), 1, atol=1e-5) and np.allclose(model.weights.sum(1), 1)


def test_warc(spark):
    big, small = "é" * 80, "x" * 99
    pages = [(5, "http://a/ b\nc", big), (3, "http://a/2", big), (9, None, big), (None, "u", big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (7, "u", "<p>\r\n\r\n</p>" * 100), (3, "again", big)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    index = op10_warc.write_warc(table)
    want = []
    for i, url, h in pages:
        p = (h or "").encode()
        again = len(p) >= 100 and h == big and i != 3
        want.append((i, url, b"" if again else p, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert bag((r[0], r[1], bytes(r[2]), *tuple(r)[3:]) for r in op10_warc.read_warc(index).collect()) == bag(want)
    assert {r["page_id"] for r in op10_warc.read_warc(index.where("page_id = 7")).collect()} == {7}
    assert op10_warc.read_warc(op10_warc.write_warc(table.limit(0))).count() == 0


def test_warc_ranges(spark):
    """Records larger than a read, gaps larger than those that are read through, and columns whose names clash."""
    rng = random.Random(12)
    pages = [(i, f"u{i}", f"{rng.getrandbits(8 * n):x}", "x", 1) for i, n in enumerate([200_000, 150_000, 10, 250_000, 200_000, 12_000_000, 70_000])]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string, file string, offset int").coalesce(1)
    index = op10_warc.write_warc(table)
    assert index.agg({"length": "max"}).first()[0] > op10_warc.SPAN
    for ids in ([0, 3, 4], [5], [0, 1, 2, 3, 4, 5, 6], [2, 6]):
        got = {r["page_id"]: bytes(r["payload"]).decode() for r in op10_warc.read_warc(index.where(index.page_id.isin(ids))).collect()}
        assert got == {i: pages[i][2] for i in ids}
