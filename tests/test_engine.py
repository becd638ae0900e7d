"""DataFrame operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.functions import text as tx
from siltstone.operators import crawl as cr
from siltstone.operators import index as ix
from siltstone.operators import query as qy
from siltstone.operators import rank
from siltstone.operators.snippet import snippet
from siltstone.plans import catalog
from siltstone.plans.service import SearchEngine, hydrate
from siltstone.sources import store
from siltstone.streaming.incremental import index_stream, raw_documents
from tests.plain import best_window

MINI = [("d1", "red fox jump"), ("d2", "fox red jump"), ("d3", "red fox"), ("d4", "jump"), ("d5", None), ("d6", "")]


@pytest.fixture(scope="module")
def index(spark):
    return ix.build(spark.createDataFrame(MINI, "doc_id string, text string"))


def found(index, query, **settings):
    return {r["doc_id"] for r in qy.search(index, qy.parse(query), Settings(**settings)).collect()}


@pytest.mark.parametrize(
    ("query", "default", "compat"),
    [
        ('"red fox"', {"d1", "d3"}, None), ("red jump", {"d1", "d2"}, None), ("red OR jump", {"d1", "d2", "d3", "d4"}, None), ("fox -jump", {"d3"}, None), ("red fox -jump", {"d3"}, {"d1", "d2", "d3"}),
        ("red zzz", set(), {"d1", "d2", "d3"}), ("-red", set(), None), ('"fox"', {"d1", "d2", "d3"}, None), ("zzz", set(), None), ('"the red of fox"', {"d1", "d3"}, None),
    ],
)
def test_matching(index, query, default, compat):
    assert found(index, query) == default
    assert found(index, query, compat=True) == (default if compat is None else compat)


def test_statistics(index):
    assert (index.total_docs, index.total_tokens) == (6, 9) and index.avg_doc_length == 1.5
    rows = index.postings.collect()
    assert all(len(r["positions"]) == r["tf"] and r["shard"] in range(4) and r["positions"] == sorted(r["positions"]) for r in rows)
    assert {r["term"]: r["df"] for r in index.term_stats.collect()} == {"red": 3, "fox": 3, "jump": 3}
    assert index.lookup([]).count() == 0


def test_scores(spark):
    x = spark.createDataFrame([(3, 0), (3, 50), (3, 100), (3, 200)], "tf int, dl int").select(F.round(rank.idf(F.lit(2), 10) * rank.tf_norm(F.col("tf"), F.col("dl"), 100.0), 6))
    assert [r[0] for r in x.collect()] == [3.292455, 2.822104, 2.469341, 1.975473]


def test_order_and_pages(index):
    m = qy.search(index, qy.parse("red OR jump"))
    pages = [rank.page(m, n, 3).collect() for n in (1, 2)]
    assert [r["rank"] for p in pages for r in p] == [1, 2, 3, 4] and [r["rank"] for r in rank.page(m, 2, 3, compat=True).collect()] == [1]
    scores = [r["score"] for p in pages for r in p]
    assert scores == sorted(scores, reverse=True) and pages[0][0]["matched_terms"] == ["red", "jump"]


def test_twin_tokenizers(spark):
    texts = ["The café's well-known STATE -- don't!", "a1-b2-c3 'quoted' re-", "x" * 70, "café au lait", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for stemmer in ("suffix", "porter"):
        got: dict = {}
        for r in tx.token_rows(docs, stemmer, compose=True).orderBy("doc_id", "position").collect():
            got.setdefault(r["doc_id"], []).append(r["term"])
        assert got == {i: t for i, x in enumerate(texts) if (t := tx.py_terms(x, stemmer))}


def test_snippets(spark):
    texts = [" ".join(f"word{i}{'art' if i in at else ''}" for i in range(n)) for n, at in ((100, {70, 75}), (41, {40}), (31, {1}), (5, set()), (60, {29, 30}))] + [None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in docs.withColumn("s", snippet(F.col("text"), ["art", "word7"])).collect():
        assert r["s"] == best_window(r["text"], ["art", "word7"])


def _doc(spark, rows):
    base = store.empty(spark).schema
    x = spark.createDataFrame(rows, "url string, title string, raw_html string, status string, t int")
    return x.select(*[F.timestamp_seconds("t").alias("crawled_at") if f.name == "crawled_at" else F.col(f.name) if f.name in ("url", "title", "raw_html", "status") else F.concat(F.lit("id"), "url").alias("doc_id") if f.name == "doc_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in base])


def test_upsert(spark):
    old = _doc(spark, [("a", "A", "<old>", "raw", 1), ("b", "B", "<b>", "raw", 2)])
    new = _doc(spark, [("a", "A2", "<new>", "processed", 3), ("c", "C", "<c>", "raw", 4), ("a", "A1", "<n>", "raw", 2)])
    got = {r["url"]: (r["title"], r["raw_html"], r["status"]) for r in store.upsert(old, new).collect()}
    assert got == {"a": ("A2", "<old>", "processed"), "b": ("B", "<b>", "raw"), "c": ("C", "<c>", "raw")}
    assert {r["url"]: r["raw_html"] for r in store.upsert(old, new, True).collect()}["a"] == "<new>"
    assert [r["url"] for r in store.unprocessed(old, 1).collect()] == ["a"] and store.counts(old).first().asDict() == {"total": 2, "processed": 0, "avg_token_count": 0.0}


PAGE = '<html><head><title>{t}</title></head><body><p>{b}</p>{l}</body></html>'


@pytest.fixture(scope="module")
def web(spark):
    link = lambda *x: "".join(f'<a href="{u}">go</a>' for u in x)
    rows = [
        ("http://e.com/a", PAGE.format(t="A", b="red fox jump", l=link("/b", "/c", "/a#frag", "mailto:x@y", "/p.pdf", "/gone")), "text/html"), ("http://e.com/b", PAGE.format(t="B", b="fox runs red", l=link("/d", "/b/")), "text/html"),
        ("http://e.com/c", PAGE.format(t="C", b="jump", l=link("/private/e")), "text/html"), ("http://e.com/d", PAGE.format(t="D", b="red", l=link("/f")), "text/html"), ("http://e.com/f", PAGE.format(t="F", b="deep", l=link("/g")), "text/html"),
        ("http://e.com/g", PAGE.format(t="G", b="never", l=""), "text/html"), ("http://e.com/private/e", PAGE.format(t="E", b="no", l=""), "text/html"), ("http://e.com/p.pdf", "%PDF", "application/pdf"),
    ]
    x = spark.createDataFrame(rows, "url string, html string, content_type string")
    return x.withColumns({"http_status": F.lit(200), "error": F.lit(None).cast("string")})


def test_crawl(spark, web):
    robots = spark.createDataFrame([("http://e.com", "User-agent: *\nDisallow: /private/\n")], "base_url string, body string")
    got = cr.crawl(spark, ["http://e.com/a/"], cr.table_fetch(web), robots)
    at = {r["url"].removeprefix("http://e.com/"): (r["depth"], r["status"]) for r in got.log.collect()}
    assert at == {"a": (0, "crawled"), "b": (1, "crawled"), "c": (1, "crawled"), "p.pdf": (1, "skipped"), "gone": (1, "failed"), "d": (2, "crawled"), "private/e": (2, "skipped"), "f": (3, "crawled")}
    s = got.stats().first()
    assert (s["pages_crawled"], s["pages_failed"], s["pages_skipped"]) == (5, 1, 2) and s["bytes_downloaded"] > 0
    assert cr.crawl(spark, ["http://e.com/a"], cr.table_fetch(web), max_pages=2).log.count() == 2
    assert cr.crawl(spark, ["http://e.com/a"], cr.table_fetch(web), seen=got.seen).log.count() == 0


def test_crawl_goes_on_after_failures(spark):
    """What fails or is skipped leaves its budget to the rest of its depth."""
    hub = PAGE.format(t="hub", b="x", l="".join(f'<a href="/{x}">x</a>' for x in ("no1", "private/1", "no2", "good", "more")))
    rows = [("http://e.com/hub", hub), *((f"http://e.com/{x}", PAGE.format(t=x, b="x", l="")) for x in ("good", "more"))]
    web = spark.createDataFrame([(u, h, "text/html", 200, None) for u, h in rows], "url string, html string, content_type string, http_status int, error string")
    robots = spark.createDataFrame([("http://e.com", "User-agent: *\nDisallow: /private/\n")], "base_url string, body string")
    log = cr.crawl(spark, ["http://e.com/hub"], cr.table_fetch(web), robots, max_pages=2).log.collect()
    at = {r["url"].removeprefix("http://e.com/"): r["status"] for r in log}
    assert at == {"hub": "crawled", "no1": "failed", "private/1": "skipped", "no2": "failed", "good": "crawled"} and len(log) == 5


def test_crawl_frontier_follows_links(spark, tmp_path):
    """The registered query goes to the default depth, from the last of its twenty seeds too."""
    link = lambda i: f'<a href="/{i + 1}">x</a>' if i >= 19 else ""
    pages = [(i, f"http://e.com/{i}", PAGE.format(t=i, b="x", l=link(i))) for i in range(25)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["url"]: r["depth"] for r in catalog.crawl_frontier(spark, str(tmp_path)).collect()}
    assert got == {f"http://e.com/{i}": max(0, i - 19) for i in range(23)}


def test_service(spark, web, tmp_path):
    engine = SearchEngine(spark, str(tmp_path), Settings())
    assert engine.crawl(["http://e.com/a"], cr.table_fetch(web)).first()["pages_crawled"] == 6
    engine.rebuild_index()
    first, again = engine.search("red OR fox"), engine.search("red OR fox")
    assert first.total_found == 3 and first.total_pages == 1 and not first.from_cache and again.from_cache and again.results == first.results
    assert first.results[0].rank == 1 and "fox" in first.results[0].snippet and first.results[0].url.startswith("http://e.com/")
    assert engine.search("zzz").total_pages == 0 and not engine.search("-red").has_results
    with pytest.raises(ValueError):
        engine.search("  ")
    assert engine.flush_cache()["keys_deleted"] == 1 and engine.health()["status"] == "healthy"
    m = engine.metrics().first()
    assert m["total_documents"] == m["processed_documents"] == m["total_docs_indexed"] == 6
    assert engine.admin_stats()["ranking"] == {"algorithm": "BM25", "k1": 1.5, "b": 0.75}
    plan = engine.index.lookup(["fox"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    compat = SearchEngine(spark, str(tmp_path), Settings(compat=True)).search("fox", page_size=50)
    assert compat.page_size == 10 and compat.results[0].snippet in ("A", "B")


def test_failed_pages_are_marked(spark):
    from siltstone.operators.process import process

    pages = spark.createDataFrame([(1, "http://e.com/x", "<h1>only</h1>"), (2, "http://e.com/y", "<p>body text</p>")], "page_id bigint, url string, html string")
    got = {r["url"][-1]: (r["status"], r["error"]) for r in process(raw_documents(pages)).collect()}
    assert got == {"x": ("failed", "parse_failed"), "y": ("processed", None)}


def test_processed_pages_without_terms(spark, tmp_path):
    import duckdb

    from siltstone.plans import catalog

    page = '<html lang="en"><head><title>{0}</title></head><body><article><h1>{0}</h1><p>{0}</p></article></body></html>'
    rows = [(i, f"http://e.com/{i}", page.format(t)) for i, t in enumerate(("the", "fox runs", "\u00e9"))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(tuple(r) for r in catalog.queries()["processed_documents"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalog.oracle_sql()["processed_documents"]).fetchall()) and [r[-1] for r in got].count(None) == 2


def test_stream(spark, tmp_path):
    s = store.DocumentStore(spark, str(tmp_path / "docs"))
    s.init()
    for part in ([(1, "http://e.com/x", "<p>one</p>"), (2, "http://e.com/x#f", "<p>one</p>")], [(3, "http://e.com/x", "<p>two</p>"), (4, "http://e.com/y", "<p>three</p>")]):
        spark.createDataFrame(part, "page_id bigint, url string, html string").write.mode("append").parquet(str(tmp_path / "in"))
        index_stream(spark, str(tmp_path / "in"), s, str(tmp_path / "state")).awaitTermination()
    assert sorted((r["url"], r["clean_text"]) for r in s.read().collect()) == [("http://e.com/x", "one"), ("http://e.com/y", "three")]


def test_store_versions(spark, tmp_path):
    s = store.DocumentStore(spark, str(tmp_path / "docs"), buckets=4)
    s.init()
    s.upsert(_doc(spark, [(f"u{i}", "A", "<a>", "raw", i) for i in range(40)]))
    held = s._held()
    s.upsert(_doc(spark, [("u3", "B", "<b>", "processed", 99)]))
    now = s._held()
    assert sum(held[b] != now[b] for b in held) == 1 and s.read().count() == 40 and store.counts(s.read()).first()["processed"] == 1
    broken = tmp_path / "docs" / f"v{s._version() + 1}" / "data"  # a write that was cut short
    broken.mkdir(parents=True)
    assert s.read().count() == 40 and s.healthy()
    s.init()
    s.upsert(_doc(spark, [("new", "C", "<c>", "raw", 1)]))
    assert s.read().count() == 41 and s._version() == int(broken.parent.name[1:]) + 1
    s.write(_doc(spark, [("one", "C", "<c>", "raw", 1)]))
    assert [r["url"] for r in s.read().collect()] == ["one"] and store.DocumentStore(spark, str(tmp_path / "docs")).read().count() == 1
    assert s.jobs().count() == 0


def test_index_versions(spark, index, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        ix.read(spark, root)
    assert ix.write(index, root) == 1
    (tmp_path / "index" / "v2" / "postings").mkdir(parents=True)  # cut short
    got = ix.read(spark, root)
    assert (got.total_docs, got.stemmer) == (6, "suffix") and found(got, "red OR jump") == {"d1", "d2", "d3", "d4"} and found(got, '"red fox"') == {"d1", "d3"}
    assert ix.write(index, root) == 3 and ix.read(spark, root).term_stats.count() == 3


def test_hydrate_keeps_rows_without_document(spark):
    top = spark.createDataFrame([("a", 2.0, ["x"], 1), ("gone", 1.0, ["x"], 2)], "doc_id string, score double, matched_terms array<string>, rank int")
    docs = spark.createDataFrame([("a", "u", "", "x y")], "doc_id string, url string, title string, clean_text string")
    got = {r["doc_id"]: (r["rank"], r["url"], r["title"], r["snippet"]) for r in hydrate(top, docs, ["x"]).collect()}
    assert got == {"a": (1, "u", "u", "x y"), "gone": (2, "", "", "")}


def test_deep_crawl(spark):
    """Twenty seeds, every page with the next pages' links, three levels down, whatever the case of a URL."""
    link = lambda i: "".join(f'<a href="/P{j}">x</a><a href="/p{j}">x</a>' for j in range(4 * i + 20, 4 * i + 24))
    rows = [(f"http://e.com/{c}{i}", PAGE.format(t=i, b="x", l=link(i)), "text/html", 200, None) for i in range(2000) for c in "pP"]
    web = spark.createDataFrame(rows, "url string, html string, content_type string, http_status int, error string")
    got = cr.crawl(spark, [f"http://e.com/p{i}" for i in range(20)], cr.table_fetch(web), max_pages=600)
    log = got.log.collect()
    assert len(log) == len({r["url"].lower() for r in log}) == 600 and max(r["depth"] for r in log) == 3 and len({r["seq"] for r in log}) == 600
    assert [r["seq"] for r in sorted(log, key=lambda r: r["seq"])] == sorted(r["seq"] for r in log) and got.frontier == 20 * 64 - (600 - 20 * 21)
    assert all(r["depth"] == d for r, d in zip(sorted(log, key=lambda r: r["seq"]), [0] * 20 + [1] * 80 + [2] * 320 + [3] * 180))
    assert got.stats().first()["pages_per_second"] > 0


@pytest.fixture
def site():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/robots.txt": b"User-agent: *\nDisallow: /no\n", "/a": b"<p>a</p><a href='/no'>n</a><a href='/b'>b</a><a href='/x.pdf'>p</a>", "/b": "<p>é</p>".encode(), "/x.pdf": b"%PDF"}.get(self.path)
            self.send_response(404 if body is None else 200)
            self.send_header("Content-Type", "application/pdf" if self.path.endswith("pdf") else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_live_crawl(spark, site, tmp_path):
    """Over HTTP, with rules that are fetched too."""
    settings = Settings(crawl_delay_seconds=0.01)
    bases = spark.createDataFrame([(site,), (f"{site}/nothing",), ("http://127.0.0.1:1",)], "base_url string")
    assert {r["base_url"]: r["body"] is not None for r in cr.http_robots(settings)(bases).collect()} == {site: True, f"{site}/nothing": False, "http://127.0.0.1:1": False}
    engine = SearchEngine(spark, str(tmp_path), settings)
    assert engine.crawl([f"{site}/a"], cr.http_fetch(settings), cr.http_robots(settings)).first()["pages_crawled"] == 2
    assert {r["url"].removeprefix(site): r["status"] for r in engine.last_crawl.log.collect()} == {"/a": "crawled", "/no": "skipped", "/b": "crawled", "/x.pdf": "skipped"}
    job = engine.store.jobs().collect()
    assert [(r["seed_url"], r["pages_crawled"], r["status"]) for r in job] == [(f"{site}/a", 2, "completed")] and job[0]["started_at"] <= job[0]["finished_at"]
    assert {r["clean_text"] for r in engine.store.read().collect()} >= {"é"}


def test_robots_listed_twice(spark):
    targets = spark.createDataFrame([("http://e.com/a",)], "url string")
    rules = spark.createDataFrame([("http://e.com", "User-agent: *\nDisallow: /a\n")] * 2, "base_url string, body string")
    assert [r["allowed"] for r in cr.robots_filter(targets, rules, "x").collect()] == [False]


def test_composed_terms(spark):
    text = "cafe\u0301 ole\u0301"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    index = ix.build(docs)
    assert found(index, "caf\u00e9") == {"d"} and tx.token_counts(docs).first()["token_count"] == len(tx.py_raw_tokens(text)) == 2


def texts(spark, *more):
    rows = [(1, "cats running cat nation the \u00e9tude"), (2, None), (3, ""), (4, "fox runs fox a-b fox running"), (None, "e\u0301t running the"), *more]
    return spark.createDataFrame(rows, "doc_id int, text string")


@pytest.mark.parametrize("stemmer", ["suffix", "porter"])
def test_postings_without_shuffle(spark, stemmer):
    for docs, shuffles in ((texts(spark), 0), (texts(spark, (4, "fox then cat")), 1)):
        got = ix.document_postings(docs, stemmer)
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == shuffles
        all_tokens = ix.postings(tx.token_rows(docs, stemmer))
        assert sorted(map(str, got.collect())) == sorted(map(str, all_tokens.collect())) and got.dtypes == all_tokens.dtypes
    index = ix.build(texts(spark, (4, "fox then cat")))
    assert (index.total_docs, index.total_tokens) == (6, 18) and "Exchange" not in ix.build(texts(spark)).postings._jdf.queryExecution().executedPlan().toString()


def test_writing_finds_postings_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    docs = texts(spark).mapInPandas(count, "doc_id int, text string")
    index = ix.build(docs, Settings(stemmer="porter"))
    before = seen.value
    ix.write(index, str(tmp_path / "i"))
    assert seen.value - before == 5 and not (tmp_path / "i" / "v1" / "unsorted").exists()
    assert sorted(map(str, ix.read(spark, str(tmp_path / "i")).postings.select("term", "doc_id", "positions").collect())) == sorted(map(str, index.postings.select("term", "doc_id", "positions").collect()))


def test_payload_without_shuffle(spark):
    from siltstone.operators.process import payload

    got = payload(texts(spark))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    once, again = ({r["doc_id"]: (r["unique_terms"], [tuple(t) for t in r["tokens"]]) for r in x.collect()} for x in (got, payload(texts(spark, (4, "fox")))))
    rest = [("run", 1, [1]), ("a-b", 1, [3]), ("runn", 1, [5])]
    assert once.keys() == again.keys() == {None, 1, 4} and once[1] == again[1] and once[None] == (1, [("runn", 1, [0])])
    assert once[4] == (4, [("fox", 3, [0, 2, 4]), *rest]) and again[4] == (4, [("fox", 4, [0, 0, 2, 4]), *rest])


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from siltstone.sources.folder import shared_dir

    cluster = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=cluster, conf=SimpleNamespace(get=lambda *_: None)))
