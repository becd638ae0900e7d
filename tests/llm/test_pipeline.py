"""The stages one after the other on odd rows, each against what it is for."""

import os

from pyspark import RDD

import corpus_pipeline
from siltstone.llm import op01_language
from siltstone.llm.common import stage
from tests.llm.conftest import A


def test_stages(spark, odd, tmp_path):
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty = spark.createDataFrame([(900, " ".join(f"bench{i}" for i in range(15)), "en", "s1", 1, None, None, None)], odd.schema)
    docs, seen = odd.unionByName(dirty), {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, str(tmp_path)), f"test-{name}")
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == odd.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    texts = {n: [r["text"] for r in x.collect()] for n, x in seen.items() if n != "tokens"}
    assert None not in texts["language"] and "" not in texts["language"] and texts["language"].count(A) == 3
    assert texts["near_duplicates"].count(A) == 1 and A.upper() not in texts["near_duplicates"]
    assert any(t.startswith("bench0") for t in texts["near_duplicates"]) and not any(t.startswith("bench0") for t in texts["decontamination"])
    assert set(texts["mixing"]) <= set(texts["decontamination"]) and seen["tokens"].count() == len(texts["mixing"])


def test_empty(spark, none, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_batches(spark, tmp_path, monkeypatch):
    """The language stage exchanges at most 2,000 rows at once with Python, reads every row and keeps what it is to keep."""
    rows = [(i, f"alpha beta {i}" if i % 5 else f"{i}", "en") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    docs = stage(docs, "test-batches").coalesce(1)

    def watched(run, folder):
        os.mkdir(folder)

        def watch(batches):
            def counted():
                for i, batch in enumerate(batches):
                    open(f"{folder}/{os.getpid()}-{i}-{batch.num_rows}", "w").close()
                    yield batch

            return run(counted())

        return watch

    learn, tell = op01_language._document_frequencies, op01_language._predict
    monkeypatch.setattr(op01_language, "_document_frequencies", watched(learn, f"{tmp_path}/learn"))
    monkeypatch.setattr(op01_language, "_predict", lambda *args: watched(tell(*args), f"{tmp_path}/tell"))
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {i for i in range(5000) if i % 5}
    for name in ("learn", "tell"):
        sizes = [int(x.rpartition("-")[2]) for x in os.listdir(f"{tmp_path}/{name}")]
        assert max(sizes) <= 2000 and sum(sizes) >= (5000 if name == "tell" else 3000)


def test_no_further_workers(spark, odd, tmp_path, monkeypatch):
    """No stage makes an RDD from a list of Python's: executors keep Python workers of another kind for those."""
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = stage(odd, "test-odd")

    def refuse(*_):
        raise AssertionError("an RDD of Python objects")

    monkeypatch.setattr(RDD, "_to_java_object_rdd", refuse)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, str(tmp_path)), "test-workers")
    assert docs.count()
