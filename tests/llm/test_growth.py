"""What operators do must not grow faster than their tables."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import op06_jaccard


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_pairs(spark, k, percent, monkeypatch):
    """Texts half of whose words are passages that a hundred others have too: rows are paired by what is rare in them."""
    rng = random.Random(k)
    passages = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(400)]
    docs = []
    for i in range(2000):
        parts = rng.sample(passages, 20) + [" ".join(f"d{i}x{j}x{m}" for m in range(12)) for j in range(20)]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts)))
    docs.append((2000, docs[7][1] + " end"))
    seen, candidates = [], op06_jaccard.candidates

    def watched(postings, *rest):
        rows = postings.distinct().groupBy("key").count()
        seen.append(rows.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0])
        return candidates(postings, *rest)

    monkeypatch.setattr(op06_jaccard, "candidates", watched)
    got = op06_jaccard.link_components(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), k, percent)
    assert {(r["doc_id"], r["component_id"]) for r in got.where("n_links > 0").collect()} == {(7, 7), (2000, 7)}
    assert seen[0] < 10 * len(docs)


def test_jaccard_files(spark, monkeypatch):
    """Shuffle files go when what they led to is staged: those of one part of the stage don't lie beside the next part's."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 150}x{j}" for j in range(40))) for i in range(300)], "doc_id bigint, text string")
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {n for d in folders for _, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle_") and n.endswith(".data")}
    before, left = files(), []

    def watched(function):
        def after(*args):
            until = time.time() + 10
            while (new := files() - before) and time.time() < until:
                time.sleep(0.2)
            left.append(new)
            return function(*args)

        return after

    monkeypatch.setattr(op06_jaccard, "candidates", watched(op06_jaccard.candidates))
    monkeypatch.setattr(op06_jaccard, "components", watched(op06_jaccard.components))
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 150
    assert left[0] == left[2] == set()  # before the pairs and after the links
