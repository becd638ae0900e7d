import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("k1", StringType()), StructField("size", StringType()), StructField("term", StringType())])

A = " ".join(f"alpha{i}" for i in range(40))
B = " ".join(f"beta{i % 17}" for i in range(60))
LONG = " ".join(f"w{i * i % 997}" for i in range(20_000))
RUNS = "x " * 30 + "y y y " + "x " * 30


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    texts = [A, A.upper(), f"{A} tail", f"head {B}", B, B, LONG, f"{LONG} end", RUNS, f"z {RUNS}", "", None, "\n", "one", "one two", "a  b\t c", "ÉÀ ß 漢字 🙂", f"{A} {B}", f"{B} mid {A}", "1 2 3 !!", " lead", "trail "]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s1", "é")[i % 5], len(t or ""), "k", "s", "t") for i, t in enumerate(texts)]
    return [*out, out[0], out[4], (None, A, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "other text with id three", "en", "s1", 1, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
