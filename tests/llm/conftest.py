import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, spans string, _row long, fingerprint string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = "word " * 60_000 + "end"
    texts = [None, "", " \t\n", long, "a b c d e", "a b c d e", "A B C d\ne", "漢字 かな 𝒳 \x00", "<|endoftext|> x   y  z\n\n q"]
    data = [(i, t, "en", "s", None, "x", "y", "z", 1, "f") for i, t in enumerate(texts)]
    data += [data[4], data[4], (4, "other", None, None, 3, None, None, None, None, None), (None, "no id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))
