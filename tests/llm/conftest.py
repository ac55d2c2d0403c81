import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos string, rank int, ids string, key string, n_lines string, start string, severity string, copies string, _k1 string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, extra columns with names the operators use."""
    body = " ".join(f"word{k} tail{k % 7}" for k in range(80))
    long = " ".join(f"w{k % 5000}" for k in range(60_000)) + "\n" + "x" * 200_000
    texts = [None, "", "   ", "\n\n", body, body, body + " more", "Shared line of text\nown one", "own two\n  SHARED line of text \nShared line of text", "short", long, "ünïcode " * 30, "a\x00b <|endoftext|>  two  spaces\r\n\tTab"]
    rows = [(k, t, None, "src1", 1, "p", 1, "i", "k", "n", "s", "v", "c", "x") for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, body, "en", None, None, *[None] * 9), (None, None, *[None] * 12), (7, "another text under one id", *[None] * 12)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
