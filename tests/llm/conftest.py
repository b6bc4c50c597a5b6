import pytest

EDGE_TEXTS = [
    None, "", " ", "\n\n", "\t \x0b", "a", "A", "one two", "one two three", "one  two\tthree\n", "ünï cødé ß", "a b  c", "x" * 5000,
    "same words here " * 400, "line one is here\nline one is here\n\nother line\r\n", "日本語 テキスト 🙂🙂", "don't we'll I'm 12345 !!! ...", "\x00 nul \x1f",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns with names the operators use."""
    rows = [(i, t, "en", None if i % 3 == 0 else "s", len(t or ""), i) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[8], rows[13]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sample_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
