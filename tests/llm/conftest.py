import pytest

LONG = "long words stand here one after another " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, size int, row string, range int"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, null keys and columns with clashing names."""
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "b"), (4, LONG, "en", None), (5, "Mail ann.lee@mail.example.com or +1 (415) 555-0134 now.", "en", "a"),
        (6, "same words in the same order make the same text again and again", "en", "b"), (6, "same words in the same order make the same text again and again", "en", "b"),
        (7, "same words in the same order make the same text again and again", "de", "b"), (8, "日本語 \U0001f600 é \x01 1 2 3", "ja", "c"), (9, "1 " * 3000, "en", "c"), (None, "no id here but words", "en", "c"),
    ]
    rows = [(i, t, lang, src, len(t or ""), "x", 3, "y", 4) for i, t, lang, src in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def local_docs(docs):
    return {r.doc_id: r for r in docs.collect()}
