import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, numbered from 0 unless ids are given."""
    def of(texts, ids=None, lang="en", source="s"):
        rows = [(i, t, lang, source, len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return of
