import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A table of documents from ``(doc_id, text, lang, source)`` rows."""

    def make(rows, extra=""):
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if extra:
            df = df.selectExpr("*", *[f"'x' as {name}" for name in extra.split()])
        return df.repartition(3)

    return make
