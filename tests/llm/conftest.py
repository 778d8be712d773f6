import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """A documents table of (doc_id, text[, lang]) with the other columns filled in, dealt over several partitions."""

    def make(*rows, parts=3):
        data = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(data, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def sample():
    """Real documents of the smallest table, read without Spark."""
    import duckdb

    return duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
