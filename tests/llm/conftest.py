import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, score string, row_key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or longer tuples, with two more columns of clashing names."""

    def make(*rows, lang="en", source="a"):
        full = []
        for row in rows:
            row = (*row, lang, source)[:4] if len(row) == 2 else tuple(row)
            full.append((*row, None if row[1] is None else len(row[1]), "old score", "old key"))
        return spark.createDataFrame(full, DOCUMENT)

    return make
