import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, class_id long, kept_text string, rep long, bucket string, u int"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text[, lang[, source]]), with extra columns named like columns inside the operators."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or ""), True, 1, "x", 2, "y", 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build
