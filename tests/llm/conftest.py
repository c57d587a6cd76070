import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text), with a column whose name clashes with those of operators."""

    def make(*rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, tokens string"
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows], schema)

    return make


#: Null id, null, empty and blank texts, a repeated row, one long word, one long text.
ODD = [(None, "no id here"), (1, None), (2, ""), (3, " \t\n"), (4, "same row"), (4, "same row"), (5, "x" * 50_000), (6, "word " * 20_000), (7, "é ü 漢字 \U0001f600")]
