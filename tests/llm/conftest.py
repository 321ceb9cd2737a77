import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table like ``documents`` from (doc_id, text) or (doc_id, text, source) rows."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    return documents((1, None, None), (None, "a b c", None), (2, "", "b"), (2, "", "b"), (3, " \n\t ", "a"), (4, long, "a"), (5, "one two\x0bthree one two\x0bthree", "a"), (6, "🙂 é ~ #*", "ü"))
