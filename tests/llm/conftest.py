import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, bucket string, part string, label string, score string"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "x", "x", "x", "x", "x") for d, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, wordless and very long texts, ties and repeated rows."""
    long = " ".join(f"wort{i % 977}x{i % 31}" for i in range(30_000))
    some = " ".join(f"w{i}" for i in range(60))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "ein wort"), (5, some), (5, some), (6, some), (7, some.upper()), (None, some), (None, None), (8, long), (9, long + " ende"), (10, "Straße ñ 日本   x y 🙂 é"), (11, "a" * 50_000), (12, "b\x1fc \x0bd\x0c\x1c e")]
