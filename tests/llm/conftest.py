import pytest

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
PARA = "\n".join(f"line number {i} has several plain words in it" for i in range(8))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, __digest string, keep_id string, bucket string"


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    texts = [None, "", " \n\t ", "a", LONG, PARA, PARA, PARA.upper(), PARA.replace("several", "many", 1), "x y z w v\nx y z w v\n" * 3, "naïve — 日本 🎉 text with some more words to pass the rules today"]
    out = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, PARA, "en", "src1", 5, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
