import pytest

ODD = "doc_id long, text string, source string, n_words int, position long, part int, node string, rid int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, columns with names used inside."""
    long_text = " ".join(f"word{i}" for i in range(30_000)) + "."
    rows = [(1, "the quick brown fox jumps over the lazy dog again and again while nobody was looking at the clock tower today.", "a", 1, 1, 1, "x", 1),
            (1, "the quick brown fox jumps over the lazy dog again and again while nobody was looking at the clock tower today.", "a", 1, 1, 1, "x", 1),
            (2, "", "a", None, None, None, None, None), (3, None, None, 1, 1, 1, "x", 1), (None, "a b c", None, 1, 1, 1, "x", 1),
            (None, None, None, None, None, None, None, None), (4, long_text, "b", 1, 1, 1, "x", 1), (5, " \n\t ", "b", 1, 1, 1, "x", 1),
            (6, "Ünïcödé 中文 \U0001f600 <|endoftext|>  a\n\n b", "b", 1, 1, 1, "x", 1)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
