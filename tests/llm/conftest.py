import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, id long"


@pytest.fixture
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns that clash with names used inside."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    text = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(300))
    rows = [
        (1, text, "en", "b", len(text), 1, 1), (2, text, "en", "a", None, 2, 2), (2, text, "en", "a", None, 2, 2), (3, None, None, None, None, None, None), (4, "", "en", "a", 0, 1, 1),
        (5, " \n\t ", "en", "a", 3, 1, 1), (6, "one", "en", None, 3, 1, 1), (None, "no id here", "en", "a", 10, 1, 1), (7, text.replace("alpha3 ", "omega ", 1), "en", "c", 1, 1, 1),
        (8, "word " * 30000 + "é\x00 end  of text", "de", "a", 1, 1, 1), (9, "ÄÖ É 漢字 🙂 x", "de", "b", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
