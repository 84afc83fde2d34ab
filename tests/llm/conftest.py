import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    """Invented prose, different for each seed."""
    import random

    r = random.Random(seed)
    parts = ["ka", "lo", "mi", "tu", "ren", "sol", "va", "dri", "pe", "no"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(2, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 0 else w for i, w in enumerate(out))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    base = words(1, 120)
    rows = [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, None, None, None, None), (None, "lonely " + words(2, 40), None, None, None), (4, "", "en", "a", 0),
            (5, "   \n\t", "en", "a", 6), (6, words(3, 30_000), "en", "a", 1), (7, base.replace("ka", "ke", 1), "en", "b", 1), (8, "é" * 5, "fr", "b", 5), (9, words(4, 90), "en", "b", 1), (9, words(5, 90), "en", "b", 1),
            (10, "!!! ??? ...", "en", "b", 11), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
