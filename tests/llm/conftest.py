import pytest

from barloom.llm.common import ship

LONG = " ".join(f"word{k % 977} of{k % 31}" for k in range(60_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, key string, `a.b` int, block int, p_copies int, verdict string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def documents(spark, rows):
    """rows of (doc_id, text[, source]); the other columns have names that operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", 0, 0.25, "h", "k", 7, 3, 9, "v") for r in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, repeated rows, equal texts, one shared key."""
    same = "the quick brown fox jumps over the lazy dog and then sleeps a long while under the old tree"
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", "a"), (4, LONG, "b"), (5, LONG + " end", "b"), (6, same, None), (6, same, None),
            (7, same, "a"), (8, same.upper(), "c"), (None, same, "c"), (None, None, None), (9, "one", "c"), (10, "é ü 漢字 \u2028 x", "c"), (11, "a" * 300, "d"), (12, "a" * 120, "d")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return documents(spark, edge_rows).cache()
