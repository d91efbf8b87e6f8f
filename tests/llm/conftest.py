import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, key long, w string"


def words(n: int, seed: int = 0) -> str:
    import numpy as np

    rng = np.random.default_rng(seed)
    parts = ["re", "th", "on", "er", "in", "st", "ou", "ly", "an", "ti"]
    return " ".join("".join(parts[i] for i in rng.integers(0, 10, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, copies, near copies, and columns with clashing names."""
    base = words(200, 1)
    near = base.split()
    near[50] = "changed"
    long = words(60_000, 2)
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "one"), (7, long), (8, long + " tail"), (9, "été ß 漢字 " * 40), (9, "été ß 漢字 " * 40),
        (10, words(60, 3)), (11, words(80, 4) + " " + words(60, 3)), (None, base), (None, None), (None, words(30, 9)), (12, "THIS is the MIT License, and the GNU General Public License."), (13, "  \n\t "),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 1.0, "r", 5, "w") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
