import random

import pytest

#: Columns whose names also stand inside the operators.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, row_number long, "
    "shard int, size string, word string, content string, bucket string, row string, root long, passes int, "
    "_file string, _path long, _position string, _metadata string, _mark string"
)


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents with clashing extra columns, from (doc_id, text[, lang[, source]]) tuples."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), 7, 0.5, True, 1, 2, "big", "w", "c", "b", "r", 3, 4, "f", 5, "p", "m", "k") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "ra", "si", "to") for b in ("n", "r", "s", "t", "mel", "vos", "rin")]


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + ("." if pick.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def edges():
    """Nulls, blanks, ties, repeated rows and a long text."""
    long = prose(1, 30_000)
    return [
        (None, None), (None, prose(2, 40)), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (5, prose(3, 60)), (5, prose(4, 60)),
        (6, prose(3, 60)), (7, long), (8, "Ünï çødé — “q” 😀 a@b.co"), (9, "1" * 20_000), (10, "a" * 20_000), (11, prose(5, 200)),
    ]
