import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, _id string, component_id string"


@pytest.fixture
def make_docs(spark, tmp_path):
    """A table of documents, written and read, with extra columns of clashing names."""
    numbers = iter(range(1000))

    def make(rows):
        """Rows of (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z", "w") for r in rows]
        path = str(tmp_path / f"documents{next(numbers)}")
        spark.createDataFrame(full, SCHEMA).write.parquet(path)
        return spark.read.parquet(path)

    return make


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(1)
    long = " ".join(words(rng, 30_000))
    return [
        (1, "One two three. Four five\nsix seven", "b"),
        (2, "one TWO three. four five\nsix seven", "a"),
        (2, "one TWO three. four five\nsix seven", "a"),
        (3, "", None),
        (4, None, "b"),
        (None, "no id at all", None),
        (None, None, None),
        (5, long, "hot"),
        (6, "x" * 50_000, "hot"),
        (7, " \t\n ", "hot"),
        (8, "äÄ ÉÉ 日本語 😀", "é"),
        (9, "page\ue001from \ue000 a pdf \u0301", "b"),
    ]
