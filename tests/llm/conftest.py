import random

import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, blanks, ties, repeats and long texts, as (doc_id, text)."""
    rng = random.Random(5)
    words = ["the", "of", "and", "Été", "zwölf", "casa", "niño", "river", "stone", "Lamp"]
    long = " ".join(rng.choice(words) for _ in range(20000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, long), (7, "x" * 5000), (8, "▁ weird \x00 中文 \U0001F600"), (None, "no id here at all")]
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(100, rows[20][1]), (101, rows[20][1]), (4, "One")]
    return rows


@pytest.fixture
def docs(spark, odd_texts):
    """The texts as a documents table whose extra columns have clashing names."""
    rows = [(i, t, ["en", "fr", None][k % 3], ["a", "b", None][k % 3], k, "x", 1.5) for k, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score double")
