import random

import pytest

WORDS = "amber birch cedar delta ember flint grove heath inlet jetty knoll ledge marsh north ocean plume quarry ridge shore thorn upland vale willow yarrow zephyr".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size int, h int, chunk int, label int, score double, seed long, copies int, bad int"


def table(spark, rows):
    """(doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", 2, 3, 4, 5, 0.5, 6, 7, 8) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 200), "en", "a"), (2, prose(2, 200), "en", "a"), (2, prose(2, 200), "en", "a"), (3, None, None, None), (4, "", "en", ""), (5, "  \n\t ", "fr", "b"),
        (6, "!!! ???", "en", "b"), (7, long, "en", "b"), (8, long + " more", "en", None), (None, prose(3, 80), "en", "c"), (9, "é ñ 漢字 😀", "es", "c"), (10, "x", "en", "c"),
    ]
    return table(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])
