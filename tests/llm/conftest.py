import random

import pytest

WORDS = "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, clashing names in spare columns."""
    rng = random.Random(4)
    base = prose(rng, 400)
    changed = base.split()
    changed[200] = "zebra"
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, base), (5, base), (5, base), (6, " ".join(changed)), (None, "only one"),
        (None, None), (7, "Word"), (8, "two words"), (9, "a b c"), (10, prose(rng, 3000)), (11, "é" * 5000 + " ü x  y\r\n z\x1cq <|endoftext|> end"),
        (12, "A" * 3000), (13, prose(rng, 120)), (14, "\U0001f600 " * 50), (-15, "minus"), (16, prose(rng, 60) + "\n\n  " + prose(rng, 5)),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    schema = "doc_id long, text string, rid string, t int, lang string, source string, n_chars long, fp string, _rid int"
    return spark.createDataFrame([(d, t, "r", 1, "en", None, 0 if t is None else len(t), "x", 7) for d, t in odd_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return public_tokenizers.path
