import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ties."""
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (2, a), (2, a), (3, b), (4, None), (5, ""), (6, " \n\t "), (None, prose(rng, 30)), (None, b), (7, "x" * 300_000), (8, prose(rng, 40_000)), (9, "é" * 50 + "\n" + b), (10, "word"), (11, "word"), (12, "\x00 odd ▁ mark")]
    return [(i, t, None if k % 3 else "en", None if k % 4 else "s", len(t) if t and k % 5 else None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns, with names that operators use within."""
    from pyspark.sql import functions as F

    extra = ("uid", "sig", "shard", "k", "none", "owner", "score", "ids", "n_tokens", "loc", "gram", "blocked_by", "id", "y", "__uid", "__none", "at")
    return odd.withColumns({c: F.array(F.lit(c)) for c in extra})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
