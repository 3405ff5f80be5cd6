import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rejected string, fp string, size int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing extra columns."""
    rng = random.Random(7)
    words = "the of and lorem ipsum dolor sit amet über straße niño façade clé data node".split()
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [None, "", "   \n\t ", "a", "one two", "ONE  two", *base]
    for t in base:
        w = t.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [base[0]] * 5 + [" ".join(rng.choice(words) for _ in range(20000)), "x" * 50000, "été", "été"]
    rows = [(7 * i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None, "g", "f", 1) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, "no id", None, None, None, None, None, None), (10**12, base[1], "en", "a", 3, "g", "f", 1)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
