import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, fp string, text_sha256 string, mix_place string, goal string, maybe string"


def awkward_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near and shifted copies."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "été", "straße", "日本", "x1"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = make(60), make(30)
    texts = [base, base, base.replace(" ", "\n"), base + " tail", base.upper(), None, "", "  \t\n", "one", "one two", "!!! 123 ???", "x" * 3000,
             passage, make(25) + " " + passage + " " + make(9), make(40) + "\x0b" + passage, " ".join(["be"] * 150), "Be\x00 be " * 40,
             make(4000), make(19), make(20), make(21), "a b c", "naïve café"]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "s2", "s2", None, "é"])) for i, t in enumerate(texts)]
    rows += [(7, base, "en", "s1"), rows[0], rows[0], (None, base, None, None), (None, passage, "en", "s2"), (None, None, None, None), (50, base + "  ", "en", "s3")]
    return [(i, t, lang, s, None, "k", "f", "h", "p", "g", "m") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = awkward_rows()
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
