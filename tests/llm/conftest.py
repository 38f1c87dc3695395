"""Small tables with the awkward rows that every operator has to take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, component string, key string, slot int"


def sentence(start, count):
    return " ".join(f"w{(start * 31 + i * 7) % 997}x{start}" for i in range(count))


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and very long texts, ties, repeated rows and copies; ids are not dense."""
    base = sentence(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "other", *words[61:]])
    far = " ".join(f"z{i}" if i % 9 == 0 else w for i, w in enumerate(words))
    shared = sentence(5, 70)
    texts = [
        (1, base), (2, base), (3, near), (4, far), (5, None), (6, ""), (7, " \t\r\n "), (8, "one two"), (9, "one two"),
        (10, "ONE\ttwo"), (11, sentence(2, 40) + " " + shared + " " + sentence(3, 40)), (12, shared + "\n" + sentence(4, 30)),
        (13, "a " * 130), (14, "b " + "a " * 90), (15, sentence(6, 20_000)), (16, sentence(6, 20_000) + " tail"),
        (17, "É ß   “q”   x  y"), (None, base), (None, None), (20, base), (20, base), (20, sentence(7, 60)),
        (21, sentence(7, 60)), (22, "x" * 5000),
    ]
    return [(d, t, "en", None if d == 3 else f"s{(d or 0) % 3}", len(t or ""), 0.5, 7, "c", "k", 1) for d, t in texts]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
