"""MinHash containment: sizes, windows and recall against the exact search."""

import random

import numpy as np
import pytest

from oddlot.llm import containment
from oddlot.llm.containment import contained_items
from oddlot.llm.tokens import mix


def made(seed, n_docs, n_items):
    """Items of 3 to 400 words; documents of up to 6,000 words hold whole, cut and edited ones."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3000)}"
    items = [[word() for _ in range(draw.choice([3, 6, 20, 60, 150, 400]))] for _ in range(n_items)]
    docs = []
    for _ in range(n_docs):
        text = [word() for _ in range(draw.choice([0, 50, 600, 6000]))]
        for _ in range(draw.randrange(3)):
            item = list(draw.choice(items))
            kind = draw.randrange(3)
            if kind == 1:
                item = item[: max(1, int(len(item) * draw.uniform(0.7, 1.0)))]
            elif kind == 2 and len(item) > 30:
                item[draw.randrange(len(item))] = "edit"
            at = draw.randrange(len(text) + 1)
            text[at:at] = item
        docs.append(" ".join(text))
    return docs, [" ".join(i) for i in items]


def test_recall_against_the_exact_search(spark):
    docs, items = made(3, 400, 60)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    exact = {tuple(r) for r in contained_items(d, b, exact=True).collect()}
    found = {tuple(r) for r in contained_items(d, b).collect()}
    assert found <= exact and len(exact) > 200 and len(found) >= 0.99 * len(exact)


@pytest.mark.parametrize("size_class", [0, 3, 6])
def test_a_passage_of_a_block_lies_within_one_window(size_class):
    """Wherever it stands, a whole item's minima are those of one window of what it shares."""
    values = mix(np.arange(1, 600, dtype=np.uint64))
    begin = np.array([0, 200, 599])
    size = 1 << size_class
    for at in (0, 3, 190 - size, 200, 333, 598 - size):
        item = values[at : at + size]
        row = int(at >= 200)
        same = 0
        for f, (keys, owner) in enumerate(containment.windows(values, begin, size_class)):
            own = containment._key(containment._minima(item, np.zeros(1, dtype=np.int64), f), f, size_class)
            same += own[0] in keys[owner == row]
        assert same > 0


def test_candidates_come_from_sketches(spark, monkeypatch):
    """Without equal minima nothing is verified."""
    docs, items = made(4, 30, 10)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert contained_items(d, b).count() > 0
    monkeypatch.setattr(containment, "_documents", lambda k, classes, *bits: documents(k, [], *bits))
    assert contained_items(d, b).count() == 0 and contained_items(d, b, exact=True).count() > 0


documents = containment._documents
