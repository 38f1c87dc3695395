"""N-gram join, substring dedup and containment against brute force."""

import hashlib
import itertools
import re

import pytest

from oddlot.llm.containment import contained_items, without_items
from oddlot.llm.parity_join import jaccard_components, keep_one
from oddlot.llm.recompression import cut_texts, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    words = WORD.findall(low(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def components(rows, k, percent):
    """By all pairs; rows of one id are one node."""
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}


def check_components(df, rows, k, percent):
    want = components(rows, k, percent)
    got = jaccard_components(df, k, percent).collect()
    assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(
        map(str, ((d, len(shingles(t, k)), want.get(d)) for d, t in rows))
    )


def test_components_of_awkward_rows(docs, awkward):
    check_components(docs, [r[:2] for r in awkward], 4, 85)


@pytest.mark.parametrize("percent", [60, 90])
def test_components_of_a_chain_of_edits(spark, percent):
    """Each copy changes a few more words, so links form chains and blocks hold several components."""
    words = [f"w{i}" for i in range(80)]
    rows = []
    for n in range(60):
        words = list(words)
        words[(n * 13) % 80] = f"e{n}"
        if n % 7 == 0:
            words[(n * 5) % 80] = f"f{n}"
        rows.append((n, " ".join(words if n % 3 else words[: 70 + n % 9])))
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 3, percent)


def test_no_documents(no_docs):
    assert jaccard_components(no_docs, 4, 85).count() == 0
    assert remove_repeats(no_docs).count() == 0
    assert cut_texts(no_docs).count() == 0


def test_one_of_each_group_stays(docs, awkward):
    want = components([r[:2] for r in awkward], 5, 80)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r[0]) for r in kept.collect())
    assert ids == sorted(str(r[0]) for r in awkward if r[0] is None or want[r[0]] == r[0])


def repeats(rows, width=50):
    least = {}
    for d, t in rows:
        words = WORD.findall(t or "")
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if d is not None:
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = set()
        for i in range(len(words) - width + 1):
            if d is not None and least[tuple(words[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_repeated_windows(docs, awkward):
    got = [tuple(r) for r in remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, repeats([r[:2] for r in awkward])))


def test_cut_texts_keep_rows_and_columns(docs, awkward):
    got = cut_texts(docs)
    assert got.columns == docs.columns
    want = [r for r, (_, n, m, _) in zip(awkward, repeats([r[:2] for r in awkward]), strict=True) if not n or n > m]
    digests = [s for _, n, m, s in repeats([r[:2] for r in awkward]) if not n or n > m]
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in want)
    assert sorted(hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() for r in rows) == sorted(digests)
    assert all(r.n_chars == len(r.text or "") for r in rows)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "Short one"), (3, None), (4, ""), (None, "x y z u v w"), (5, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15 q16 q17 q18")]


def test_contained_items(spark, docs, awkward):
    from tests.llm.conftest import sentence

    planted = [
        (100, sentence(8, 3000) + " Alpha beta gamma delta epsilon\nzeta eta theta iota KAPPA " + sentence(9, 3000)),
        (101, "short ONE"), (102, "short one more"), (103, " ".join(f"q{i}" for i in range(1, 19))),
        (104, sentence(9, 50) + " " + " ".join("changed" if i == 2 else f"q{i}" for i in range(1, 19))), (105, "alpha beta gamma delta epsilon zeta"),
    ]
    rows = [r[:2] for r in awkward] + planted
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = set()
    by_id = {}
    for d, t in rows:
        if d is not None:
            by_id[d] = by_id.get(d, frozenset()) | shingles(t, 5)
    for (d, own), (i, t) in itertools.product(by_id.items(), ITEMS):
        s = shingles(t, 5)
        if i is not None and s and 100 * len(s & own) >= 80 * len(s):
            want.add((d, i, len(s), len(s & own)))
    assert {tuple(r) for r in contained_items(df, items).collect()} == want
    assert {w[:2] for w in want} == {(100, 1), (101, 2), (103, 5), (104, 5)}
    kept = without_items(df, items)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
    assert contained_items(df, items.limit(0)).count() == 0 and contained_items(df.limit(0), items).count() == 0


def test_items_scattered_over_long_documents(spark):
    items = [(i, [f"i{i}w{x}" for x in range(104)]) for i in range(8)]
    scattered = [(i, " ".join(" ".join([*words[x : x + 5], *(f"f{i}x{x}n{y}" for y in range(900))]) for x in range(0, 80))) for i, words in items]
    bench = spark.createDataFrame([(i, " ".join(words)) for i, words in items], "item_id long, text string")
    got = contained_items(spark.createDataFrame(scattered, "doc_id long, text string").repartition(5), bench).collect()
    assert {tuple(r) for r in got} == {(i, i, 100, 80) for i in range(8)}


def test_items_spread_over_rows_of_one_id(spark):
    items = [(i, [f"i{i}w{x}" for x in range(104)]) for i in range(8)]
    rows = [(i, " ".join(part)) for i, words in items for part in (words[:83], words[-5:])]
    docs = spark.createDataFrame([*rows, (200, rows[0][1])], "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(i, " ".join(words)) for i, words in items], "item_id long, text string")
    assert {tuple(r) for r in contained_items(docs, bench).collect()} == {(i, i, 100, 80) for i in range(8)}
