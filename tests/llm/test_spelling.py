"""Word counts, neighbours and forms against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from oddlot.llm import spelling
from oddlot.llm.spelling import near_words, one_edit, spelling_forms, word_counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(a, b):
    """Levenshtein distance, at most 2."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def counted(rows, least=5, times=3, divisor=97):
    found = Counter()
    for d, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % divisor == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= times}


def formed(words):
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and edits(w, x) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def made_words(seed, count, letters="abeñçÿt×"):
    draw = random.Random(seed)
    made = {"".join(draw.choice(letters) for _ in range(draw.choice([5, 6, 7, 8]))) for _ in range(count)}
    long = "".join(draw.choice(letters) for _ in range(200))
    made |= {long, long[:70], long[:69], long[:63], long[:64], long[1:64], "x" + long[1:], long[:100] + long[101:], long[:40] + "ü" + long[41:62]}
    return {w: draw.choice([3, 4, 6, 9, 40]) for w in made}


@pytest.mark.parametrize("node, searches, cells", [(20_000, 200_000, 4096), (3, 4, 1), (40, 10, 64)])
def test_neighbours_at_every_depth(spark, monkeypatch, node, searches, cells):
    """Small limits send words through all rounds, slices and trie levels."""
    for name, value in (("NODE", node), ("SEARCHES", searches), ("CELLS", cells)):
        monkeypatch.setattr(spelling, name, value)
    # Within a task, the limit on pairs is what this process sets.
    words = made_words(cells, 250)
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    want = {}
    for w in words:
        near = [x for x in words if x != w and abs(len(x) - len(w)) < 2 and edits(w, x) == 1]
        if near:
            best = min(near, key=lambda x: (-words[x], x))
            want[w] = (len(near), best, words[best])
    assert got == want


@pytest.mark.parametrize("cells", [1, 30, 4096])
def test_searches_within_a_task(monkeypatch, cells):
    monkeypatch.setattr(spelling, "CELLS", cells)
    words = sorted(made_words(9, 300, "abcdeh"))
    vectors, check = spelling._vectors(words), spelling._Verifier(words)
    own = np.lexsort(vectors.T[::-1])
    at = np.arange(len(words))
    none = np.zeros(len(words), dtype=bool)
    seen = Counter()
    tried = 0
    for i, j in spelling._candidates(vectors[own], vectors, none, none, 0):
        a, b = at[i], own[j]
        tried += len(a)
        good = check.near(a, b) & ((vectors[a] != vectors[b]).any(axis=1) | (a < b))
        seen.update(frozenset(p) for p in zip(a[good].tolist(), b[good].tolist()))
    want = {frozenset((i, j)) for i in at for j in at if i < j and edits(words[i], words[j]) == 1}
    assert set(seen) == want and set(seen.values()) <= {1}
    assert tried < len(words) ** 2 / 4


def test_one_edit():
    for a in ["", "a", "ab", "abc", "acb", "abcd", "bcd", "abd", "aabcd"]:
        for b in ["", "a", "b", "ab", "ba", "abc", "axc", "abcd", "abcde", "xabcd"]:
            assert one_edit(a, b) == (edits(a, b) == 1)


def test_crc_of_many_spans():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    starts = np.array([0, 5, 5, 100, 3000, 4999, 17])
    ends = np.array([5, 5, 6, 1200, 3064, 5000, 82])
    before = np.array([zlib.crc32(bytes([i])) for i in range(7)], dtype=np.uint32)
    got = spelling._crcs(data, starts, ends, before)
    assert got.tolist() == [zlib.crc32(data[s:e].tobytes(), int(c)) for s, e, c in zip(starts, ends, before)]


def odd_texts():
    draw = random.Random(4)
    words = [*made_words(6, 60, "aÀeÿÉz÷"), "Straße", "naïve", "NAÏVE", "x" * 3000, "Ω", "don’t"]
    rows = [(i, " ".join(draw.choice(words) + draw.choice(["", ",", "漢", " ", "7"]) for _ in range(300))) for i in range(30)]
    return [*rows, (None, rows[0][1]), (None, None), (40, None), (41, ""), (3, rows[3][1]), (42, "Œuvre ŁÓDŹ " * 9), (43, rows[1][1][5:]), (44, rows[1][1][5:])]


@pytest.mark.parametrize("divisor", [97, 3])
def test_counts_and_forms(spark, divisor, monkeypatch):
    rows = odd_texts()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert {r["word"]: r["n"] for r in word_counts(df, divisor=divisor).collect()} == counted(rows, divisor=divisor)
    got = sorted((tuple(r) for r in spelling_forms(df, divisor=divisor).collect()), key=lambda r: r[0])
    assert got == formed(counted(rows, divisor=divisor))


def test_empty(spark, no_docs):
    assert spelling_forms(no_docs).collect() == []
    assert spelling_forms(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")).collect() == []


def test_chains_of_forms(spark):
    """Each word has the next as its form, so roots lie several steps away."""
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    text = " ".join(" ".join([w] * 3 * 2**i) for i, w in enumerate(words))
    got = {r["word"]: (r["form"], r["root"]) for r in spelling_forms(spark.createDataFrame([(7, text)], "doc_id long, text string"), divisor=1 << 31).collect()}
    assert got == {w: (f, "bbbbb") for w, f in zip(words, [*words[1:], None])}
