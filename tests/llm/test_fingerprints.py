"""Prefix hashes, fingerprints and likeness against plain string work."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from oddlot.llm import prefix_hash
from oddlot.llm.catalogue import QUERIES
from oddlot.llm.prefix_hash import Prefixes, common_extensions, edited_fingerprints, edited_marks, fingerprints, marks_of
from tests.conftest import SMALL


def agreeing(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def texts(seed, count):
    draw = random.Random(seed)
    return ["".join(draw.choice("abé漢😀 ") for _ in range(draw.choice([0, 1, 3, 7, 64, 65, 500, 3000]))) for _ in range(count)]


def test_spans_and_extensions():
    for a, b in zip(texts(1, 30), texts(2, 30)):
        c = a[: len(a) // 2] + b
        x, y = Prefixes.of(a), Prefixes.of(c)
        for i, j in [(0, 0), (len(a) // 3, len(a) // 3), (len(a) // 2, len(a) // 2), (len(a), len(c))]:
            assert x.common(i, y, j) == agreeing(a[i:], c[j:])
        shift = Prefixes.of("zz" + a)
        assert all(x.span(i, j) == shift.span(i + 2, j + 2) for i in range(0, len(a), 97) for j in range(i, len(a), 89))


def test_edited_marks_equal_those_of_the_edited_text():
    for a, b in zip(texts(3, 40), texts(4, 40)):
        own, edited, marks = edited_marks(a, b)
        assert edited == a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        assert own.text() == marks_of(a).text() and marks.text() == marks_of(edited).text()
        ends = agreeing(a, edited) + agreeing(a[::-1], edited[::-1])
        true = 1.0 if a == edited else min(ends, len(a), len(edited)) / max(len(a), len(edited))
        assert true - 2 / 32 <= own.likeness(marks) <= true
        assert own.likeness(marks) == marks.likeness(own)


def test_slices_do_not_show(monkeypatch):
    long = "".join(texts(5, 60))
    want = marks_of(long).text()
    monkeypatch.setattr(prefix_hash, "SLICE", 1000)
    assert marks_of(long).text() == want


def expected(rows):
    """The contract in plain Python; repeated rows of one id and text are one document."""
    keys = sorted({(d, t or "") for d, t in rows if d is not None})
    after = {k: keys[(i + 1) % len(keys)][1] for i, k in enumerate(keys)}
    out = {}
    for (d, t), following in after.items():
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own = marks_of(t)
        out[d, t] = (
            d, len(t), hashlib.sha256(edited.encode()).hexdigest(), own.text(), marks_of(edited).text(),
            own.likeness(marks_of(edited)), own.likeness(marks_of(following)),
        )
    return sorted(out[d, t or ""] for d, t in rows)


@pytest.mark.parametrize("range_bytes", [1 << 25, 300])
def test_awkward_rows(spark, docs, awkward, monkeypatch, range_bytes):
    monkeypatch.setattr(prefix_hash, "RANGE_BYTES", range_bytes)
    once = [r[:2] for r in awkward if r[0] not in (None, 20)] + [(20, "a" * 90)] * 3
    df = spark.createDataFrame(once, "doc_id long, text string").withColumn("range", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in edited_fingerprints(df).collect())
    assert got == expected(once)
    # Null ids and differing rows of one id stay, one result for each row.
    every = edited_fingerprints(docs)
    assert every.count() == len(awkward) and every.filter("doc_id is null").count() == 2


def test_single_and_empty_tables(spark, no_docs):
    assert edited_fingerprints(no_docs).collect() == [] and fingerprints(no_docs).collect() == []
    (row,) = edited_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0
    (row,) = edited_fingerprints(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()
    assert row["n_chars"] == 0 and row["near_edited"] == 1.0


def test_equal_texts_have_equal_fingerprints(docs):
    found = {}
    for d, t, f in docs.join(fingerprints(docs.filter("doc_id < 20")), "doc_id").select("doc_id", "text", "fingerprint").collect():
        assert found.setdefault(t or "", f) == f
    assert len(set(found.values())) == len(found)


def test_common_extensions(spark, docs):
    places = spark.createDataFrame([(1, 0, 3, 0), (1, 5, 2, 5), (8, 0, 9, 4), (1, 0, 99, 0), (8, 9, 9, 0)], "a long, i long, b long, j long")
    text = {r["doc_id"]: r["text"] for r in docs.filter("doc_id < 20").collect()}
    for a, i, b, j, common in common_extensions(docs.filter("doc_id < 20"), places).collect():
        inside = b in text and i <= len(text[a])
        assert common == (agreeing(text[a][i:], text[b][j:]) if inside else None)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_prefix_fingerprints"](spark, SMALL).collect()) == expected(rows)
