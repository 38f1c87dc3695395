"""URL lists, fixity and embeddings."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from oddlot.llm.lattice import cells, near_vectors, nearest
from oddlot.llm.merkle import archived, audit
from oddlot.llm.url_list import decided


def day(n):
    return datetime(2024, 1, n)


def test_captures_meet_the_entries_of_their_day(spark):
    entries = spark.createDataFrame(
        [("bad.example.com", "add", day(3)), ("bad.example.com", "remove", day(10)), ("bad.example.com", "add", day(20)),
         ("example.org/x", "add", day(5)), ("example.net", "add", day(1)), ("example.net", "remove", day(1)), (None, "add", day(1)),
         ("tie.com", "add", None)],
        "key string, action string, at timestamp_ntz",
    )
    urls = [
        (1, "http://bad.example.com/a", day(2), None), (2, "http://bad.example.com/a", day(3), "bad.example.com"),
        (3, "HTTP://user@sub.BAD.example.com:80/a", day(9), "bad.example.com"), (4, "http://bad.example.com/a", day(10), None),
        (5, "https://bad.example.com", day(25), "bad.example.com"), (6, "http://example.org/x?q", day(6), "example.org/x"),
        (7, "http://example.org/y", day(6), None), (8, "http://a.example.net/", day(2), None), (9, None, day(2), None),
        (10, "http://bad.example.com/a", None, None), (None, "http://bad.example.com/b", day(4), "bad.example.com"), (12, "nonsense", day(4), None),
        (2, "http://bad.example.com/a", day(3), "bad.example.com"),
    ]
    captures = spark.createDataFrame([u[:3] for u in urls], "page_id long, url string, fetched_at timestamp_ntz").withColumn("key", F.lit(1))
    got = decided(captures, entries).collect()
    assert {(r.page_id, r.url, r.fetched_at, r.matched_key) for r in got} == set(urls)
    assert len(got) == 12 and sum(r.n_rows for r in got) == 13
    assert all(r.blocked == (r.matched_key is not None) for r in got)
    assert decided(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in decided(captures, entries.limit(0)).collect())


def test_audit_finds_exactly_what_differs(spark):
    pages = spark.createDataFrame(
        [(i, f"http://x/{i}", "body " * (i * 37 % 900)) for i in range(900)] + [(3, None, None), (3, None, None), (None, "u", "h")],
        "page_id long, url string, html string",
    )
    left = archived(pages, 400).withColumnRenamed("page_id", "record_id")
    right = left.withColumn("digest", F.when(F.col("record_id").isin(5, 399, 700), "?").otherwise(F.col("digest"))).filter(
        "record_id is null or record_id not in (0, 401)"
    )
    got = {(r.record_id, r.kind) for r in audit(left, right).collect()}
    assert got == {(5, "altered"), (399, "altered"), (700, "altered"), (0, "missing"), (401, "missing")}
    assert {(r.record_id, r.kind) for r in audit(right, left).collect()} >= {(0, "extra"), (401, "extra")}
    assert audit(left, left).count() == 0 and audit(left.limit(0), right.limit(0)).count() == 0
    assert audit(left, left.limit(0)).count() == left.filter("archive is not null").select("archive", "offset").distinct().count()


def test_damage_to_records_without_an_id_is_found(spark):
    pages = spark.createDataFrame([(None, "u", "h"), (None, None, "i"), (1, "v", "j"), (None, "w", "k")], "page_id long, url string, html string")
    left = archived(pages).withColumnRenamed("page_id", "record_id")
    assert left.filter("archive is null").count() == 0 and left.filter("record_id is null").select("archive").distinct().count() == 3
    right = left.withColumn("digest", F.when(F.col("url") == "u", "?").otherwise(F.col("digest"))).filter("coalesce(url, '') <> 'w'")
    assert sorted((r.record_id, r.kind) for r in audit(left, right).collect()) == [(None, "altered"), (None, "missing")]
    none, gone = left.withColumn("archive", F.lit(None).cast("long")), right.withColumn("archive", F.lit(None).cast("long"))
    assert {r.kind for r in audit(none, gone).collect()} and audit(none, none).count() == 0


def test_lattice_points_are_the_nearest():
    y = np.random.default_rng(4).standard_normal((300, 8)) * 2
    points = nearest(y)
    assert (((y - points) ** 2).sum(axis=1) <= 1 + 1e-9).all()
    from oddlot.llm.lattice import SHORTEST

    assert len(SHORTEST) == 240
    off = y - points
    assert ((off**2).sum(axis=1)[:, None] <= ((off[:, None, :] - SHORTEST[None]) ** 2).sum(axis=2) + 1e-9).all()


def test_recall_at_the_least_cosine():
    dice = np.random.default_rng(6)
    a = dice.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = dice.standard_normal((400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(cells(a), cells(0.95 * a + np.sqrt(1 - 0.95**2) * b), strict=True)]
    assert np.mean(met) >= 0.95


def test_links_against_brute_force(spark):
    dice = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = dice.standard_normal(16)
        for _ in range(c + 1):
            rows.append((centre + dice.standard_normal(16) * 0.12).astype(np.float32).tolist())
    rows += [rows[5], rows[5], [0.0] * 16, None, [1.0, float("nan")], [1.0, None], [float("inf")] * 16, [], [3.0, 4.0], [6.0, 8.0]]
    table = list(enumerate(rows)) + [(None, rows[0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).repartition(3)
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(got) == len(table)

    def fine(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(x, y):
        if not (fine(x) and fine(y) and len(x) == len(y)):
            return False
        x, y = np.float64(np.float32(x)), np.float64(np.float32(y))
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95

    near = {i: [j for j, y in enumerate(rows) if j != i and linked(x, y)] for i, x in enumerate(rows)}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), min(seen), min(seen) == i)
    assert got[None].n_links == 0 and got[None].component_id is None and not got[None].kept
    assert near_vectors(df.limit(0)).count() == 0
