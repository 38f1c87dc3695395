"""Quality, licences, packing and sharding."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from oddlot.llm.interleave import interleaved_shards
from oddlot.llm.licences import NOTICES, OTHERS, licensed_paragraphs, ordinary_lines
from oddlot.llm.packing import first_fit_decreasing, pack_sequences
from oddlot.llm.quality import good_documents, quality_scores
from tests.conftest import SMALL


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for _, r in held)
    assert np.mean([q == r.predicted for q, r in held]) > 0.98


def test_quality_of_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (11, None), (999, 0)], "doc_id long, quality int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5, 6, 7)}) == 1
    assert quality_scores(no_docs, labels).count() == 0
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert good_documents(docs, labels.limit(0)).columns == docs.columns


def test_licence_families(spark, docs):
    notices = {
        200: ("first line\nReleased under the MIT License.", "MIT", 1), 201: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC", 0),
        202: ("some words before\n\nThis work is licensed under the GNU General Public License, version 3.\nafter", "GPL", 2),
    }
    rows = [(d, t) for d, (t, _, _) in notices.items()]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = licensed_paragraphs(both).collect()
    assert {(r.doc_id, r.family, r.paragraph) for r in got if r.confirmed} == {(d, f, p) for d, (_, f, p) in notices.items()}
    assert licensed_paragraphs(both.limit(0)).count() == 0


def test_licences_of_other_families_are_unknown(spark, docs):
    texts = {
        300: "Licensed under the Academic Free License version 3.0.", 301: "some words before\nReleased under the Python Software Foundation License.",
        302: "Licensed under CC BY-ND 4.0.",
    }
    prose = {310: "The cat sat on the mat and looked out of the window at the rain.", 311: "He lost his license after the accident on the public road."}
    both = docs.select("doc_id", "text").union(spark.createDataFrame([*texts.items(), *prose.items()], "doc_id long, text string"))
    got = [r for r in licensed_paragraphs(both).collect() if (r.doc_id or 0) >= 300]
    assert {(r.doc_id, r.family, r.paragraph, r.confirmed) for r in got} == {(d, "unknown", int(d == 301), False) for d in texts}
    assert not {"Academic", "Python"} & {w for notices in {**NOTICES, **OTHERS}.values() for n in notices for w in n.split()}


def test_ordinary_lines_come_from_all_documents(spark, docs):
    worded = "Permission to use, copy and distribute this software and its documentation is hereby granted."
    texts = ["\n".join(f"line {d} {i}" for i in range(500)) for d in range(40)]
    drawn = ordinary_lines([*texts, worded, "Released under the MIT License.", None], 300)
    assert len(drawn) == 300 and len({line.split()[1] for line in drawn}) > 30
    assert drawn == ordinary_lines([*texts[::-1], worded], 300)
    assert not [line for line in ordinary_lines([*texts, worded], 10**6) if "granted" in line]
    rows = spark.createDataFrame([(303, worded)], "doc_id long, text string").union(docs.select("doc_id", "text"))
    assert [(r.doc_id, r.family) for r in licensed_paragraphs(rows).collect()] == [(303, "unknown")]


def test_wrapped_notices_are_one_paragraph(spark, docs):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License."
    texts = {
        400: (bsd, "BSD", 0), 401: (f"some words before\n{bsd.replace(' and ', chr(10) + 'and ', 1)}\nafter", "BSD", 1), 402: (gpl, "GPL", 0),
        403: ("before\n\n" + bsd, "BSD", 2),
    }
    rows = [(d, t) for d, (t, _, _) in texts.items()]
    got = licensed_paragraphs(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.family, r.paragraph) for r in got) == sorted((d, f, p) for d, (_, f, p) in texts.items())
    assert all(r.confirmed and r.overlap > 0.9 for r in got)


def test_packing_is_a_round_trip(docs, awkward, no_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_sequences(docs).collect()
    want = Counter()
    for d, t in [r[:2] for r in awkward]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[d, len(ids)] += len(ids)
        for r in rows:
            if r.doc_id == d and r.doc_tokens == len(ids) and d is not None and d not in (20,):
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    got = Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert pack_sequences(no_docs).count() == 0


def test_first_fit_is_first_fit():
    dice = np.random.default_rng(2)
    sizes = dice.integers(1, 100, 300)
    bins, offsets = first_fit_decreasing(sizes, 100)
    room = []
    for at in np.argsort(-sizes, kind="stable"):
        chosen = next((b for b, r in enumerate(room) if r >= sizes[at]), len(room))
        if chosen == len(room):
            room.append(100)
        assert bins[at] == chosen and offsets[at] == 100 - room[chosen]
        room[chosen] -= sizes[at]


def test_shards_match_the_mixture(spark, docs, awkward, no_docs):
    rows = interleaved_shards(docs, shards=5).collect()
    sizes = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in awkward)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == sizes
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    assert interleaved_shards(no_docs).count() == 0
    real = interleaved_shards(spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet"), shards=10).collect()
    total = Counter(r.source for r in real)
    mixed = Counter((r.source, r.shard) for r in real)
    assert all(abs(mixed[s, k] - total[s] / 10) <= 2 for s in total for k in range(10))
