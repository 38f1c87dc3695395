"""Licence scan: a trained paragraph classifier with template comparison.

Paragraphs are the lines of a text, and runs of lines up to a blank line that a hard-wrapped notice goes on
over: a run goes on where the words on both sides of a line end are a word pair of a notice (comment marks
between them aside), or where both lines have a licence by themselves. A run is reported, by its first line,
if it holds more of a notice than each of its lines of that family; its unconfirmed lines then are not. Their features are the one-, two- and three-word n-grams (A-Z folded,
outer punctuation dropped), hashed to ``FEATURES`` places, present or not. One logistic regression per
licence family is fitted by FTRL with an L1 penalty, so nearly all weights are zero and a paragraph
without a licence's words costs a table look-up per n-gram.

Training rows are variants of the families' notices (words dropped, ordinary words of the corpus around
them) against ordinary paragraphs: of at most ``sample`` documents, the first in a hashed order, the
``ordinary`` lines that come first by a hash of their text, each text once. Nothing is labelled, so a line with
licence wording (``WORDING``) or half a notice is no ordinary line; what such words mean elsewhere is learned
from ``PROSE``. A third of
the variants is held back.

One more regression tells licence wording of any family, those of ``OTHERS`` included, from ordinary prose.
For calibration each of ``FOLDS`` rounds also leaves whole families and some ordinary sentences (``PROSE``)
out of training and scores the families as unknowns. On the held-back scores of all rounds one temperature minimises the log loss and two thresholds
are set: the best family counts where it stands apart from unknown families; below that a paragraph with
licence wording is reported as ``unknown``. Families of ``OTHERS`` train the thresholds and are ``unknown`` too.

What is predicted is compared with the family's notices: ``overlap`` is the largest share of a notice's
two-word shingles found in the paragraph, and ``confirmed`` means ``CONFIRMED`` or more.

Null and empty texts have no paragraphs. Rows with a null id, repeated rows and repeated paragraphs are
reported like any others, each with its line number. An ``unknown`` row has the largest overlap with
any family's notice and is never confirmed. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm.quality import ALPHA, BETA, EPOCHS, L1, L2
from oddlot.llm.tokens import Words, find_words, flat, mix, number_mix, slices

FEATURES = 1 << 16
SAMPLE = 500
ORDINARY = 3000
VARIANTS = 60
CONFIRMED = 0.6
FOLDS = 5
#: A false row weighs as much as so many missed ones: there are far more ordinary lines than notices.
FALSE_WEIGHT = 30
#: Parts of words that make a line unfit as an example of ordinary prose.
WORDING = re.compile(r"licen[cs]|copyright|copyleft|©|reserved|redistribut|permi(t|ssion)|public domain|warrant|proprietary|creative commons|\bCC[ -]?(0|BY)\b|hereby", re.I)
UNKNOWN = "unknown"

#: Notices of each family, as they are found in works.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": ["Released under CC0 1.0 Universal, dedicated to the public domain."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."],
}
#: Notices of families that are reported as unknown.
OTHERS = {
    "AGPL": ["This program is free software under the GNU Affero General Public License, version 3."],
    "Artistic": ["You may redistribute it under the terms of the Artistic License 2.0."],
    "BSL": ["Distributed under the Boost Software License, Version 1.0."],
    "BUSL": ["Use of this software is governed by the Business Source License included in the LICENSE file."],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CDDL": ["The contents of this file are subject to the terms of the Common Development and Distribution License."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License."],
    "EUPL": ["Licensed under the EUPL, Version 1.2 or later."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages."],
    "evaluation": ["You may use this software for evaluation purposes only; redistribution is not permitted."],
    "consent": ["You may not copy, modify or distribute this material without the prior written consent of the publisher."],
    "agreement": ["Use of this material is subject to the terms of the enclosed licence agreement."],
    "personal": ["Free for personal and educational use; commercial use requires a licence."],
}
#: Ordinary sentences with the words of notices, whatever the corpus holds.
PROSE = [
    "The driver showed a license and was free to go.",
    "The work of the day is under way, and the file is on the table.",
    "She asked for permission to leave, and it was granted at once.",
    "All of the tickets for the concert were reserved in advance.",
    "The general public is welcome to the gardens without charge.",
    "You may find that the program is on at eight, or later, in your area.",
    "In this part of the country the source of the river is free of any form of life.",
    "The conditions in the house were met with surprise by the person from the office.",
    "He released the rope and the boat was subject to the wind.",
    "Version 2.0 of the plan was under discussion for the rest of the week.",
    "The students use the software for their work at the university.",
    "They may not be able to modify the terms, but it is possible to copy the list.",
    "No part of the old town was spared, and some words were said before and after.",
    "International commons and creative people make the first line of the report.",
    "The authors of the book held that any use of the word is in the public interest.",
]
FAMILIES = list(NOTICES)
_OUTER = np.zeros(256, dtype=bool)
_OUTER[[ord(c) for c in ".,;:!?()[]{}<>\"'*_/"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "#*/;-%>|"]] = True


def paragraph_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words without outer punctuation, grouped by line; the text of each line, and its number there."""
    ends = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate((offsets, ends + 1)))
    words = find_words(data, edges)
    for _ in range(2):
        words.ends -= _OUTER[data[words.ends - 1]] & (words.ends - words.starts > 1)
        words.starts += _OUTER[data[words.starts]] & (words.ends - words.starts > 1)
    doc = np.searchsorted(offsets, edges[:-1], "right") - 1
    return words, doc, np.arange(len(doc)) - np.searchsorted(doc, doc)


def grams(words: Words, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three words with the hashes ``one``, and the line of each."""
    line = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    codes, owner = [one], [line]
    for n in (2, 3):
        if len(one) >= n:
            same = line[n - 1 :] == line[: len(line) - n + 1]
            code = sum((one[j : len(one) - n + 1 + j] * number_mix(60 + 10 * n + j) for j in range(1, n)), one[: len(one) - n + 1] * number_mix(60 + 10 * n))
            codes.append(mix(code[same]))
            owner.append(line[n - 1 :][same])
    return (np.concatenate(codes) & np.uint64(FEATURES - 1)).astype(np.int64), np.concatenate(owner)


def _of(texts: list[str]) -> list[np.ndarray]:
    """The distinct n-grams of texts of one line each."""
    raw = [t.replace("\n", " ").encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    words = find_lines(data, offsets)
    places, line = grams(words, words.hashes(lower=True))
    order = np.argsort(line, kind="stable")
    cut = np.searchsorted(line[order], np.arange(len(texts) + 1))
    return [np.unique(places[order[cut[x] : cut[x + 1]]]) for x in range(len(texts))]


def find_lines(data: np.ndarray, offsets: np.ndarray) -> Words:
    return paragraph_words(data, offsets)[0]


def _examples(ordinary: list[str]) -> list[tuple[str, int, bool]]:
    """Text, family and whether it is held back.

    Families from ``len(FAMILIES)`` on are those of ``OTHERS``; -1 is an ordinary line, below are those of ``PROSE``.
    """
    dice = np.random.default_rng(5)
    filler = " ".join(ordinary[:200]).split() or ["and"]
    out = [(t, -1, x % 3 == 0) for x, t in enumerate(ordinary)]
    groups = [*enumerate((NOTICES | OTHERS).values()), *((-2 - x, [line]) for x, line in enumerate(PROSE))]
    for f, notices in groups:
        for notice in notices:
            for x in range(VARIANTS if f >= 0 else VARIANTS // 3):
                words = [w for w in notice.split() if x == 0 or dice.random() > 0.08]
                around = [[filler[k] for k in dice.integers(0, len(filler), dice.integers(0, 12))] for _ in range(2)] if x % 2 else [[], []]
                out.append((" ".join([*around[0], *words, *around[1]]), f, x % 3 == 1))
    order = dice.permutation(len(out))
    return [out[x] for x in order]


def _follow_leaders(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """FTRL-proximal weights, as ``quality.follow_leader``, of one regression per label of ``(places, labels)``."""
    z, n = (np.zeros((FEATURES + 1, len(FAMILIES) + 1)) for _ in range(2))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The last row is the bias, which carries no penalty."""
        free = np.arange(len(z))[:, None] == len(z) - 1
        short = np.where(free, 0.0, L1)
        out = -(z - np.sign(z) * short) / ((BETA + np.sqrt(n)) / ALPHA + np.where(free, 0.0, L2))
        return np.where(np.abs(z) <= short, 0.0, out)

    for _ in range(EPOCHS):
        for at, labels in rows:
            own, seen = z[at], n[at]
            w = weights(own, seen)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(axis=0), -35, 35))) - labels
            more = seen + slope * slope
            z[at] = own + slope - (np.sqrt(more) - np.sqrt(seen)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def _threshold(wanted: np.ndarray, unwanted: np.ndarray) -> float:
    """The score from which a row counts: least misses and false rows, in the middle of the widest gap."""
    values = np.unique(np.concatenate((wanted, unwanted)))
    if len(values) < 2:
        return 0.0
    between = (values[1:] + values[:-1]) / 2
    missed = np.searchsorted(np.sort(wanted), between) / max(1, len(wanted))
    false = 1 - np.searchsorted(np.sort(unwanted), between) / max(1, len(unwanted))
    loss = missed + FALSE_WEIGHT * false
    least = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(between[least[np.diff(values)[least].argmax()]])


def fitted(ordinary: list[str]) -> np.ndarray:
    """Weights of all families and of licence wording, the bias, and last the score from which each counts.

    All are divided by the calibrating temperature.
    """
    rows = _examples(ordinary)
    places = [np.append(at, FEATURES) for at in _of([t for t, _, _ in rows])]
    family, held = np.array([f for _, f, _ in rows]), np.array([h for _, _, h in rows])
    labels = np.column_stack((family[:, None] == np.arange(len(FAMILIES)), family >= 0))

    def trained(chosen: np.ndarray) -> np.ndarray:
        return _follow_leaders([(places[x], labels[x]) for x in np.flatnonzero(chosen)])

    scores, truth, unknown = [], [], []
    for fold in range(FOLDS):
        out = (family != -1) & (family % FOLDS == fold)
        weights = trained(~held & ~out)
        scored = np.flatnonzero(held | out)
        scores.append(np.array([weights[places[x]].sum(axis=0) for x in scored]))
        truth.append(np.where(out[scored] & (family[scored] >= 0), len(FAMILIES), family[scored]))
        unknown.append(truth[-1] >= len(FAMILIES))
    scores, truth, unknown = np.concatenate(scores), np.concatenate(truth), np.concatenate(unknown)
    wanted = np.column_stack((truth[:, None] == np.arange(len(FAMILIES)), truth >= 0))
    known = (truth >= 0) & ~unknown
    best = scores[:, :-1].max(axis=1)
    right = scores[known, truth[known]]
    cuts = np.full(len(FAMILIES) + 1, max(_threshold(right, best[unknown]), _threshold(right, best[truth < 0])))
    cuts[-1] = _threshold(scores[truth >= 0, -1], scores[truth < 0, -1])

    def loss(temperature: float) -> float:
        z = np.where(wanted, scores, -scores) / temperature
        return np.logaddexp(0, -z).mean()

    return np.vstack((trained(~held), cuts)) / min(np.geomspace(0.25, 4, 33), key=loss)


def _is_notice(text: str) -> bool:
    return bool(_overlaps(text)[0] >= 0.5)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * number_mix(80) + right * number_mix(81))


def _pairs(text: str) -> set[int]:
    raw = np.frombuffer(text.replace("\n", " ").encode(), dtype=np.uint8)
    one = find_lines(raw, np.array([0, len(raw)])).hashes(lower=True)
    return set(_pair(one[:-1], one[1:]).tolist()) if len(one) > 1 else set(one.tolist())


@lru_cache(maxsize=1)
def _templates() -> list[tuple[int, set[int]]]:
    return [(f, _pairs(n)) for f, family in enumerate(FAMILIES) for n in NOTICES[family]]


@lru_cache(maxsize=1)
def _all_pairs() -> np.ndarray:
    notices = [n for own in (NOTICES | OTHERS).values() for n in own if len(n.split()) > 1]
    return np.array(sorted(set().union(*map(_pairs, notices))), dtype=np.uint64)


def _overlaps(text: str, family: int | None = None) -> tuple[float, int]:
    """The largest share of a notice found in a text, and that notice's family."""
    own = _pairs(text)
    return max((len(own & t) / len(t), f) for f, t in _templates() if family in (None, f))


def ordinary_lines(texts: Iterable[str | None], ordinary: int) -> list[str]:
    """The first lines by hash, of all texts, that may teach what no licence is."""
    lines = {line for text in texts for line in (text or "").split("\n") if line.strip() and not WORDING.search(line)}
    drawn = sorted((zlib.crc32(line.encode()), line) for line in lines)
    return list(islice((line for _, line in drawn if not _is_notice(line)), ordinary))


def _train(ordinary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = fitted(ordinary_lines((text for batch in batches for text in batch.column("text").to_pylist()), ordinary))
        place, family = np.nonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(family), pa.array(weights[place, family])], names=["place", "family", "weight"]
        )

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> np.ndarray:
    chosen = docs.filter("text is not null").select("text", F.xxhash64("doc_id", F.lit(2)).alias("dice"))
    found = chosen.orderBy("dice", "text").limit(sample).select("text").repartition(1).mapInArrow(
        _train(ordinary), "place long, family long, weight double"
    ).toArrow()
    weights = np.zeros((FEATURES + 2, len(FAMILIES) + 1))
    place, family, weight = (flat(found.column(c)).to_numpy() for c in ("place", "family", "weight"))
    weights[place, family] = weight
    return weights


def _decided(words: Words, one: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Line, family (the last for unknown) and probability of each line with a licence."""
    places, line = grams(words, one)
    hit = np.flatnonzero((weights[:FEATURES] != 0).any(axis=1)[places])
    if not len(hit):
        return []
    bias, cuts = weights[FEATURES:]
    pairs = np.unique(line[hit] * np.int64(FEATURES) + places[hit])
    line, places = pairs // FEATURES, pairs % FEATURES
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    scores = np.add.reduceat(weights[places], begin, axis=0) + bias
    best = scores[:, :-1].argmax(axis=1)
    best[scores[np.arange(len(best)), best] < cuts[0]] = len(FAMILIES)
    score = scores[np.arange(len(best)), best]
    chance = 1 / (1 + np.exp(-np.clip(score, -35, 35)))
    return [(int(line[begin[x]]), int(best[x]), float(chance[x])) for x in np.flatnonzero(score >= cuts[best])]


def _runs(words: Words, one: np.ndarray, doc: np.ndarray, licensed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the runs that a notice may go on over."""
    if len(doc) < 2 or not len(one):
        return (np.zeros(0, dtype=np.int64),) * 2
    first = words.first
    filled = np.diff(first) > 0
    lead = np.minimum(first[:-1], len(one) - 1)
    mark = (np.diff(first) > 1) & (words.ends[lead] - words.starts[lead] == 1) & _MARK[words.data[words.starts[lead]]]
    pair = _pair(one[first[1:-1] - 1], one[(lead + mark)[1:]])
    has = np.zeros(len(doc), dtype=bool)
    has[licensed] = True
    on = filled[:-1] & filled[1:] & (doc[:-1] == doc[1:]) & (np.isin(pair, _all_pairs()) | (has[:-1] & has[1:]))
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            ids = flat(batch.column("doc_id"))
            for i, _, data, offsets in slices(batch.column("text")):
                words, doc, number = paragraph_words(data, offsets)
                one = words.hashes(lower=True)

                def compared(begin: int, end: int, f: int, chance: float) -> tuple[int, int, float, float]:
                    text = data[words.starts[words.first[begin]] : words.ends[words.first[end + 1] - 1]].tobytes().decode()
                    return begin, f, chance, _overlaps(text, f if f < len(FAMILIES) else None)[0]

                found = {at: compared(at, at, f, chance) for at, f, chance in _decided(words, one, weights)}
                begins, ends = _runs(words, one, doc, list(found))
                sizes = words.first[ends + 1] - words.first[begins]
                starts = np.concatenate(([0], np.cumsum(sizes)))
                own = np.arange(starts[-1]) + np.repeat(words.first[begins] - starts[:-1], sizes)
                wrapped = []
                for x, f, chance in _decided(Words(data, words.starts[own], words.ends[own], starts), one[own], weights):
                    whole = compared(begins[x], ends[x], f, chance)
                    lines = [found[at] for at in range(begins[x], ends[x] + 1) if at in found]
                    if any(r[3] >= whole[3] for r in lines if f in (r[1], len(FAMILIES))):
                        continue
                    wrapped.append(whole)
                    for r in lines:
                        if r[1] == len(FAMILIES) or r[3] < CONFIRMED:
                            del found[r[0]]
                rows = [
                    (i + doc[at], number[at], [*FAMILIES, UNKNOWN][f], round(chance, 6), round(overlap, 6), f < len(FAMILIES) and overlap >= CONFIRMED)
                    for at, f, chance, overlap in [*found.values(), *wrapped]
                ]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(columns[0])), pa.array(columns[1], pa.int64()), *(pa.array(list(c)) for c in columns[2:])],
                        names=["doc_id", "paragraph", "family", "probability", "overlap", "confirmed"],
                    )

    return run


def licensed_paragraphs(docs: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> DataFrame:
    """``doc_id, paragraph, family, probability, overlap, confirmed`` for each paragraph with a licence, known or not."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, ordinary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _scan(weights), "doc_id long, paragraph long, family string, probability double, overlap double, confirmed boolean"
    )
