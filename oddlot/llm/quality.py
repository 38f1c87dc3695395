"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL, scored as sparse dot products.

A text's features are one- and two-word n-grams, once over the words with A-Z folded and once over word
shapes (the word's ASCII punctuation, its case, and whether it repeats the word before). Each n-gram is
hashed to one of ``FEATURES`` weights; its value is ``SCALE`` times its share among the text's n-grams of
that kind, ``STEADY`` being added to their number so that a few words say little. A score is the logistic function of bias plus dot product: a mean of weights per kind.

Training follows the regularised leader (FTRL-proximal, per-coordinate rates, L1 and L2) over at most
``sample`` labelled documents, the first in a hashed order of their ids: one task, whatever the table's
size, in a fixed order, so the weights do not depend on partitions. Labels are read for training rows
only. Weights are two arrays of at most ``FEATURES`` numbers, so their broadcast is bounded.

Null and empty texts have no n-grams and score by the bias. A null ``doc_id`` is never a training row;
of several labels for one id the lowest counts. Without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm.tokens import Words, find_words, flat, mix, number_mix, slices

FEATURES = 1 << 18
SCALE = 10.0
STEADY = 4
SAMPLE = 8000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.1, 0.05

_PUNCTUATION = mix(np.arange(5000, 5256, dtype=np.uint64))
_letters = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 0x20, *range(0x09, 0x0E)]
_PUNCTUATION[_letters] = 0
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, dtype=np.int64)
_LOWER[97:123] = 1


def _per_word(table: np.ndarray, words: Words) -> np.ndarray:
    sums = np.zeros(len(words.data) + 1, dtype=table.dtype)
    np.cumsum(table[words.data], out=sums[1:])
    return sums[words.ends] - sums[words.starts]


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hashed places, and the first of each text."""
    first = words.first
    plain = words.hashes(lower=True)
    upper, lower = _per_word(_UPPER, words), _per_word(_LOWER, words)
    case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 2, np.where(upper == 1, 1, 3)))
    inner = np.ones(len(plain), dtype=bool)
    inner[first[:-1][first[:-1] < len(plain)]] = False
    same = np.zeros(len(plain), dtype=bool)
    same[1:] = plain[1:] == plain[:-1]
    same &= inner
    shape = mix(_per_word(_PUNCTUATION, words) + (case + 4 * same).astype(np.uint64) * number_mix(31))
    out = []
    pairs = np.concatenate(([0], np.cumsum(np.maximum(np.diff(first) - 1, 0))))
    for kind, codes in enumerate((plain, shape)):
        out.append((mix(codes + number_mix(40 + kind)), first))
        two = codes[:-1] * number_mix(50 + kind) + codes[1:] if len(codes) else codes
        out.append((mix(two[inner[1:]]) if len(codes) else codes, pairs))
    return [((x & np.uint64(FEATURES - 1)).astype(np.int32), begin) for x, begin in out]


def _vector(kinds: list[tuple[np.ndarray, np.ndarray]], d: int) -> tuple[np.ndarray, np.ndarray]:
    places, values = [], []
    for x, begin in kinds:
        own = x[begin[d] : begin[d + 1]]
        at, count = np.unique(own, return_counts=True)
        places.append(at)
        values.append(count * (SCALE / (len(own) + STEADY)))
    at, where = np.unique(np.concatenate(places), return_inverse=True)
    return at, np.bincount(where, weights=np.concatenate(values), minlength=len(at))


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], bias: int = FEATURES) -> np.ndarray:
    """FTRL-proximal weights; the last one is the bias, which carries no penalty."""
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        free = at == bias
        short = np.where(free, 0.0, L1)
        out = -(z[at] - np.sign(z[at]) * short) / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(free, 0.0, L2))
        return np.where(np.abs(z[at]) <= short, 0.0, out)

    for _ in range(EPOCHS):
        for at, x, label in rows:
            w = weights(at)
            slope = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA
            z[at] += slope - sigma * w
            n[at] += slope * slope
    return weights(np.arange(bias + 1))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        labels = flat(batch.column("label")).to_numpy()
        for i, j, data, offsets in slices(batch.column("text")):
            kinds = features(find_words(data, offsets))
            for d in range(j - i):
                at, x = _vector(kinds, d)
                rows.append((np.append(at, FEATURES), np.append(x, 1.0), int(labels[i + d])))
    w = follow_leader(rows)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from ``labels(doc_id, quality)`` of rows that are not held out."""
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .withColumn("place", F.xxhash64("doc_id", F.lit(3)))
        .orderBy("place", "doc_id")
        .limit(sample)
    )
    # The list has at most ``sample`` rows of three numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found = (
        rows.repartition(1)
        .sortWithinPartitions("place", "doc_id")
        .select("label", "text")
        .mapInArrow(_train, "place long, weight double")
        .toArrow()
    )
    weights = np.zeros(FEATURES + 1)
    weights[flat(found.column("place")).to_numpy()] = flat(found.column("weight")).to_numpy()
    return weights


def _score(weights):
    def score(texts: pa.Array) -> pa.Array:
        out = []
        w = weights.value
        for i, j, data, offsets in slices(texts):
            total = np.full(j - i, w[FEATURES])
            for x, begin in features(find_words(data, offsets)):
                sums = np.concatenate(([0.0], np.cumsum(w[x])))
                count = np.diff(begin)
                total += SCALE * (sums[begin[1:]] - sums[begin[:-1]]) / (count + STEADY)
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a column ``score``: how likely its quality label is 1."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    return docs.withColumn("score", F.arrow_udf(_score(weights), "double")("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text, ...)``."""
    return scored(docs.select("doc_id", "text"), labels, sample).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more."""
    return scored(docs.withColumnRenamed("score", "__score"), labels, sample).filter("score >= 0.5").drop("score").withColumnRenamed(
        "__score", "score"
    )
