"""Substring dedup by recompression.

Every document's word string is recompressed in rounds. A round first names runs of one symbol, then
names pairs: a hash bit puts each symbol on the left or the right, and a left symbol directly before a
right one merges with it. Names are hashes of what they stand for, so all tasks of the Spark stage that
runs the rounds agree on every name without exchanging a dictionary.

Each symbol carries the word range its naming depends on. Where a long substring repeats, symbols whose
range lies inside it come out the same at every occurrence. Among the symbols whose range lies within a
window of ``width`` words, the window is represented by one of the highest level, of these by the one
with the least name; so equal windows have equal representatives. The key of a window is the name of its
representative, how far before it the window begins in steps of ``NEAR``, and the words that all windows of that
step share; so equal windows have equal keys, and a key stands for a stretch of ``width - NEAR + 1`` words.

* Keys are counted over all documents. Windows whose key occurs in one word sequence only cannot repeat.
* The other windows are hashed (96 bits of content hash), and the least document of each hash tells
  which of them start in an earlier document. This is an aggregation and a join: no pairs of documents
  are formed, and a passage that very many documents share is aggregated before the shuffle.
* Whole word sequences that occur in an earlier document are decided by one grouping and leave the
  window work.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no words. Rows with a null
``doc_id`` lose nothing and take nothing from others. Rows of one ``doc_id`` are judged one by one and
never by each other. A task holds one slice of texts, or one text if that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm import bitset
from oddlot.llm.store import written
from oddlot.llm.tokens import SLICE_BYTES, Words, find_words, flat, int64s, lists, mix, number_mix, slices

ROUNDS = 3
NEAR = 16
FACTS = "doc_id long, n long, s1 long, s2 long, sha string, keys array<long>, spans array<long>"
_P = 0x9FB21C651E98DF25
_Q = 0xC2B2AE3D27D4EB4F
_tables: dict[int, list[np.ndarray]] = {}


def _power(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    if base not in _tables or len(_tables[base][0]) < size:
        _tables[base] = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(max(size, SLICE_BYTES // 2 + 1), b, dtype=np.uint64)
            table[0] = 1
            _tables[base].append(np.cumprod(table, dtype=np.uint64))
    return _tables[base][0], _tables[base][1]


class Ranges:
    """Hashes of word ranges by prefix sums."""

    def __init__(self, hashes: np.ndarray, base: int = _P):
        up, self.down = _power(base, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def levels(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each level as (name, from, to): the word range that the naming depends on.

    Where naming would depend on words beyond the text, ``from`` is -1 or ``to`` is past the end.
    """
    n = len(hashes)
    beyond = np.int64(n + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name, start, end = hashes, np.arange(n), np.arange(1, n + 1)
    out = [(name, start, end)]
    for r in range(rounds):
        # Runs: a symbol is known to be a whole run when both neighbours are known.
        begins = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))))
        count = np.diff(np.append(begins, len(name)))
        after = begins + count
        left = np.where((begins > 0) & (doc[begins - 1] == doc[begins]), start[begins - 1], -1)
        inside = np.minimum(after, len(name) - 1)
        right = np.where((after < len(name)) & (doc[inside] == doc[begins]), end[inside], beyond)
        name = np.where(count > 1, mix(name[begins] + count.astype(np.uint64) * number_mix(100 + r)), name[begins])
        doc, start, end = doc[begins], left, right
        # Pairs: left symbols merge with a right symbol that follows.
        side = (mix(name + number_mix(200 + r)) >> np.uint64(63)).astype(bool)
        joined = np.zeros(len(name), dtype=bool)
        joined[:-1] = ~side[:-1] & side[1:] & (doc[:-1] == doc[1:])
        second = np.concatenate(([False], joined[:-1]))
        next_end = np.append(np.where(doc[:-1] == doc[1:], end[1:], beyond), beyond)
        last_start = np.concatenate(([-1], np.where(doc[:-1] == doc[1:], start[:-1], -1)))
        merged = np.append(mix(name[:-1] * np.uint64(_P) + name[1:] * np.uint64(_Q) + number_mix(300 + r)), np.uint64(0))
        name = np.where(joined, merged, name)
        end = np.where(side, end, next_end)
        start = np.where(side, last_start, start)
        keep = ~second
        name, start, end, doc = name[keep], start[keep], end[keep], doc[keep]
        out.append((name, start, end))
    return out


def representatives(hashes: np.ndarray, first: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Windows (their first words, ascending) and the key of each window's representative."""
    near = max(1, min(NEAR, width // 3))
    n = len(hashes)
    valid = np.zeros(n + 1, dtype=np.int64)
    long_enough = np.diff(first) >= width
    np.add.at(valid, first[:-1][long_enough], 1)
    np.add.at(valid, first[1:][long_enough] - width + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    keys = np.zeros(len(windows), dtype=np.uint64)
    if not len(windows):
        return windows, keys
    ranges = Ranges(hashes)
    open_ = np.arange(len(windows))
    for level, (name, start, end) in reversed(list(enumerate(levels(hashes, first, rounds)))):
        usable = (start >= 0) & (end <= n) & (end - start <= width)
        name, start, end = name[usable], start[usable], end[usable]
        p = windows[open_]
        a = np.searchsorted(start, p, "left")
        b = np.searchsorted(end, p + width, "right") - 1
        has = a <= b
        if has.any():
            a, b = a[has], b[has]
            best = [np.arange(len(name))]
            while 1 << len(best) <= int((b - a).max()) + 1:
                step = 1 << (len(best) - 1)
                x, y = best[-1][:-step], best[-1][step:]
                best.append(np.where(name[x] <= name[y], x, y))
            depth = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            chosen = np.empty(len(a), dtype=np.int64)
            for d in range(len(best)):
                at = np.flatnonzero(depth == d)
                x, y = best[d][a[at]], best[d][b[at] - (1 << d) + 1]
                chosen[at] = np.where(name[x] <= name[y], x, y)
            # Windows of one symbol go by how far they begin before it: ``near`` of them share a stretch.
            begin = start[chosen] - (start[chosen] - p[has]) // near * near
            place = number_mix(level) * (start[chosen] - begin + 1).astype(np.uint64)
            keys[open_[has]] = mix(name[chosen] + place + ranges.of(begin, begin + width - near + 1))
            open_ = open_[~has]
        if not len(open_):
            break
    return windows, keys


def _sequence(hashes: np.ndarray) -> tuple[np.uint64, np.uint64]:
    place = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64))
    return mix(hashes + place).sum(), mix(hashes ^ (place * np.uint64(_Q))).sum()


def _facts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = flat(batch.column("doc_id"))
            for i, j, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                hashes, first = words.hashes(), words.first
                windows, keys = representatives(hashes, first, width)
                doc = np.searchsorted(first, windows, "right") - 1
                change = np.flatnonzero(
                    np.concatenate(([True], (keys[1:] != keys[:-1]) | (windows[1:] != windows[:-1] + 1) | (doc[1:] != doc[:-1])))
                )[: len(windows)]
                last = np.append(change[1:], len(windows)) - 1
                keys, owner = keys[change], doc[change]
                spans = ((windows[change] - first[owner]) << 32) | (windows[last] - first[owner] if len(change) else 0)
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                sums = np.zeros((2, j - i), dtype=np.uint64)
                shas = []
                for d in range(j - i):
                    sums[:, d] = _sequence(hashes[first[d] : first[d + 1]])
                    shas.append(hashlib.sha256(b" ".join(data[offsets[d] : offsets[d + 1]].tobytes().split())).hexdigest())
                parts = [slice(cut[d], cut[d + 1]) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[i:j], pa.array(np.diff(first)), int64s(sums[0]), int64s(sums[1]), pa.array(shas, pa.string()),
                        lists([keys[x] for x in parts]), lists([spans[x].view(np.uint64) for x in parts]),
                    ],
                    names=["doc_id", "n", "s1", "s2", "sha", "keys", "spans"],
                )

    return run


def _window_hashes(hashes: np.ndarray, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    a = Ranges(hashes).of(windows, windows + width)
    b = Ranges(mix(hashes + number_mix(11)), _Q).of(windows, windows + width)
    return a, (b >> np.uint64(33)).astype(np.int32)


def _windows(width: int):
    """Hashes of the windows in the spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = flat(batch.column("doc_id")), flat(batch.column("spans"))
            for i, j, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                hashes, first = words.hashes(), words.first
                windows, owner = [], []
                for d in range(j - i):
                    span = spans[i + d].values.to_numpy()
                    room = first[d + 1] - first[d] - width
                    if room < 0:
                        continue
                    edge = np.zeros(room + 2, dtype=np.int64)
                    np.add.at(edge, np.minimum(span >> 32, room + 1), 1)
                    np.add.at(edge, np.minimum((span & 0xFFFFFFFF) + 1, room + 1), -1)
                    found = np.flatnonzero(np.cumsum(edge)[:-1] > 0) + first[d]
                    windows.append(found)
                    owner.append(np.full(len(found), i + d))
                if not windows:
                    continue
                a, b = _window_hashes(hashes, np.concatenate(windows), width)
                yield pa.RecordBatch.from_arrays(
                    [int64s(a), pa.array(b), ids.take(pa.array(np.concatenate(owner)))], names=["h", "c", "doc_id"]
                )

    return run


def _stretches(words: Words, d: int, hashes: np.ndarray, gone: np.ndarray, width: int) -> tuple[int, list[bytes]]:
    """How many words of text ``d`` lie in a window of ``gone``, and the stretches of the others."""
    lo, hi = words.first[d], words.first[d + 1]
    room = max(0, hi - lo - width + 1)
    hit = np.isin(_window_hashes(hashes[lo:hi], np.arange(room), width)[0].view(np.int64), gone)
    edge = np.zeros(hi - lo + 1, dtype=np.int64)
    edge[:room] += hit
    np.add.at(edge, np.flatnonzero(hit) + width, -1)
    kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    new = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1] + 1)))[: len(kept)]
    stop = np.append(new[1:], len(kept)) - 1
    begins, ends = words.starts[lo + kept[new]], words.ends[lo + kept[stop]] if len(kept) else words.ends[:0]
    return hi - lo - len(kept), [words.data[x:y].tobytes() for x, y in zip(begins, ends, strict=True)]


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    values = column[row].values
    return values.to_numpy() if values is not None else np.zeros(0, dtype=np.int64)


def _digests(width: int):
    """Words removed and the digest of those kept, for each text and its list of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gone = flat(batch.column("doc_id")), flat(batch.column("gone"))
            for i, j, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                hashes = words.hashes()
                sums, counts, out = np.zeros(j - i, dtype=np.uint64), np.zeros(j - i, dtype=np.int64), []
                for d in range(j - i):
                    sums[d] = _sequence(hashes[words.first[d] : words.first[d + 1]])[0]
                    counts[d], parts = _stretches(words, d, hashes, _numbers(gone, i + d), width)
                    out.append(hashlib.sha256(b" ".join(b" ".join(parts).split())).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], int64s(sums), pa.array(counts), pa.array(out, pa.string())],
                    names=["doc_id", "s1", "n_removed", "kept"],
                )

    return run


def _cut(width: int):
    def cut(texts: pa.Array, gone: pa.Array, copies: pa.Array) -> pa.Array:
        out = []
        for i, j, data, offsets in slices(texts):
            words = find_words(data, offsets)
            hashes = words.hashes()
            for d in range(j - i):
                own = _sequence(hashes[words.first[d] : words.first[d + 1]])[:1]
                if np.isin(np.array(own, dtype=np.uint64).view(np.int64), _numbers(copies, i + d)).any():
                    out.append(None)
                    continue
                count, parts = _stretches(words, d, hashes, _numbers(gone, i + d), width)
                whole = data[offsets[d] : offsets[d + 1]].tobytes()
                out.append((b"\n".join(parts) if parts else None) if count else whole)
        return pa.array(out, pa.binary()).cast(pa.string())

    return cut


def _repeats(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts per row, whole sequences that an earlier document has, and ``(doc_id, gone)`` window hashes."""
    facts = written(texts.mapInArrow(_facts(width), FACTS))
    known = facts.filter(f"doc_id is not null and n >= {width}")
    heads = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("head"))
    copies = written(known.join(heads, ["n", "s1", "s2"]).filter("doc_id > head").select("doc_id", "n", "s1", "s2").distinct())

    rows = known.select("doc_id", "s1", F.explode(F.arrays_zip("keys", "spans")).alias("x")).select(
        "doc_id", "s1", F.col("x.keys").alias("key"), F.col("x.spans").alias("span")
    )
    shared = rows.groupBy("key").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).filter("a != b").select("key")
    spans = written(
        rows.join(shared, "key")
        .join(copies.select("doc_id", "s1"), ["doc_id", "s1"], "left_anti")
        .groupBy("doc_id")
        .agg(F.collect_list("span").alias("spans"))
    )
    windows = written(
        bitset.only(texts, spans).join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_windows(width), "h long, c int, doc_id long")
    )
    least = windows.groupBy("h", "c").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    gone = written(
        windows.join(least.select("h", "c", "a"), ["h", "c"])
        .filter("doc_id > a")
        .groupBy("doc_id")
        .agg(F.collect_set("h").alias("gone"))
    )
    return facts, copies, gone


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs(doc_id, text, ...)``.

    A word goes when a window of ``width`` words that covers it also starts in a document with a
    smaller id. The digest is that of the kept words, joined by one space.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts, copies, gone = _repeats(texts, width)
    cut = (
        bitset.only(texts, gone)
        .join(gone, "doc_id")
        .select("doc_id", "text", "gone")
        .mapInArrow(_digests(width), "doc_id long, s1 long, n_removed long, kept string")
        .dropDuplicates(["doc_id", "s1"])
    )
    return (
        facts.select("doc_id", "n", "s1", "s2", "sha")
        .join(copies.withColumn("copy", F.lit(True)), ["doc_id", "n", "s1", "s2"], "left")
        .join(cut, ["doc_id", "s1"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_words"),
            F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )


def cut_texts(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text`` and ``n_chars`` counted anew where it changed.

    Stretches of kept words stay as they were, one to a line. Documents of which nothing is left go;
    documents without words to begin with stay.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, copies, gone = _repeats(texts, width)
    copied = copies.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("s1").alias("__copies"))
    listed = gone.select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    cut = F.arrow_udf(_cut(width), "string")
    return (
        docs.join(listed.join(copied, "__id", "full"), docs.doc_id == F.col("__id"), "left")
        .withColumn("__text", F.when(F.col("__id").isNull(), F.col("text")).otherwise(cut("text", "__gone", "__copies")))
        .filter("__id is null or __text is not null or text is null")
        .withColumn("n_chars", F.when(F.col("__text").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("__text").cast("long")))
        .withColumn("text", F.col("__text"))
        .select(*docs.columns)
    )
