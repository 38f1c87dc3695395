"""Document fingerprints by prefix polynomial hashes.

The code points ``c`` of a text give the prefix array ``P[i] = sum((c[j] + 1) * base**j for j < i)``, modulo
two primes below 2**31. The hash of any span ``[i, j)`` is ``(P[j] - P[i]) / base**i``, so two spans of any
texts are compared in constant time, and the longest common extension of two positions is found by binary
search over its length.

* ``fingerprints`` keeps of each prefix array the values at multiples of a power of two, from the start and
  from the end, between 33 and 64 of them on each side (all, in shorter texts). Steps are nested, so
  fingerprints of texts of any two lengths share marks.
* ``Marks.likeness`` finds the longest common extensions of two fingerprints from both ends by binary
  search over their shared marks, as a share of the longer text. It never overstates by more than a
  collision; it understates by at most one step at each end. Equal fingerprints are alike by 1.
* ``common_extensions`` answers exact longest common extensions for given positions of given documents.
* ``edited_fingerprints`` compares each document with an edited copy of itself and with the next document.

Texts are hashed in slices of ``SLICE`` code points, so memory follows the slice and the text itself. For
the next document, rows are dealt by ranges of ``(doc_id, hash of the text)`` whose bounds are rows
themselves; a bound row also goes to the range before it, where it follows the last row. Texts travel
compressed, once.

Null texts are empty. Rows that repeat an id and its text are one document, and each of them gets that
document's result; rows that share an id with different texts are documents of their own, in the order of
their texts' hashes. Rows without an id come after all others. Bytes that are no UTF-8 count as U+FFFD.
Empty tables give empty results; columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
from binascii import b2a_base64
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm.store import written

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 69_621_013)
MOST_MARKS = 64
SLICE = 1 << 20
#: Bytes of text in a range of documents.
RANGE_BYTES = 32 << 20

_tables: dict[tuple[int, bool], np.ndarray] = {}


def _powers(r: int, size: int, inverse: bool = False) -> np.ndarray:
    """``base**i`` (or its inverse) for ``i < size`` modulo the ``r``-th prime; ``size`` is at most ``SLICE + 1``."""
    table = _tables.get((r, inverse), np.ones(1, dtype=np.uint64))
    while len(table) < size:
        more = _power(r, len(table), inverse)
        table = np.concatenate((table, table * np.uint64(more) % np.uint64(PRIMES[r])))
    _tables[r, inverse] = table
    return table


@lru_cache(maxsize=100_000)
def _power(r: int, exponent: int, inverse: bool = False) -> int:
    return pow(BASES[r], -exponent if inverse else exponent, PRIMES[r])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def prefix_values(text: str, at: np.ndarray) -> np.ndarray:
    """``P`` at the sorted positions ``at``, one row per prime."""
    out = np.zeros((2, len(at)), dtype=np.uint64)
    total = [0, 0]
    for begin in range(0, max(1, int(at[-1]) if len(at) else 0), SLICE):
        codes = codes_of(text[begin : begin + SLICE]).astype(np.uint64) + np.uint64(1)
        i, j = np.searchsorted(at, [begin, begin + len(codes)], "right")
        i = 0 if begin == 0 else i
        for r, prime in enumerate(PRIMES):
            terms = codes * _powers(r, len(codes))[: len(codes)] % np.uint64(prime)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64))) % np.uint64(prime)
            shift = np.uint64(_power(r, begin))
            out[r, i:j] = (sums[at[i:j] - begin] * shift + np.uint64(total[r])) % np.uint64(prime)
            total[r] = (int(sums[-1]) * int(shift) + total[r]) % prime
    return out


@dataclass
class Prefixes:
    """The whole prefix arrays of a text."""

    n: int
    values: np.ndarray

    @classmethod
    def of(cls, text: str) -> Prefixes:
        return cls(len(text), prefix_values(text, np.arange(len(text) + 1)))

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of code points ``i`` to ``j``; equal spans have equal hashes wherever they stand."""
        a, b = ((int(v[j]) - int(v[i])) * _power(r, i, True) % PRIMES[r] for r, v in enumerate(self.values))
        return a, b

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """The longest common extension: how many code points from ``i`` here and ``j`` there agree."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low


def step_of(n: int) -> int:
    """The distance of marks in a text of ``n`` code points, a power of two."""
    step = 1
    while n > MOST_MARKS * step:
        step *= 2
    return step


def mark_positions(n: int) -> np.ndarray:
    """The lengths of the prefixes and suffixes that a fingerprint marks."""
    step = step_of(n)
    return np.arange(1, n // step + 1) * step


@dataclass
class Marks:
    """What a fingerprint holds: length, hash of the whole, and hashes of marked prefixes and suffixes."""

    n: int
    whole: tuple[int, int]
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, n: int, at: np.ndarray, values: np.ndarray) -> Marks:
        """From prefix values at positions that hold all marks of a text of ``n`` code points."""
        marks = mark_positions(n)
        first, prime = values[0], np.uint64(PRIMES[0])
        whole = values[:, np.searchsorted(at, n)]
        back = n - marks
        ends = (whole[0] + prime - first[np.searchsorted(at, back)]) % prime
        down = np.array([_power(0, int(x), True) for x in back], dtype=np.uint64) if n > SLICE else _powers(0, n + 1, True)[back]
        return cls(n, (int(whole[0]), int(whole[1])), first[np.searchsorted(at, marks)], ends * down % prime)

    def text(self) -> str:
        """The fingerprint: the length, then all hashes as 32-bit numbers in base 64."""
        numbers = np.concatenate((np.array(self.whole, dtype=np.uint64), self.starts, self.ends)).astype(">u4")
        return f"{self.n}:{b2a_base64(numbers.tobytes(), newline=False).decode()}"

    def likeness(self, other: Marks) -> float:
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        step = max(step_of(self.n), step_of(other.n))
        most = min(self.n, other.n) // step
        both = sum(
            _agreeing(a[step // step_of(self.n) - 1 :: step // step_of(self.n)], b[step // step_of(other.n) - 1 :: step // step_of(other.n)], most)
            for a, b in ((self.starts, other.starts), (self.ends, other.ends))
        )
        return min(both * step, min(self.n, other.n)) / max(self.n, other.n)


def _agreeing(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """How many leading marks agree; where one does, all before it do."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[middle - 1] == b[middle - 1]:
            low = middle
        else:
            high = middle - 1
    return low


def _mark_places(n: int) -> np.ndarray:
    marks = mark_positions(n)
    return np.concatenate((marks, n - marks, [n]))


def marks_of(text: str) -> Marks:
    at = np.unique(_mark_places(len(text)))
    return Marks.of(len(text), at, prefix_values(text, at))


def edited_marks(text: str, following: str) -> tuple[Marks, str, Marks]:
    """Marks of the text; its edited text, the last quarter replaced by the head of the following one; marks of that.

    The edited text is not hashed again: its prefix values are those of the two parts put together.
    """
    n = len(text)
    cut = n - n // 4
    head = following[: n // 4]
    size = cut + len(head)
    places = _mark_places(size)
    own = np.unique(np.concatenate((_mark_places(n), places[places <= cut], [cut])))
    values = prefix_values(text, own)
    at = np.unique(places)
    later = at[at > cut]
    tail = prefix_values(head, later - cut)
    before = values[:, np.searchsorted(own, cut)]
    joined = np.concatenate((values[:, np.searchsorted(own, at[at <= cut])], tail), axis=1)
    for r, prime in enumerate(PRIMES):
        joined[r, len(at) - len(later) :] = (tail[r] * np.uint64(_power(r, cut)) + before[r]) % np.uint64(prime)
    return Marks.of(n, own, values), text[:cut] + head, Marks.of(size, at, joined)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` per row of ``docs(doc_id, text, ...)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [marks_of((t.as_py() or b"").decode("utf-8", "replace")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m.n for m in marks], pa.int64()), pa.array([m.text() for m in marks], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def common_extensions(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places(a, i, b, j)`` with ``common``: the code points from ``i`` in document ``a`` that agree with those
    from ``j`` in document ``b``. Documents are taken by an id that occurs once; places outside a text, and
    unknown documents, give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, i, y, j in zip(*(batch.column(c).to_pylist() for c in ("x", "i", "y", "j")), strict=True):
                known = None not in (x, i, y, j)
                a, b = (Prefixes.of(t.decode("utf-8", "replace")) if known else None for t in (x, y))
                inside = known and 0 <= i <= a.n and 0 <= j <= b.n
                found.append(a.common(i, b, j) if inside else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in "aibj"), pa.array(found, pa.int64())], names=["a", "i", "b", "j", "common"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return (
        places.select(*(F.col(c).cast("long").alias(c) for c in "aibj"))
        .join(texts.select(F.col("doc_id").alias("a"), F.coalesce("text", F.lit(b"")).alias("x")), "a", "left")
        .join(texts.select(F.col("doc_id").alias("b"), F.coalesce("text", F.lit(b"")).alias("y")), "b", "left")
        .mapInArrow(run, "a long, i long, b long, j long, common long")
    )


SENT = "range int, extra int, late int, doc_id long, h long, n_rows long, packed binary"


def _sent(bounds: list[tuple[int, int, int]]):
    """Each document, compressed, with its range; the first of a range also as the last of the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            counts: dict[tuple[int, int, int], int] = {}
            texts = {}
            column = batch.column("text")
            for row, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("late", "doc_id", "h")), strict=True)):
                counts[key] = counts.get(key, 0) + 1
                texts.setdefault(key, row)
            out = []
            for key, n in counts.items():
                packed = pack(column[texts[key]].as_py())
                where = bisect_right(bounds, key) - 1
                out.append((where, 0, *key, n, packed))
                if key == bounds[where]:
                    out.append(((where - 1) % len(bounds), 1, *key, n, packed))
            names = [c.split()[0] for c in SENT.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


EDITED = (
    "late int, doc_id long, n_rows long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
EDITED_ROWS = 2_000


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of a sorted range against the one after it."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = [c.split()[0] for c in EDITED.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.string()] * 3, *[pa.float64()] * 2]

    def result(key: tuple, n: int, text: str, following: str) -> tuple:
        own, edited, marks = edited_marks(text, following)
        after = own if following == text else marks_of(following)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (key[0], key[1], n, own.n, sha, own.text(), marks.text(), own.likeness(marks), own.likeness(after))

    def documents() -> Iterator[tuple[int, int, tuple, int, bytes]]:
        for batch in batches:
            where, extra, late, ids, h, n = (batch.column(i).to_pylist() for i in range(6))
            for row, packed in enumerate(batch.column(6)):
                yield where[row], extra[row], (late[row], ids[row], h[row]), n[row], packed.as_py()

    out: list[tuple] = []
    at, key, n, text, closed = None, None, 0, "", True
    for where, extra, new, rows, packed in documents():
        if where != at:
            at, key, closed = where, None, False
        if closed:
            continue  # a further copy of the row that follows the range
        if not extra and new == key:
            n += rows
            continue
        following = unpack(packed).decode("utf-8", "replace")
        if key is not None:
            out.append(result(key, n, text, following))
        key, n, text, closed = new, rows, following, bool(extra)
        if len(out) >= EDITED_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)`` its fingerprint and that of its edited text, whose last quarter is
    replaced by as many code points of the next document's head, ascending ``doc_id`` (after the last one
    comes the first); and how alike its fingerprint is to the edited text's and to the next document's.
    """
    rows = docs.select(
        F.col("doc_id").isNull().cast("int").alias("late"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    keys = written(rows.groupBy("late", "doc_id", "h").agg(F.max(F.octet_length("text")).alias("size")))
    ranges = max(1, -(-(keys.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES))
    firsts = (
        keys.select("late", "doc_id", "h")
        .repartitionByRange(ranges, "late", "doc_id", "h")
        .select(F.spark_partition_id().alias("place"), F.struct("late", "doc_id", "h").alias("key"))
        .groupBy("place")
        .agg(F.min("key").alias("key"))
    )
    # One row per range, as in any sort by ranges.
    bounds = sorted(tuple(r["key"]) for r in firsts.collect())
    sent = rows.mapInArrow(_sent(bounds), SENT)
    order = ["range", "extra", "late", "doc_id", "h"]
    found = sent.repartition(max(1, len(bounds)), "range").sortWithinPartitions(*order).mapInArrow(_compared, EDITED)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).select(
        F.when(F.col("late") == 0, F.col("doc_id")).alias("doc_id"),
        *[c.split()[0] for c in EDITED.split(", ")[3:]],
    )
