"""Packing token ids into sequences: first-fit decreasing with a tournament tree of bin capacities.

Every document becomes its token ids and an end id. Whole sequences are cut off its front; what remains
is cut once more, into a multiple of ``grain`` and a rest below it, so that large pieces tile a sequence
and rests fill the gaps. Pieces are dealt into randomised groups of about ``GROUP`` documents by a hash
of the row, and each group is packed on its own: pieces in decreasing length, each into the first bin
with room, which the tree of capacities finds in logarithmic time. Bins never span groups, so the work
is parallel at any size; a group's unfilled last bins cost a fixed share.

Tokens come from the ``tokenizers`` library. A text is cut before every white-space run of ASCII that
follows another byte, and between an ASCII letter and any other ASCII character: the tokenizer's own pattern
always splits there and looks at nothing before, so each unit can be encoded once per Python worker, which keeps
its units from task to task, and looked up by its 64-bit hash afterwards. Texts with other kinds of white space,
or with a special token's string, are encoded whole.

Null and empty texts give the end id alone. Repeated rows and null ids are packed like any others.
Memory: one slice of texts (or one longer text), and the units kept by a worker: about ``CACHE`` of them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm.store import written
from oddlot.llm.tokens import _SPACE, Words, flat, slices

LENGTH = 1024
GRAIN = 128
GROUP = 4096
CACHE = 1_000_000
#: Units encoded as one text.
TOGETHER = 4096
END = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII that is neither a letter nor white space.
_SIGN = ~_LETTER & ~_SPACE
_SIGN[128:] = False


def units(data: np.ndarray, offsets: np.ndarray) -> Words:
    """White space and the run after it, cut after letters, as spans; every byte of a text lies in one."""
    space = _SPACE[data]
    begin = np.zeros(len(data), dtype=bool)
    begin[1:] = (space[1:] & ~space[:-1]) | (_SIGN[data[1:]] & _LETTER[data[:-1]])
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, offsets))


def _odd(data: np.ndarray) -> np.ndarray:
    """Places of white space that is not plain ASCII."""
    padded = np.append(data, np.zeros(2, dtype=np.uint8))
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    return np.flatnonzero(
        ((a >= 0x1C) & (a <= 0x1F))
        | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
        | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    )


class Encoder:
    """Token ids of slices of texts, with a cache of units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A byte-level token's name has one character for each of its bytes.
        self.bytes = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.bytes[number] = len(token)
        self._clear()

    def _clear(self) -> None:
        # Hashes of the units in ascending order, and their places in ``begin`` and ``size``.
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, codes: np.ndarray, raw: list[bytes], plain: np.ndarray) -> None:
        """Encode units. Plain ones are put one after another and encoded together: the pattern splits
        before each, and the lengths of the tokens in bytes tell where one ends. ``codes`` ascend and are new."""
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        n = int(plain.sum())
        joined = [raw[x] for x in order[:n]]
        texts = [b"".join(joined[x : x + TOGETHER]).decode() for x in range(0, n, TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        together = [np.array(e.ids, dtype=np.uint32) for e in encoded]
        alone = [
            np.array(e.ids, dtype=np.uint32)
            for e in self.tokenizer.encode_batch_fast([raw[x].decode() for x in order[n:]], add_special_tokens=False)
        ]
        flat_ids = np.concatenate([*together, np.zeros(0, np.uint32)])
        ends = np.searchsorted(np.cumsum(self.bytes[flat_ids]), np.cumsum([len(x) for x in joined]), "left") + 1
        sizes = np.concatenate((np.diff(ends, prepend=0), [len(x) for x in alone])).astype(np.int64)
        places = np.empty(len(order), dtype=np.int64)
        places[order] = np.arange(len(self.known), len(self.known) + len(order))
        at = np.searchsorted(self.known, codes)
        # All at once: a task that fails in between leaves the worker's units whole.
        self.known, self.place, self.begin, self.size, self.pool = (
            np.insert(self.known, at, codes),
            np.insert(self.place, at, places),
            np.append(self.begin, len(self.pool) + np.cumsum(sizes) - sizes),
            np.append(self.size, sizes),
            np.concatenate([self.pool, flat_ids, *alone]),
        )

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        spans = units(data, offsets)
        codes = spans.hashes()
        values, one, inverse = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._clear()
        odd, whole = _odd(data), data.tobytes()
        marked = any(mark in whole for mark in self.special)
        at = np.searchsorted(self.known, values)
        seen = at < len(self.known)
        seen[seen] = self.known[at[seen]] == values[seen]
        new = np.flatnonzero(~seen)
        if len(new):
            units_of = one[new]
            raw = [data[a:b].tobytes() for a, b in zip(spans.starts[units_of].tolist(), spans.ends[units_of].tolist())]
            plain = _SPACE[data[spans.starts[units_of]]] & ~_SPACE[data[spans.ends[units_of] - 1]]
            plain &= ~np.isin(units_of, np.searchsorted(spans.starts, odd, "right") - 1)
            if marked:
                plain &= np.array([not any(mark in x for mark in self.special) for x in raw])
            self._learn(values[new], raw, plain)
            at = np.searchsorted(self.known, values)
        rows = self.place[at][inverse]
        sizes = self.size[rows]
        before = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.pool[np.arange(before[-1]) + np.repeat(self.begin[rows] - before[:-1], sizes)]
        cut = before[spans.first]
        out = [ids[cut[d] : cut[d + 1]] for d in range(len(offsets) - 1)]
        odd = set((np.searchsorted(offsets, odd, "right") - 1).tolist())
        for d in range(len(out)):
            if not marked and d not in odd:
                continue
            text = whole[offsets[d] : offsets[d + 1]]
            if d in odd or any(mark in text for mark in self.special):
                out[d] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which keeps what it has learnt for later tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(tokens: int, length: int = LENGTH, grain: int = GRAIN) -> list[int]:
    """Where the pieces of a document of so many tokens begin, and its end."""
    whole = tokens - tokens % length
    places = list(range(0, whole, length))
    rest = tokens - whole
    if rest:
        places.append(whole)
        if rest > grain and rest % grain:
            places.append(whole + rest - rest % grain)
    return [*places, tokens]


def _pieces(path: str, length: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids = flat(batch.column("doc_id"))
            for i, j, data, offsets in slices(batch.column("text")):
                rows = []
                for d, found in enumerate(encoder.encode(data, offsets)):
                    whole = np.append(found, np.uint32(END)).astype("<u4")
                    view = memoryview(whole).cast("B")
                    places = cuts(len(whole), length, grain)
                    rows += [(i + d, a, b - a, zlib.crc32(view[4 * a : 4 * b]), len(whole)) for a, b in zip(places, places[1:])]
                columns = np.array(rows, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


class Capacities:
    """A tournament tree: each node holds the largest room among the bins below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; the bin and its room before."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        before, chosen = tree[node], node - self.leaves
        tree[node] -= size
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
        return chosen, before


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, in the given order of ties."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    tree = Capacities(len(sizes), length)
    for at in np.argsort(-sizes, kind="stable").tolist():
        bins[at], room = tree.place(int(sizes[at]))
        offsets[at] = length - room
    return bins, offsets


def _pack(length: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), length)
        number = group.column("part").to_numpy() << 32
        return group.drop_columns(["row", "part"]).append_column(
            "sequence_id", pa.array(2 * (number + bins) + 1)
        ).append_column("offset", pa.array(offsets))

    return pack


def pack_sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """One row per piece of every document of ``docs(doc_id, text, ...)``.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. ``path`` is a tokenizer file;
    without one, the public byte-level vocabulary of 50,257 ids.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(
        texts.mapInArrow(_pieces(path, length, grain), PIECES).withColumn("row", F.monotonically_increasing_id())
    )
    rest = pieces.filter(F.col("length") < length)
    parts = max(1, -(-rest.count() // (2 * GROUP)))
    packed = (
        rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(parts)))
        .groupBy("part")
        .applyInArrow(_pack(length), f"{PIECES}, sequence_id long, offset long")
    )
    full = pieces.filter(F.col("length") == length).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(packed)
