"""Spelling variants by a trie over letter counts.

Two words that differ by one inserted, deleted or replaced code point have counts of letter groups that
differ by at most one surplus and one deficit. Words are arranged in a trie by the counts of ``GROUPS`` in
turn; a search goes down from the root and may once take a branch whose count is one higher (surplus) and
once one that is one lower (deficit). Words at the leaves that it reaches are compared exactly.

* ``word_counts`` counts words over whole texts, on UTF-8 bytes with numpy, added up in tasks before the
  shuffle.
* The upper part of the trie is walked by Spark, ``BLOCK`` levels a round: each search is a row with its path
  and what it has spent, joined with the nodes that exist. A node of at most ``NODE`` words is searched in
  one task; a larger one goes on to the next round. A node that is still larger at the last level is dealt
  into slices, and so are the searches of a node, so that a task holds a bounded number of each.
* In a task the rest of the trie is the sorted order of the words' counts; searches go down together.

Each pair is found once: the first difference must be the surplus, so the search starts at the shorter word
or, for a replacement, at one of the two; words with equal counts meet in their leaf. Tasks return a count
and the best neighbour per word, no pairs.

Null texts hold no words; null ids count as empty text in the damage rule. Repeated rows count as often as
they occur. Words are told apart by 64-bit hashes while a task counts them, and by themselves afterwards.
Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm.store import written
from oddlot.llm.tokens import Words, slices

#: Letter groups in the order of the trie's levels; all other letters form the last group.
GROUPS = ("e", "a", "i", "n", "r", "o", "t", "s", "l", "c", "u", "d", "m", "p", "g", "bh", "fvw", "jky", "qxz")
LEVELS = len(GROUPS) + 1
BLOCK = 4
#: Words of a node, and searches, in one task.
NODE = 20_000
SEARCHES = 200_000
#: Pairs that are compared by their counts at once instead of going further down.
CELLS = 4096
#: Letters of a word that is compared in a matrix; longer words are compared one by one.
WIDTH = 63
#: Distinct words that a task counts before it passes them on.
WORDS_HELD = 200_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_GROUP_OF = np.full(256, len(GROUPS), dtype=np.int64)
for _place, _letters in enumerate(GROUPS):
    _GROUP_OF[[ord(c) for c in _letters]] = _place


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each span, carried on from those of ``before``."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    out = before[order] ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-sizes, -64, "left"))  # these are fewer than one in 64 bytes
    for i in range(long):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    at = 0
    active = len(sizes)
    while True:
        active = int(np.searchsorted(-sizes[:active], -at, "left"))
        if active <= long:
            break
        part = out[long:active]
        out[long:active] = _CRC[(part ^ data[starts[long:active] + at]) & np.uint32(255)] ^ (part >> np.uint32(8))
        at += 1
    result = np.empty_like(out)
    result[order] = out ^ np.uint32(0xFFFFFFFF)
    return result


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, code points and texts of the maximal runs of letters; data are lower-cased UTF-8 bytes."""
    # U+00C0 to U+00FF are the byte C3 and one more.
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        start[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    return starts, ends, ends - starts - (leads[ends] - leads[starts]), np.searchsorted(offsets, starts, "right") - 1


def _counted(least: int, divisor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        whole: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            words = [w for w, _ in held.values()] + [w.encode() for w in whole]
            counts = [n for _, n in held.values()] + list(whole.values())
            held.clear()
            whole.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, offsets in slices(batch.column("text")):
                data = _LOWER[data]
                starts, ends, points, text = _runs(data, offsets)
                kept = points >= least
                starts, ends, points, text = starts[kept], ends[kept], points[kept], text[kept]
                heads = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids[i:j]]
                crc = _crcs(data, starts, ends, np.array(heads, dtype=np.uint32)[text])
                hashes = Words(data, starts, ends, offsets).hashes()
                damaged = crc % np.uint32(divisor) == 0
                for at in np.flatnonzero(damaged & (points > least)):
                    word = data[starts[at] : ends[at]].tobytes().decode()
                    drop = int(crc[at]) % len(word)
                    word = word[:drop] + word[drop + 1 :]
                    whole[word] = whole.get(word, 0) + 1
                sound = np.flatnonzero(~damaged)
                names, first, counts = np.unique(hashes[sound], return_index=True, return_counts=True)
                for name, at, n in zip(names.tolist(), sound[first].tolist(), counts.tolist(), strict=True):
                    entry = held.get(name)
                    if entry is None:
                        held[name] = [data[starts[at] : ends[at]].tobytes(), n]
                    else:
                        entry[1] += n
                if len(held) + len(whole) > WORDS_HELD:
                    yield flush()
        if held or whole:
            yield flush()

    return run


def word_counts(docs: DataFrame, least: int = 5, times: int = 3, divisor: int = 97) -> DataFrame:
    """``word, n`` of the words with at least ``least`` code points and ``times`` occurrences.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. Where ``divisor`` divides the crc32
    ``h`` of ``<doc_id>:<word>``, the occurrence loses its code point number ``h % length`` first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_counted(least, divisor), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _letter_counts() -> F.Column:
    """The word's counts by group, as the trie's levels have them."""
    word = F.col("word")
    counts = [F.length(word) - F.length(F.translate(word, letters, "")) for letters in GROUPS]
    return F.array(*counts, F.length(F.translate(word, "".join(GROUPS), "")))


def _moves() -> list[F.Column]:
    """What a search may do within a block of levels: with nothing spent, with the surplus spent, with both."""
    none = [0] * BLOCK

    def change(up: int | None, down: int | None) -> list[int]:
        out = list(none)
        if up is not None:
            out[up] += 1
        if down is not None:
            out[down] -= 1
        return out

    def options(listed: list[tuple[list[int], bool, bool]]) -> F.Column:
        return F.array(*[
            F.struct(F.array(*[F.lit(x) for x in by]).alias("by"), F.lit(up).alias("up"), F.lit(down).alias("down"))
            for by, up, down in listed
        ])

    places = range(BLOCK)
    fresh = [(none, False, False)] + [(change(i, None), True, False) for i in places]
    fresh += [(change(i, j), True, True) for i in places for j in places if i < j]
    spent = [(none, True, False)] + [(change(None, j), True, True) for j in places]
    return [options(fresh), options(spent), options([(none, True, True)])]


def _tiles(words: DataFrame) -> DataFrame:
    """Words and the searches that reach them, by node and slices: ``node, own, other, depth, home, word, n, up, down``."""
    fresh, spent, done = _moves()
    homes = words.withColumn("path", F.array().cast("array<int>"))
    searches = homes.withColumns({"up": F.lit(False), "down": F.lit(False)})
    parts = []
    for depth in range(BLOCK, LEVELS + 1, BLOCK):
        block = F.slice("v", depth - BLOCK + 1, BLOCK)
        homes = homes.withColumn("path", F.concat("path", block))
        searches = (
            searches.withColumn("move", F.explode(F.when(F.col("down"), done).when(F.col("up"), spent).otherwise(fresh)))
            .withColumn("step", F.zip_with(block, "move.by", lambda x, y: x + y))
            .filter(F.array_min("step") >= 0)
            .select("word", "n", "v", F.concat("path", "step").alias("path"), F.col("move.up").alias("up"), F.col("move.down").alias("down"))
        )
        sizes = homes.groupBy("path").agg(F.count("*").alias("size"))
        searches = written(searches.join(sizes, "path"))
        last = depth + BLOCK > LEVELS
        closed = F.lit(True) if last else F.col("size") <= NODE
        reached = searches.filter(closed).groupBy("path").agg(F.count("*").alias("searches"), F.max("size").alias("size"))
        nodes = written(
            reached.select(
                "path",
                F.ceil(F.col("size") / NODE).alias("own_slices"),
                F.ceil(F.col("searches") / SEARCHES).alias("other_slices"),
            )
        )
        node = F.concat_ws(",", "path").alias("node")
        parts.append(
            homes.join(nodes, "path").select(
                node,
                F.pmod(F.xxhash64("word", F.lit(31)), F.col("own_slices")).alias("own"),
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_slices") - 1)).alias("other"),
                F.lit(depth).alias("depth"), F.lit(True).alias("home"), "word", "n", F.lit(False).alias("up"), F.lit(False).alias("down"),
            )
        )
        parts.append(
            searches.filter(closed).join(nodes, "path").select(
                node,
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_slices") - 1)).alias("own"),
                F.pmod(F.xxhash64("word", F.lit(37)), F.col("other_slices")).alias("other"),
                F.lit(depth).alias("depth"), F.lit(False).alias("home"), "word", "n", "up", "down",
            )
        )
        if last:
            break
        searches = searches.filter(~closed).drop("size")
        if searches.isEmpty():
            break
        homes = written(homes.join(searches.select("path").distinct(), "path", "left_semi"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


class _Verifier:
    """Exact comparison of many pairs of words, given as Latin-1 bytes."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.sizes = np.array([len(w) for w in words])
        self.letters = np.zeros((len(words), WIDTH + 1), dtype=np.uint8)
        cut = [w[:WIDTH].encode("latin-1") for w in words]
        sizes = np.minimum(self.sizes, WIDTH)
        flat = np.frombuffer(b"".join(cut), dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        row = np.repeat(np.arange(len(words)), sizes)
        self.letters[row, np.arange(len(flat)) - first[row]] = flat

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart; ``b`` is as long as ``a``, or longer."""
        out = np.zeros(len(a), dtype=bool)
        more = self.sizes[b] - self.sizes[a]
        long = np.flatnonzero((self.sizes[b] > WIDTH) & (more >= 0) & (more <= 1))
        out[long] = [one_edit(self.words[x], self.words[y]) for x, y in zip(a[long], b[long], strict=True)]
        short = self.sizes[b] <= WIDTH
        same = np.flatnonzero(short & (more == 0))
        out[same] = (self.letters[a[same]] != self.letters[b[same]]).sum(axis=1) == 1
        longer = np.flatnonzero(short & (more == 1))
        x, y = self.letters[a[longer]], self.letters[b[longer]]
        agree = (x != y).argmax(axis=1)
        after = np.arange(WIDTH)[None, :] >= agree[:, None]
        out[longer] = ~((x[:, :-1] != y[:, 1:]) & after).any(axis=1)
        return out


def _vectors(words: list[str]) -> np.ndarray:
    flat = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * LEVELS + _GROUP_OF[flat], minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def _candidates(homes: np.ndarray, searches: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a search and a home whose counts from level ``depth`` on lie within what the search may still spend.

    ``homes`` are in the order of their counts, so a trie node is a range of them.
    """

    def small(low: int, high: int, at: np.ndarray, u: np.ndarray, w: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        by = homes[None, low:high, level:] - searches[at][:, None, level:]
        plus, minus = np.maximum(by, 0), np.minimum(by, 0)
        above, below = plus.sum(axis=2), -minus.sum(axis=2)
        fits = (above + u[:, None] <= 1) & (below + w[:, None] <= 1)
        # With nothing spent so far the surplus has to come first.
        if by.shape[2]:
            first = u[:, None] | (below == 0) | ((above == 1) & (plus.argmax(axis=2) < minus.argmin(axis=2)))
            fits &= first
        i, j = np.nonzero(fits)
        return at[i], j + low

    def walk(low: int, high: int, at: np.ndarray, u: np.ndarray, w: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(at):
            return
        if level == LEVELS or len(at) * (high - low) <= CELLS:
            step = max(1, CELLS // (high - low))
            for i in range(0, len(at), step):
                yield small(low, high, at[i : i + step], u[i : i + step], w[i : i + step], level)
            return
        counts, begins = np.unique(homes[low:high, level], return_index=True)
        ends = np.append(begins[1:], high - low)
        own = searches[at, level]
        for count, begin, end in zip(counts, begins, ends, strict=True):
            same, surplus, deficit = own == count, (own + 1 == count) & ~u, (own - 1 == count) & u & ~w
            go = same | surplus | deficit
            yield from walk(low + begin, low + end, at[go], (u | surplus)[go], (w | deficit)[go], level + 1)

    yield from walk(0, len(homes), np.arange(len(searches)), up, down, depth)


NEAR = "word string, n_near long, best_n long, best string"


def _searched(tile: pa.Table) -> pa.Table:
    """For each word of the tile with a neighbour there: their number and the commonest one."""
    home = tile.column("home").to_numpy()
    names, places = np.unique(np.array(tile.column("word").to_pylist(), dtype=object), return_inverse=True)
    words = names.tolist()
    numbers = np.zeros(len(words), dtype=np.int64)
    numbers[places] = tile.column("n").to_numpy()
    vectors, check = _vectors(words), _Verifier(words)
    depth = tile.column("depth")[0].as_py()
    own = np.unique(places[home])
    own = own[np.lexsort(vectors[own, depth:].T[::-1])] if depth < LEVELS else own
    looking = places[~home]
    up, down = (tile.column(c).to_numpy()[~home] for c in ("up", "down"))
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i, j in _candidates(vectors[own], vectors[looking], up, down, depth) if len(own) else ():
        a, b = looking[i], own[j]
        # Words with equal counts find one another from both sides.
        once = up[i] | (vectors[a] != vectors[b]).any(axis=1) | (a < b)
        a, b = a[once], b[once]
        good = check.near(a, b)
        left.append(a[good])
        right.append(b[good])
    a, b = np.concatenate(left + right), np.concatenate(right + left)
    order = np.lexsort((b, -numbers[b], a))
    a, b = a[order], b[order]
    word, first, count = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    return pa.table(
        {
            "word": pa.array([words[x] for x in word], pa.string()),
            "n_near": pa.array(count, pa.int64()),
            "best_n": pa.array(numbers[best], pa.int64()),
            "best": pa.array([words[x] for x in best], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of the words of ``words(word, n)`` that have another one edit away; words are
    distinct and of letters up to U+00FF. ``best`` is the commonest of these, among equals the first."""
    placed = written(words.select("word", "n", _letter_counts().alias("v")))
    found = _tiles(placed).groupBy("node", "own", "other").applyInArrow(_searched, NEAR)
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b"))
        .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))
    )


def _rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` by following ``forms(word, form)`` to the end; each round doubles the steps taken.

    A form occurs at least twice as often as its word, so chains end and are short.
    """
    current = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        if moved.filter("on").isEmpty():
            return moved.select("word", "root")
        current = moved.select("word", "root")


def spelling_forms(docs: DataFrame, least: int = 5, times: int = 3, divisor: int = 97, share: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of ``docs(doc_id, text, ...)``.

    ``form`` is the commonest word one edit away (among equals the first in code-point order) if it occurs at
    least ``share`` times as often, else null; ``root`` ends the chain of forms.
    """
    words = written(word_counts(docs, least, times, divisor))
    near = near_words(words)
    known = F.col("best_n") >= share * F.col("n")
    formed = written(
        words.join(near, "word", "left").select(
            "word", "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(known, F.col("best")).alias("form"),
            F.when(known, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _rooted(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
