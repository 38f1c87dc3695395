"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct ``k``-word shingles as 64-bit hashes. Two sets of ``a`` and ``b``
shingles with similarity ``t`` or more differ in at most ``d = (a + b)(1 - t)/(1 + t)`` shingles.

* Every shingle flips one bit of a wide parity sketch. The sketch is cut into ``m = d + 1 + e`` blocks
  by the shingle's leading bits; a block of 2**32 bits is kept as the XOR of its odd positions' codes.
  Equal shingles cancel between two sketches, so at most ``d`` blocks differ and at least ``e + 1`` agree.
* Sizes fall into bands of ratio ``1/t``; a set joins the group of its own band and of the band below,
  which holds all smaller sets it can be linked with. Each group has its own ``d``.
* Blocks without a shingle say little, so only sets with more than ``e`` empty blocks send those too:
  where two sets agree on empty blocks alone, both have more than ``e`` of them. No pair is lost.
* Two folds of the sketch screen candidates, since their Hamming distance never exceeds the symmetric
  difference: one of 256 bits, and one with about as many bits as the set has shingles, which bites at every
  size. What is left is verified on the exact sets.

Links are needed for components, not one by one. Sets that share a block are first linked along a
chain in hashed order. A link that is still missing joins two components, and its sets agree on more than
``r`` blocks, all of which then hold several components. So a set with at most ``r`` such blocks is done, any
other is tried without its ``r`` commonest ones, and a very common passage does not bring its documents
together. The members of a block that is left are screened by sketch in tiles, which return members and no
pairs; those with a partner in another component are compared exactly in tiles of connected components, which return
only links that join what was apart. So components are exact.
Equal sets are linked through their smallest document, and only one of them sends its blocks. Block rows
are two numbers wide; a block that very many sets share is sorted as a stream that spills, nothing of it
is held in memory.

Rows of one ``doc_id`` count as one node. A null id stands alone with a null component. Null and empty
texts have no shingles and no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlot.llm import bitset
from oddlot.llm.graph import connected
from oddlot.llm.store import written
from oddlot.llm.tokens import all_shingles, find_words, flat, int64s, lists, mix, number_mix, slices

#: Shingles in a slice of a block whose members are compared with one another.
TILE = 1_000_000
SKETCH_WORDS = ["s0", "s1", "s2", "s3"]
FACTS = "doc_id long, n long, hi long, lo long, s0 long, s1 long, s2 long, s3 long, sketch binary"
KEYS = "key long, doc_id long, hi long, maybe boolean"
#: Members of a block that a tile screens by sketch.
MEMBERS = 2_000
#: Shingles above which a set has a sketch of its own width.
NARROW = 256


@lru_cache(maxsize=None)
def _band_start(band: int, percent: int) -> int:
    return 1 if band == 0 else _band_start(band - 1, percent) * 100 // percent + 1


@lru_cache(maxsize=None)
def _layout(band: int, percent: int) -> tuple[int, int, int]:
    """Blocks of the band's group, how many may be empty before these are sent too, and ``r``.

    Linked sets agree on ``empty + r + 1`` blocks at least, hence on more than ``r`` of those that are sent.
    """
    start, most = _band_start(band, percent), _band_start(band + 1, percent) - 1
    apart = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
    more = min(4, apart // 8)
    blocks = apart + 1 + more
    empty = blocks * np.exp(-start / blocks) if more else 0.015 * apart
    spare = int(np.ceil(empty + 1.5 * np.sqrt(empty)))
    return blocks + spare, spare, more


def _band(n: int, percent: int) -> int:
    band = 0
    while _band_start(band + 1, percent) <= n:
        band += 1
    return band


def block_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the blocks of a sorted set of shingle hashes; two sets that may be linked share more than ``r``.

    The last bit of a key tells the two groups of a set apart, the three before it hold the group's ``r``.
    """
    band = _band(len(shingles), percent)
    codes = mix(shingles & np.uint64(0xFFFFFFFF))
    out = []
    for group in range(max(0, band - 1), band + 1):
        blocks, spare, more = _layout(group, percent)
        block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        begins = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        prints = np.bitwise_xor.reduceat(codes, begins)
        where = block[begins]
        if blocks - len(begins) > spare:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), where)
            where = np.concatenate((where, empty))
            prints = np.concatenate((prints, np.zeros(len(empty), dtype=np.uint64)))
        keys = mix(prints + mix(where + number_mix(group + 1)))
        out.append((keys & ~np.uint64(15)) | np.uint64(more << 1 | group & 1))
    return np.concatenate(out)


def _sketch(found: np.ndarray, bits: int) -> bytes:
    """The parity sketch of that many bits, a power of two; halves of it folded onto each other give the next narrower."""
    return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _width(n: int) -> int:
    return 1 << (int(n) - 1).bit_length()


def _facts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = number_mix(7)
        for batch in batches:
            ids = flat(batch.column("doc_id"))
            for i, j, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                values, begin = all_shingles(words.hashes(lower=True), words.first, k)
                numbers = np.zeros((7, j - i), dtype=np.uint64)
                wide = []
                for d in range(j - i):
                    found = np.unique(values[begin[d] : begin[d + 1]])
                    numbers[0, d] = len(found)
                    wide.append(_sketch(found, _width(len(found))) if len(found) > NARROW else None)
                    if len(found):
                        numbers[1, d] = mix(found).sum()
                        numbers[2, d] = mix(found ^ salt).sum()
                        numbers[3:7, d] = np.frombuffer(_sketch(found, NARROW), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], *(int64s(row) for row in numbers), pa.array(wide, pa.binary())],
                    names=["doc_id", "n", "hi", "lo", *SKETCH_WORDS, "sketch"],
                )

    return run


def _keys(k: int, percent: int, bits):
    """A row for each key of a set, with the set's first sum and whether the document may be listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = flat(batch.column("doc_id"))
            maybe = bitset.listed(bits.value, flat(batch.column("slot")).to_numpy())
            for i, j, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                values, begin = all_shingles(words.hashes(lower=True), words.first, k)
                parts = [np.unique(values[begin[d] : begin[d + 1]]) for d in range(j - i)]
                keys = [block_keys(p, percent) if len(p) else p for p in parts]
                sums = np.array([mix(p).sum() for p in parts], dtype=np.uint64)
                owner = np.repeat(np.arange(j - i), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays(
                    [int64s(np.concatenate(keys)), ids.take(pa.array(owner + i)), int64s(sums[owner]), pa.array(maybe[owner + i])],
                    names=["key", "doc_id", "hi", "maybe"],
                )

    return run


def _block_rows(sets: DataFrame, heads: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``(key, doc_id)`` of one sender per set, the smallest document that has it.

    A bit set tells the scan which documents send for certain; only rows of the others are looked up.
    """
    extra = written(sets.join(heads, ["n", "hi", "lo"]).filter("doc_id != head").select("doc_id", "hi").distinct())
    bits = bitset.build(extra, bitset.slot(F.col("doc_id")))
    rows = texts.filter("doc_id is not null").withColumn("slot", bitset.slot(F.col("doc_id"))).mapInArrow(_keys(k, percent, bits), KEYS)
    sure = rows.filter("not maybe").select("key", "doc_id")
    return sure.unionByName(rows.filter("maybe").join(extra, ["doc_id", "hi"], "left_anti").select("key", "doc_id"))


def _sets(k: int, bits):
    """The sets of the documents whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = pa.array(bitset.listed(bits.value, flat(batch.column("slot")).to_numpy()))
            ids, texts = flat(batch.column("doc_id")).filter(wanted), flat(batch.column("text")).filter(wanted)
            for i, j, data, offsets in slices(texts):
                words = find_words(data, offsets)
                values, begin = all_shingles(words.hashes(lower=True), words.first, k)
                parts = [np.unique(values[begin[d] : begin[d + 1]]) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([ids[i:j], lists(parts)], names=["doc_id", "items"])

    return run


def _sets_of(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``(doc_id, items)`` for at least the documents in ``ids(doc_id)``, without a shuffle of texts."""
    bits = bitset.build(ids, bitset.slot(F.col("doc_id")))
    found = texts.filter("doc_id is not null").withColumn("slot", bitset.slot(F.col("doc_id")))
    sets = written(found.mapInArrow(_sets(k, bits), "doc_id long, items array<long>"))
    bits.unpersist()
    return sets


def _far(a: bytes | None, b: bytes | None, total: int, percent: int) -> bool:
    """Whether the wide sketches of two sets of ``total`` shingles rule a link out."""
    if a is None or b is None:
        return False
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) > total * (100 - percent)


def _near_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("x", "y", "total"))
            near = [not _far(x, y, total, percent) for x, y, total in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _linked(pairs: DataFrame, facts: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose exact sets reach the similarity."""
    side = facts.select("doc_id", "n", "hi", "lo", *SKETCH_WORDS)
    left = side.select(*(F.col(c).alias(f"a_{c}") for c in side.columns))
    right = side.select(*(F.col(c).alias(f"b_{c}") for c in side.columns))
    small = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    apart = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH_WORDS)
    near = apart * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)
    # Equal sets are linked already.
    differ = ~(F.struct("a_n", "a_hi", "a_lo") == F.struct("b_n", "b_hi", "b_lo"))
    screened = written(
        pairs.join(left, F.col("a") == F.col("a_doc_id"))
        .join(right, F.col("b") == F.col("b_doc_id"))
        .filter(small & near & differ)
        .select("a", "b", (F.col("a_n") + F.col("b_n")).alias("total"))
        .distinct()
    )
    wide = facts.select("doc_id", "sketch")
    screened = written(
        screened.join(wide.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a")
        .join(wide.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")
        .mapInArrow(_near_pairs(percent), "a long, b long")
        .distinct()
    )
    ends = screened.select(F.col("a").alias("doc_id")).union(screened.select("b")).distinct()
    sets = _sets_of(ends, texts, k)
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    return written(
        screened.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        .filter((union > 0) & (both * 100 >= union * percent))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components after adding links ``(u, v)`` to those of ``known(node, component)``."""
    label = known.withColumnRenamed("component", "label")
    ends = links.join(label.select(F.col("node").alias("u"), F.col("label").alias("x")), "u", "left").join(
        label.select(F.col("node").alias("v"), F.col("label").alias("y")), "v", "left"
    )
    ends = written(ends.select("u", "v", F.coalesce("x", "u").alias("x"), F.coalesce("y", "v").alias("y")))
    joined = connected(ends.select(F.col("x").alias("u"), F.col("y").alias("v")))
    new = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct().join(known, "node", "left_anti")
    every = known.unionByName(new.withColumn("component", F.col("node")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return written(every.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def _open_blocks(shared: DataFrame, known: DataFrame, several: DataFrame) -> DataFrame:
    """``(key, doc_id, component)`` of the blocks in which a missing link can still show.

    ``several`` are the ids that stand for different sets; their blocks all stay.
    """
    marked = shared.join(known, shared.doc_id == known.node, "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )

    def mixed(rows: DataFrame) -> DataFrame:
        facts = rows.groupBy("key").agg(
            F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"),
            F.bit_xor(F.xxhash64("doc_id")).alias("h"), F.sum(F.xxhash64("doc_id", F.lit(5)).bitwiseAND(F.lit((1 << 40) - 1))).alias("g"),
        )
        return written(facts.filter("x < y").drop("x", "y"))

    # A document has a bounded number of blocks for its size.
    order = Window.partitionBy("doc_id", F.col("key").bitwiseAND(F.lit(1))).orderBy(F.desc("members"), F.desc("key"))
    more = F.shiftright("key", 1).bitwiseAND(F.lit(7))
    rows = marked.join(mixed(marked).select("key", "members"), "key").join(several.withColumn("__several", F.lit(True)), "doc_id", "left")
    kept = rows.withColumn("place", F.row_number().over(order)).filter((F.col("place") > more) | F.col("__several"))
    kept = written(kept.select("key", "doc_id", "component"))
    # Near copies agree on many blocks; one block stands for all with the same members.
    heads = mixed(kept).groupBy("members", "h", "g").agg(F.min("key").alias("key"))
    return kept.join(heads.select("key"), "key", "left_semi")


def _tiles(rows: DataFrame, size: F.Column, limit: int, salt: int) -> DataFrame:
    """Rows of each ``key`` dealt into slices of about ``limit``, and each pair of slices as one tile.

    Tiles are dealt to tasks by all their keys, so a large group spreads.
    """
    parts = rows.groupBy("key").agg(F.ceil(F.sum(size) / limit).alias("parts"))
    return (
        rows.join(parts, "key")
        .withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        .drop("parts", "other")
        .repartition("key", "low", "high")
    )


def _screened(percent: int):
    """Members of a tile whose sketches allow a link with a member of another component, with that component.

    Each such member occurs, and the components that are allowed to link are connected by the rows.
    """

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("n")
        doc, n, part, own = (tile.column(c).to_numpy() for c in ("doc_id", "n", "component", "own"))
        narrow = np.stack([tile.column(c).to_numpy().view(np.uint64) for c in SKETCH_WORDS], axis=1)
        wide = tile.column("sketch").to_pylist()
        twice = tile.column("low")[0].as_py() != tile.column("high")[0].as_py()
        most = np.searchsorted(n, n * 100 // percent, "right")
        joined = {p: p for p in part.tolist()}

        def root(x: int) -> int:
            while joined[x] != x:
                joined[x] = joined[joined[x]]
                x = joined[x]
            return x

        found = np.zeros(len(n), dtype=bool)
        rows: list[tuple[int, int, int]] = []
        for a in range(len(n) - 1):
            other = slice(a + 1, most[a])
            near = part[other] != part[a]
            if twice:
                near &= own[other] != own[a]
            if not near.any():
                continue
            apart = np.bitwise_count(narrow[other] ^ narrow[a]).sum(axis=1, dtype=np.int64)
            near &= apart * (100 + percent) <= (n[other] + n[a]) * (100 - percent)
            for b in (np.flatnonzero(near) + a + 1).tolist():
                x, y = root(int(part[a])), root(int(part[b]))
                if (found[a] and found[b] and x == y) or _far(wide[a], wide[b], int(n[a] + n[b]), percent):
                    continue
                joined[max(x, y)] = min(x, y)
                rows += [(int(doc[i]), int(part[i]), int(part[j])) for i, j in ((a, b), (b, a)) if not found[i] or x != y]
                found[a] = found[b] = True
        columns = zip(*rows, strict=True) if rows else [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "component", "other"), columns, strict=True)})

    return run


def _forest(links: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The links that join what was apart before."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _compare(percent: int):
    """A forest of the links between different components within a tile: one slice of a group, or two."""

    def run(tile: pa.Table) -> pa.Table:
        items = flat(tile.column("items"))
        tile = tile.take(pa.array(np.argsort(np.diff(items.offsets.to_numpy()), kind="stable")))
        doc, part, own = (tile.column(c).to_numpy() for c in ("doc_id", "component", "own"))
        items = flat(tile.column("items"))
        begin = items.offsets.to_numpy()
        names, places = np.unique(items.values.to_numpy()[begin[0] : begin[-1]], return_inverse=True)
        begin = begin - begin[0]
        sizes = np.diff(begin)
        twice = tile.column("low")[0].as_py() != tile.column("high")[0].as_py()
        values, counts = np.unique(part, return_counts=True)
        mine = np.zeros(len(names), dtype=np.int32)
        # Sets that can be linked with one another have similar sizes and so stand close together.
        least = np.searchsorted(sizes, -(-sizes * percent // 100), "left")
        most = np.searchsorted(sizes, sizes * 100 // percent, "right")
        found: list[tuple[int, int]] = []
        # Links of the commonest component are found from their other ends.
        for a in np.flatnonzero(part != values[counts.argmax()]):
            lo, hi = least[a], most[a]
            other = part[lo:hi] != part[a]
            if twice:
                other &= own[lo:hi] != own[a]
            if not other.any():
                continue
            mine[places[begin[a] : begin[a + 1]]] = 1
            both = np.add.reduceat(mine[places[begin[lo] : begin[hi]]], begin[lo:hi] - begin[lo])
            mine[places[begin[a] : begin[a + 1]]] = 0
            linked = other & (both * 100 >= (sizes[lo:hi] + sizes[a] - both) * percent)
            found += [(a, lo + b) for b in np.flatnonzero(linked)]
        ends = np.array([(doc[a], doc[b]) for a, b in _forest(found, len(doc))], dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(ends[:, 0].copy()), "v": pa.array(ends[:, 1].copy())})

    return run


def _tiled_links(members: DataFrame, facts: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that connect the components within the blocks of ``members(key, doc_id, component)``.

    Members that their sketches keep apart from all other components go first. The rest are compared by groups
    of components that sketches allow to link, each set in one group. A tile emits a forest, fewer rows than it
    has members.
    """
    side = facts.select("doc_id", "n", *SKETCH_WORDS, "sketch").distinct()
    near = _tiles(members.join(side, "doc_id"), F.lit(1), MEMBERS, 19).groupBy("key", "low", "high")
    near = written(near.applyInArrow(_screened(percent), "doc_id long, component long, other long").distinct())
    groups = connected(near.select(F.col("component").alias("u"), F.col("other").alias("v")))
    left = written(
        near.select("doc_id", "component").distinct()
        .join(groups.select(F.col("node").alias("component"), F.col("component").alias("key")), "component")
        .select("key", "doc_id", "component")
    )
    sets = _sets_of(left.select("doc_id"), texts, k).filter("size(items) > 0")
    sized = written(left.join(sets, "doc_id"))
    dealt = _tiles(sized, F.size("items"), TILE, 23)
    return written(dealt.groupBy("key", "low", "high").applyInArrow(_compare(percent), "u long, v long").distinct())


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest ``doc_id`` reachable through pairs whose shingle sets have a
    Jaccard similarity of ``percent``/100 or more. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = written(texts.mapInArrow(_facts(k), FACTS))
    sets = facts.filter("doc_id is not null and n > 0")
    heads = written(sets.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"))
    copies = sets.join(heads, ["n", "hi", "lo"]).filter("doc_id != head").select(
        F.col("doc_id").alias("u"), F.col("head").alias("v")
    )

    rows = _block_rows(sets, heads, texts, k, percent)
    order = Window.partitionBy("key").orderBy(F.xxhash64("doc_id"), "doc_id")
    shared = written(
        rows.select("key", "doc_id", F.lead("doc_id").over(order).alias("after"), F.lag("doc_id").over(order).alias("before"))
        .filter("after is not null or before is not null")
        .select("key", "doc_id", "after")
    )
    chain = (
        shared.filter("after != doc_id")
        .select(F.least("doc_id", "after").alias("a"), F.greatest("doc_id", "after").alias("b"))
        .distinct()
    )
    known = connected(_linked(chain, facts, texts, k, percent).unionByName(copies))
    several = sets.groupBy("doc_id").agg(F.min("hi").alias("x"), F.max("hi").alias("y")).filter("x != y").select("doc_id")
    known = _merged(known, _tiled_links(_open_blocks(shared, known, several), facts, texts, k, percent))
    return (
        facts.select("doc_id", F.col("n").alias("n_shingles"))
        .join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component; rows without an id all stay.

    Of repeated rows with one ``doc_id`` all or none stay.
    """
    found = jaccard_components(docs, k, percent)
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
