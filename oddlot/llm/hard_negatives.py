"""Hard negatives by spanning trees of anchors.

The score of a candidate ``x`` against an anchor is their integer inner product. For a child anchor ``c`` with
parent ``p`` it lies within ``score(p, x) +- |c - p| * |x|``. Anchors of one label that lie close together share
a block, whose minimum spanning trees (one per label) are walked from their roots: a root scores all candidates,
a child takes its parent's bounds widened by the edge and rescores only candidates whose bounds reach a window
that is still open; a rescored candidate has exact bounds again.

* First walk: the window of an anchor opens at its fifth best score of its own label so far.
* Second walk: each positive opens a window from 80 % of its score up to its score, for other labels, whose
  lower end rises to the fifth best found in it.

Candidates are packed into stripes of rows, anchors into blocks, and each block meets each group of stripes in
one stream within a task, which holds one stripe and one block. Tasks return five rows per window at most, and a
ranking per anchor merges them. The anchors are the stated query set; no pairs are emitted.

Components ``x`` become ``floor(256 * x)``. Rows without an id, label or vector, with null or non-finite
components or with none at all take no part. Of rows that share an id, the one that is least by label and vector
counts. Vectors of different lengths never meet. Scores are exact while they stay below 2**53 within a block and
stripe; beyond that they are worked out one by one with whole numbers of any size, without bounds, and held
at the limits of 64 bits in the result. Zero vectors are ordinary. Empty tables give empty results; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlot.llm.store import written

STRIPE = 8192
BLOCK = 512
STRIPES_A_TASK = 16
EXACT = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1

ROWS = "size int, vec_id long, label long, vector array<double>"
STRIPES = "size int, stripe long, ids binary, labels binary, data binary"
BLOCKS = "size int, block long, ids binary, labels binary, data binary, parents binary, edges binary"
FOUND = "block long, anchor_id long, window int, other_id long, score long"


def spanning_trees(labels: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the anchors in which parents come first, each one's parent (itself for a root) and edge length.

    Every label has its minimum spanning tree, grown from the anchor nearest to the label's mean.
    """
    order, parents, edges = [], np.arange(len(labels)), np.zeros(len(labels))
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        x = vectors[own]
        root = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        best = np.sqrt(((x - x[root]) ** 2).sum(axis=1))
        link = np.full(len(own), root)
        out = np.zeros(len(own), dtype=bool)
        out[root] = True
        order.append(own[root])
        for _ in range(len(own) - 1):
            near = int(np.where(out, np.inf, best).argmin())
            out[near] = True
            order.append(own[near])
            parents[own[near]], edges[own[near]] = own[link[near]], best[near]
            reach = np.sqrt(((x - x[near]) ** 2).sum(axis=1))
            closer = reach < best
            best[closer], link[closer] = reach[closer], near
    return np.array(order, dtype=np.int64), parents, edges


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed_stripe(rows: pa.Table) -> pa.Table:
    size = rows.column("size")[0].as_py()
    vectors = rows.column("vector").combine_chunks()
    order = np.lexsort((rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()))
    return pa.table(
        {
            "size": pa.array([size], pa.int32()),
            "stripe": rows.column("stripe").slice(0, 1),
            "ids": pa.array([rows.column("vec_id").to_numpy()[order].tobytes()]),
            "labels": pa.array([rows.column("label").to_numpy()[order].tobytes()]),
            "data": pa.array([_matrix(vectors, size)[order].tobytes()]),
        }
    )


def _packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive anchors of one vector length, with their spanning trees."""
    held: list[tuple[int, int, int, list[float]]] = []

    def flush() -> pa.RecordBatch:
        size = held[0][0]
        ids, labels = (np.array([r[i] for r in held], dtype=np.int64) for i in (1, 2))
        vectors = np.array([r[3] for r in held])
        order, parents, edges = spanning_trees(labels, vectors)
        place = np.argsort(order)
        values = [ids[order], labels[order], vectors[order], place[parents[order]].astype(np.int64), edges[order]]
        held.clear()
        # The least id names the block: ids occur once.
        return pa.RecordBatch.from_arrays(
            [pa.array([size], pa.int32()), pa.array([int(ids.min())], pa.int64()), *(pa.array([v.tobytes()]) for v in values)],
            names=[c.split()[0] for c in BLOCKS.split(", ")],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("size", "vec_id", "label", "vector")), strict=True):
            if held and (held[0][0] != row[0] or len(held) == BLOCK):
                yield flush()
            held.append(row)
    if held:
        yield flush()


@dataclass
class _Best:
    """The best rows of a window so far: at most ``top``, higher scores first, ties by smaller id."""

    low: float
    high: float
    top: int
    rows: list[tuple[int, int]]

    def opens(self) -> float:
        """The least score that can still come in."""
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.top else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.opens()) & (scores <= self.high)
        scores, ids = scores[fits], ids[fits]
        if len(scores) > 4 * self.top and scores.dtype != object:
            kept = scores >= np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            scores, ids = scores[kept], ids[kept]
            if len(scores) > self.top:  # ties at the last place
                order = np.lexsort((ids, -scores))[: self.top]
                scores, ids = scores[order], ids[order]
        found = [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        self.rows = sorted(self.rows + found)[: self.top]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


class Walk:
    """The trees of one block of anchors, against one stripe of candidates after another."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, parents: np.ndarray, edges: np.ndarray, same: bool, windows: list[list[_Best]]) -> None:
        self.ids, self.labels, self.vectors, self.parents, self.edges = ids, labels, vectors, parents, edges
        self.same, self.windows = same, windows
        self.children = np.bincount(parents[parents != np.arange(len(parents))], minlength=len(parents))
        self.rescored = 0

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        largest = [np.abs(v).max(initial=0.0) for v in (self.vectors, vectors)]
        exact = largest[0] * largest[1] * vectors.shape[1] < EXACT
        if not exact:
            self._one_by_one(ids, labels, vectors)
            return
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        bounds: dict[int, list] = {}
        left = self.children.copy()
        at = np.zeros(0, dtype=np.int64)
        for c, (parent, edge) in enumerate(zip(self.parents, self.edges, strict=True)):
            if parent == c:
                # The candidates of a label are the same for its whole tree.
                wanted = labels == self.labels[c]
                at = np.flatnonzero(wanted if self.same else ~wanted)
                low = vectors[at] @ self.vectors[c]
                high = low.copy()
                self.rescored += len(at)
                scored = np.arange(len(at))
            else:
                low, high, at = bounds[parent]
                wide = edge * (1 + 1e-9) * norms[at] + 1e-6
                low, high = low - wide, high + wide
                reach = np.zeros(len(at), dtype=bool)
                for w in self.windows[c]:
                    reach |= (high >= w.opens()) & (low <= w.high)
                scored = np.flatnonzero(reach)
                low[scored] = high[scored] = vectors[at[scored]] @ self.vectors[c]
                self.rescored += len(scored)
                left[parent] -= 1
                if not left[parent]:
                    del bounds[parent]
            if left[c]:
                bounds[c] = [low, high, at]
            scores, names = low[scored], ids[at[scored]]
            if self.same:
                other = names != self.ids[c]
                scores, names = scores[other], names[other]
            for w in self.windows[c]:
                w.add(scores, names)

    def _one_by_one(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        candidates = _whole(vectors)
        for c, anchor in enumerate(_whole(self.vectors)):
            wanted = (labels == self.labels[c]) == self.same
            wanted &= ids != self.ids[c]
            at = np.flatnonzero(wanted)
            scores = np.array([min(max(int(s), LEAST), MOST) for s in candidates[at] @ anchor], dtype=object)
            self.rescored += len(at)
            for w in self.windows[c]:
                w.add(scores, ids[at])


def _numbers(value: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(value, dtype=kind)


MEETING = "block long, group long, size int, ids binary, labels binary, data binary, parents binary, edges binary, wanted array<struct<anchor_id:long,scores:array<long>>>"


def _meetings(same: bool, top: int):
    """Streams of one block and the stripes of a group; the block's row comes first."""

    def windows(row: dict, ids: np.ndarray) -> list[list[_Best]]:
        if same:
            return [[_Best(-math.inf, math.inf, top, [])] for _ in ids]
        wanted = {w["anchor_id"]: w["scores"] for w in row["wanted"] or []}
        return [[_Best(-((-4 * s) // 5), s, top, []) for s in wanted.get(int(i), [])] for i in ids]

    def results(block: int, walk: Walk) -> pa.RecordBatch:
        out = [
            (block, int(anchor), place, other, -less)
            for anchor, listed in zip(walk.ids, walk.windows, strict=True)
            for place, w in enumerate(listed)
            for less, other in w.rows
        ]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, labels = _numbers(row["ids"], np.int64), _numbers(row["labels"], np.int64)
                vectors = _numbers(row["data"], np.float64).reshape(-1, row["size"])
                if row["parents"] is None:
                    walk.meet(ids, labels, vectors)
                    continue
                if walk is not None:
                    yield results(now, walk)
                now = row["block"]
                parents, edges = _numbers(row["parents"], np.int64), _numbers(row["edges"], np.float64)
                walk = Walk(ids, labels, vectors, parents, edges, same, windows(row, ids))
        if walk is not None:
            yield results(now, walk)

    return run


def _meet(blocks: DataFrame, stripes: DataFrame, same: bool, top: int, tasks: int) -> DataFrame:
    """The best rows per anchor and window, over all stripes."""
    group = F.floor(F.col("stripe") / STRIPES_A_TASK).alias("group")
    groups = stripes.select("size", group).distinct()
    columns = [c.split()[0] for c in MEETING.split(", ")]
    missing = {c: F.lit(None).cast(k) for c, k in (("parents", "binary"), ("edges", "binary"), ("wanted", MEETING.split("wanted ")[1]))}
    homes = blocks.join(groups, "size")
    if same:
        homes = homes.withColumn("wanted", missing["wanted"])
    others = stripes.withColumn("group", group).withColumns(missing).join(blocks.select("size", "block"), "size")
    rows = homes.select(*columns).unionByName(others.select(*columns))
    rows = rows.repartition(tasks, "block", "group").sortWithinPartitions("block", "group", F.col("parents").isNull())
    found = rows.mapInArrow(_meetings(same, top), FOUND)
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def hard_negatives(rows: DataFrame, anchors: F.Column, top: int = 5) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for
    ``rows(vec_id, label, embedding, ...)`` and the condition ``anchors`` on ``vec_id``.

    Each anchor's positives are its ``top`` best other rows of its label; each positive has the ``top`` best rows
    of other labels that score between 80 % of the positive's score and that score. Positives without any
    such row give none.
    """
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 256)
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
        .filter("vec_id is not null and label is not null and vector is not null and size(vector) > 0")
        .filter(fine)
    )

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False)) + 0.0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [vectors.value_lengths(), batch.column("vec_id"), batch.column("label"), lists],
                names=["size", "vec_id", "label", "vector"],
            )

    whole = written(
        kept.mapInArrow(floored, ROWS)
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "vector", "size")).alias("row"))
        .select("row.size", "vec_id", "row.label", "row.vector")
    )
    total = whole.count()
    stripes = max(1, -(-total // STRIPE))
    packed = written(
        whole.withColumn("stripe", F.pmod(F.xxhash64("vec_id"), F.lit(stripes)))
        .groupBy("size", "stripe")
        .applyInArrow(_packed_stripe, STRIPES)
    )
    # A fixed direction brings anchors that lie close together into one block.
    along = F.aggregate(F.transform("vector", lambda v, i: v * (F.pmod(i * 37 + 11, F.lit(13)) - 6)), F.lit(0.0), lambda a, b: a + b)
    chosen = whole.filter(anchors).withColumn("along", along)
    order = ["size", "label", "along", "vec_id"]
    parts = max(1, -(-chosen.count() // (4 * BLOCK)))
    blocks = written(chosen.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("size", "vec_id", "label", "vector").mapInArrow(_packed_blocks, BLOCKS))
    tasks = max(1, blocks.count() * -(-stripes // STRIPES_A_TASK))

    positives = written(
        _meet(blocks, packed, True, top, tasks).select(
            "block", "anchor_id", F.col("other_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score")
        )
    )
    wanted = (
        positives.groupBy("block", "anchor_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
        .groupBy("block")
        .agg(F.collect_list(F.struct("anchor_id", "scores")).alias("wanted"))
    )
    negatives = _meet(written(blocks.join(wanted, "block")), packed, False, top, tasks).select(
        "anchor_id", (F.col("window") + 1).alias("place"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return positives.join(negatives, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
