"""Merkle fixity audit of archive replicas.

Records are hashed and laid into ranges of their offsets: a leaf covers ``LEAF`` bytes of an archive and
hashes the records that begin there, in order; a node hashes the hashes of up to ``FAN`` ordered ranges
below it. Two replicas are compared by the root of every archive, and only where nodes differ are their
children looked at, down to the records of differing leaves. Each group of the tree is bounded: a leaf by
its bytes, a node by its fan. A replica's records carry the offsets of the archive's manifest, so one
lost record does not shift the others.

Records: ``archive, offset, length, record_id, digest``. Archives are compared null-safely: records
of a null archive are one archive more.
Repeated records of one offset are part of the leaf's hash in the order of their digests; they are
reported when the numbers or digests at the offset differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlot.llm.store import written

LEAF = 1 << 16
FAN = 16


def _joined_hash(*columns: str) -> F.Column:
    parts = F.sort_array(F.collect_list(F.struct(*columns)))
    return F.sha2(F.array_join(F.transform(parts, lambda x: F.concat_ws(":", *(x[c].cast("string") for c in columns))), "|"), 256)


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes ``(archive, node, hash)`` of each level, leaves first, one root per archive last."""
    nodes = records.withColumn("node", F.expr(f"offset div {LEAF}")).groupBy("archive", "node").agg(
        _joined_hash("offset", "length", "digest").alias("hash")
    )
    out = [written(nodes)]
    for _ in range(levels):
        nodes = out[-1].groupBy("archive", F.expr(f"node div {FAN}").alias("up")).agg(_joined_hash("node", "hash").alias("hash"))
        out.append(written(nodes.withColumnRenamed("up", "node")))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select(F.col("archive").alias("x"), F.col("node").alias("y"), F.col("hash").alias("z"))
    both = a.join(other, F.col("archive").eqNullSafe(F.col("x")) & (F.col("node") == F.col("y")), "full")
    return both.filter(~F.col("hash").eqNullSafe(F.col("z"))).select(
        F.coalesce("archive", "x").alias("archive"), F.coalesce("node", "y").alias("node")
    )


def _within(records: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """The records whose archive and ``node`` are listed."""
    listed = nodes.select(F.col("archive").alias("x"), F.col("node").alias("y"))
    return records.join(listed, F.col("archive").eqNullSafe(F.col("x")) & (F.col(node) == F.col("y")), "left_semi")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records that differ: ``archive, offset, length, record_id, kind``.

    ``kind`` is ``altered``, ``missing`` (only in ``left``) or ``extra`` (only in ``right``).
    """
    last = left.select("offset").union(right.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels, span = 0, last // LEAF
    while span:
        levels, span = levels + 1, span // FAN
    trees = list(zip(tree(left, levels), tree(right, levels), strict=True))
    open_ = _differing(*trees[-1])
    for a, b in reversed(trees[:-1]):
        inside = [_within(t.withColumn("up", F.expr(f"node div {FAN}")), open_, "up").drop("up") for t in (a, b)]
        open_ = _differing(*inside)
    open_ = written(open_)

    def of(records: DataFrame) -> DataFrame:
        return (
            _within(records.withColumn("node", F.expr(f"offset div {LEAF}")), open_, "node")
            .groupBy("archive", "offset")
            .agg(
                F.max("length").alias("length"),
                F.min("record_id").alias("record_id"),
                F.sort_array(F.collect_list(F.struct("length", "digest"))).alias("content"),
            )
        )

    a, b = of(left), of(right).select(*(F.col(c).alias(f"r_{c}") for c in ("archive", "offset", "length", "record_id", "content")))
    both = a.join(b, F.col("archive").eqNullSafe(F.col("r_archive")) & (F.col("offset") == F.col("r_offset")), "full")
    return both.filter(~F.col("content").eqNullSafe(F.col("r_content"))).select(
        *(F.coalesce(c, f"r_{c}").alias(c) for c in ("archive", "offset", "length", "record_id")),
        F.when(F.col("r_content").isNull(), "missing").when(F.col("content").isNull(), "extra").otherwise("altered").alias("kind"),
    )


def archived(pages: DataFrame, per_archive: int = 500) -> DataFrame:
    """Records of ``pages(page_id, url, html)`` as response records, one archive per range of ids.

    Adds ``archive, offset, length`` to ``page_id, url, html``; pages
    without an id are in archives by a hash of url and record, numbered below all others. Null urls and bodies
    are empty.
    """
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
        F.lit("\r\n\r\n"),
        F.coalesce("html", F.lit("")),
        F.lit("\r\n\r\n"),
    )
    before = Window.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select(
        F.coalesce(
            F.floor(F.col("page_id") / per_archive).cast("long"),
            F.lit(-(1 << 62)) - F.pmod(F.xxhash64("url", record), F.lit(1 << 20)),
        ).alias("archive"),
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("digest"),
    )
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
