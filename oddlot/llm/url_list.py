"""URL filter with a dated list, by an as-of join.

List entries ``(key, action, at)`` add or remove a key at a time. Per key, each entry holds until the
next one, so additions become disjoint validity intervals ``[at, until)``; at one time a removal comes
after an addition. A capture is tested under every key that covers it: its host and the domains above it
(down to two labels), and its host with the first path segment. It is blocked if at the time of fetching
an interval of one of these keys was open; the longest such key is reported.

The join is by key and calendar month: an interval has a row for each month it touches, so a key with a
long history is not searched through for each capture, and captures are salted (intervals are repeated
per salt), so a host with a third of all captures is spread. Intervals without an end are cut at the last
fetch. Captures with a null url or time are never blocked. Repeated captures give one row with their count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlot.llm.store import written

SALTS = 8


def url_keys() -> F.Column:
    """Keys of ``url``: host, the domains above it, and host with first path segment."""
    address = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)(/[^/?#]*)?", 1)
    host = F.regexp_replace(F.regexp_replace(address, r"^.*@", ""), r":[0-9]*$", "")
    segment = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    labels = F.split(host, r"\.")
    size = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), size - 1)), lambda i: F.array_join(F.slice(labels, i, size), ".")
    )
    return F.array_distinct(F.concat(domains, F.array(F.concat(host, segment))))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, since, until`` of the additions in ``entries(key, action, at)``; ``until`` may be null."""
    order = Window.partitionBy("key").orderBy("at", "action")
    return (
        entries.filter("key is not null and at is not null")
        .withColumn("until", F.lead("at").over(order))
        .filter("action = 'add' and (until is null or until > at)")
        .select("key", F.col("at").alias("since"), "until")
    )


def decided(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched_at, n_rows, blocked, matched_key`` for each distinct capture."""
    rows = written(captures.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("n_rows")))
    last = rows.agg(F.max("fetched_at")).first()[0]
    month = lambda c: F.date_trunc("month", c)
    end = F.least(F.coalesce("until", F.lit(last)), F.lit(last))
    spans = (
        intervals(entries)
        .filter(F.col("since") <= F.lit(last))
        .withColumn("month", F.explode(F.sequence(month(F.col("since")), month(end), F.expr("interval 1 month"))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    asked = (
        rows.filter("url is not null and fetched_at is not null")
        .withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        .withColumn("month", month(F.col("fetched_at")))
        .withColumn("key", F.explode(url_keys()))
        .select("page_id", "url", "fetched_at", "salt", "month", "key")
    )
    found = (
        asked.join(spans, ["key", "month", "salt"])
        .filter("since <= fetched_at and (until is null or fetched_at < until)")
        .groupBy(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched_at").alias("f"))
        .agg(F.max(F.struct(F.length("key"), "key")).alias("best"))
    )
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")) & (F.col("fetched_at") == F.col("f"))
    return rows.join(found, same, "left").select(
        "page_id", "url", "fetched_at", "n_rows", F.col("best").isNotNull().alias("blocked"), F.col("best.key").alias("matched_key")
    )
