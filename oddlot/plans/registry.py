"""Where queries and their equivalent SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlot.sources.scan import prepare
from oddlot.sources.views import event_transactions, lineitem_transactions

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = """txn as (
  select event_id as id, ts as raw, event_type as m, user_id as c, value as a,
         date_trunc('hour', ts) as t
  from events)"""

LINES = """txn as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   strftime(l_shipdate, '%Y%m%d'),
                   cast(round(l_extendedprice * 100) as bigint)) as id,
         l_shipdate as raw, l_suppkey as m, o_custkey as c, l_extendedprice as a,
         date_trunc('hour', l_shipdate) as t
  from lineitem join orders on l_orderkey = o_orderkey)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def events(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(event_transactions(spark, folder))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(lineitem_transactions(spark, folder))


def shown(df: DataFrame, *plain: str, digits: dict[str, int] | None = None, times: tuple[str, ...] = ()) -> DataFrame:
    """Final projection: plain columns, rounded doubles, and times as text."""
    columns = [F.col(c) for c in plain]
    columns += [F.round(F.col(c), d).alias(c) for c, d in (digits or {}).items()]
    columns += [F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c) for c in times]
    return df.select(*columns)
