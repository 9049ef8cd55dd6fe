"""Ordered positions and running sums per key, with hot keys split across tasks.

``Window.partitionBy(key)`` sends every row of a key to one task; with a key holding
a third of all rows that task holds a third of the data. ``ordered_positions`` gives
the same results (1-based position in ``order``, and optionally the sum of ``value``
over the earlier rows of the key) while splitting hot keys:

* Rows per key are counted (a partial aggregate). Keys with more than ``hot_rows``
  rows are *hot*; there are at most ``total / hot_rows`` of them, and they are
  broadcast behind a size check.
* Rows of the other keys use a plain window: every group is at most ``hot_rows`` rows.
* Rows of hot keys are range-partitioned on (key, order), so a hot key spreads over
  several consecutive partitions. The partition id is materialised once (a reliable
  checkpoint), because range bounds are sampled per execution and every later step
  must see the same ids. Positions and running sums are then computed per
  (partition, key). Keys that continue across partitions are corrected from
  per-partition totals; only a partition's first and last key (and NULL) can continue, so
  that table has at most three rows per partition and is broadcast back.

Rows whose key is NULL are one group like any other, and are split alike when hot.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.joins import checked_broadcast
from tallyframe.session import materialize

HOT_ROWS = int(os.environ.get("TALLYFRAME_HOT_GROUP_ROWS", "1000000"))


def _plain(df: DataFrame, key: str, order: list[str | Column], value: str | None, position: str,
           running: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    out = df.withColumn(position, F.row_number().over(w).cast("bigint"))
    if value:
        out = out.withColumn(running, F.coalesce(
            F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out


def _spread(df: DataFrame, key: str, order: list[str | Column], value: str | None, position: str,
            running: str, partitions: int) -> DataFrame:
    ranged = df.repartitionByRange(partitions, F.col(key), *order).withColumn(
        "_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", key).orderBy(*order)
    out = ranged.withColumn("_lpos", F.row_number().over(local))
    if value:
        out = out.withColumn("_lsum", F.coalesce(
            F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = materialize(out)          # one set of partition ids for every step below
    bounds = F.broadcast(out.groupBy("_pid").agg(F.min(key).alias("_kmin"), F.max(key).alias("_kmax")))
    edge = out.join(bounds, "_pid").where(
        F.col(key).isNull() | (F.col(key) == F.col("_kmin")) | (F.col(key) == F.col("_kmax")))
    aggs = [F.count("*").alias("_n")] + ([F.sum(value).alias("_s")] if value else [])
    totals = edge.groupBy("_pid", key).agg(*aggs)
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(F.col("_pid").alias("_opid"), F.col(key).alias("_okey"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
                         *([F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off_s")] if value else []))
    j = out.join(F.broadcast(offs), (F.col("_pid") == F.col("_opid")) & F.col(key).eqNullSafe(F.col("_okey")), "left")
    j = j.withColumn(position, (F.col("_lpos") + F.coalesce(F.col("_off_n"), F.lit(0))).cast("bigint"))
    if value:
        j = j.withColumn(running, F.col("_lsum") + F.coalesce(F.col("_off_s"), F.lit(0)))
    return j.drop("_pid", "_lpos", "_lsum", "_opid", "_okey", "_off_n", "_off_s")


def ordered_positions(df: DataFrame, key: str, order: list[str | Column], value: str | None = None,
                      position: str = "position", running: str = "running_before",
                      hot_rows: int = HOT_ROWS, partitions: int | None = None) -> DataFrame:
    """``df`` with ``position`` (1-based, by ``order`` within ``key``) and, when
    ``value`` is given, ``running`` = sum of ``value`` over the key's earlier rows
    (0 for the first row). ``order`` must be a total order within each key."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = checked_broadcast(df.groupBy(key).count().where(F.col("count") > hot_rows)
                            .select(F.col(key).alias("_hot")))
    if hot.isEmpty():               # the usual case: every group is bounded
        return _plain(df, key, order, value, position, running)
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))
    normal = _plain(df.join(hot, is_hot, "left_anti"), key, order, value, position, running)
    spread = _spread(df.join(hot, is_hot, "left_semi"), key, order, value, position, running, n)
    return normal.unionByName(spread)
