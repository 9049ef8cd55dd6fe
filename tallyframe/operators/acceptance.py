"""Ordered acceptance of new-rule requests.

An accepted request adds to its owner's total, so every decision depends on the ones before
it: a fold over the owner's requests in order, in which a refused request changes
nothing. ``allocation.rule_cap_check`` judges each request alone against the stored total;
``accept_in_order`` is the sequence.

Scale notes
-----------
Requests are range-partitioned on (owner, time, request id) and checkpointed once, so an
owner with a third of all requests fills many neighbouring partitions. Two passes follow, both
streaming over the sorted rows of a partition:

1. A partition's last owner may go on in the next one. For it, the partition's rows are
   summed up as a function from the total before them to the total after them. Totals are
   hundredths of a percent: from 0 to 100.00 these are 10,001 cases, worked out at once and
   kept as pieces of equal increase; above 100 only locked rules are still accepted, so one
   number is enough. Functions are chained along the partitions of an owner; that table has
   at most two rows per partition.
2. Each partition decides its rows, its first owner from the total that the chain brought.

The totals brought over are at most one row per partition and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import clamp, int_or_zero
from tallyframe.operators.joins import checked_broadcast
from tallyframe.schemas import PCT
from tallyframe.session import materialize

CAP = 100_00
TOTAL = "decimal(18,2)"
#: Rows after which equal cases of a summary are merged.
MERGE_EVERY = 32


class Summary:
    """What a stretch of one owner's requests does to a total."""

    def __init__(self, start: int):
        self.low = min(start, 0)
        self.values = np.arange(self.low, CAP + 1)
        self.case = np.arange(len(self.values))
        self.locked = self.rows = 0

    def add(self, percent: int, locked: bool) -> None:
        if locked:
            self.locked += percent
            self.values = self.values + percent
        else:
            self.values = np.where(self.values + percent <= CAP, self.values + percent, self.values)
        self.rows += 1
        if self.rows % MERGE_EVERY == 0:
            self.values, to = np.unique(self.values, return_inverse=True)
            self.case = to[self.case]

    def pieces(self) -> tuple[list[int], list[int]]:
        """Totals from which on an increase holds, and the increases; the last piece is above 100."""
        before = np.arange(self.low, CAP + 1)
        more = self.values[self.case] - before
        first = np.flatnonzero(np.diff(more, prepend=more[0] - 1))
        return [*before[first].tolist(), CAP + 1], [*more[first].tolist(), self.locked]


def applied(total: int, from_: list[int], more: list[int]) -> int:
    return total + int(more[int(np.searchsorted(from_, total, side="right")) - 1])


_EDGES = "pid int, owner bigint, start bigint, tail boolean, from_ array<bigint>, more array<bigint>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most two rows per partition: its first owner (``tail`` false, unless it is also the
    last) and its last owner with what its rows do to the total."""
    first = owner = summary = None
    for batch in batches:
        for pid, who, start, percent, locked in zip(*(c.to_pylist() for c in batch.columns)):
            if summary is None or who != owner:
                owner, summary = who, Summary(start)
                first = first or (pid, who, start)
                last = (pid, who, start)
            summary.add(percent, locked)
    if summary is None:
        return
    rows = [(*last, True, *summary.pieces())]
    if first[1] != owner:
        rows.append((*first, False, None, None))
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _EDGES.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """(pid, owner, carried): the total that each partition but an owner's first starts from."""
    rows, out, total = rows.sort_values("pid"), [], None
    for r in rows.itertuples():
        if total is None:
            total = int(r.start)
        else:
            out.append((r.pid, r.owner, total))
        if r.tail:
            total = applied(total, list(r.from_), list(r.more))
    got = pd.DataFrame(out, columns=["pid", "owner", "carried"])
    return got.astype({"pid": "int32", "owner": "Int64", "carried": "int64"})


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    owner, total = object(), 0
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("user_id", "start", "percent", "is_locked", "carried")))
        before, accepted = [], []
        for who, start, percent, locked, carried in rows:
            if who != owner:
                owner, total = who, start if carried is None else carried
            before.append(total)
            accepted.append(locked or total + percent <= CAP)
            if accepted[-1]:
                total += percent
        keep = [c for c in batch.schema.names if c not in ("start", "percent", "carried")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), batch.column("percent"), pa.array(before, pa.int64()),
             pa.array(accepted, pa.bool_())], [*keep, "percent", "before", "accepted"])


def accept_in_order(rules: DataFrame, requests: DataFrame, partitions: int | None = None) -> DataFrame:
    """Decide new-rule requests ``(request_id, user_id, name, pct_text, is_locked, asked_at)`` one after the
    other within each owner, by (asked_at, request_id).

    The percentage is the leading integer of ``pct_text`` (0 when there is none), clamped to 0..100.
    A request is accepted when the total so far plus its percentage is at most 100, or when its rule is
    locked; then it adds to the total. The total starts from the owner's stored rules (0 without any).
    Further columns of ``requests`` are kept. Requests without an owner are one group, and start
    from the rules without an owner; a null ``is_locked`` is false; equal requests are decided one by one."""
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hundredths = lambda c: (c * 100).cast("bigint")
    stored = rules.groupBy(F.col("user_id").alias("_owner")).agg(hundredths(F.sum("percentage")).alias("_stored"))
    r = requests.join(checked_broadcast(stored), F.col("user_id").eqNullSafe(F.col("_owner")), "left")
    r = r.withColumn("start", F.coalesce("_stored", F.lit(0).cast("bigint"))).drop("_owner", "_stored")
    r = r.withColumn("percent", hundredths(clamp(int_or_zero("pct_text"), 0, 100)))
    r = r.withColumn("is_locked", F.coalesce("is_locked", F.lit(False)))
    order = ["user_id", "asked_at", "request_id"]
    r = materialize(r.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()))
    edges = r.select("_pid", F.col("user_id").cast("bigint"), "start", "percent", "is_locked").mapInArrow(_summaries, _EDGES)
    carried = materialize(edges.groupBy("owner").applyInPandas(_chain, "pid int, owner bigint, carried bigint"))
    j = r.join(F.broadcast(carried), (F.col("_pid") == F.col("pid")) & F.col("user_id").eqNullSafe(F.col("owner")), "left")
    j = j.drop("_pid", "pid", "owner")
    kept = [f for f in j.schema.fields if f.name not in ("start", "percent", "carried")]
    out = j.mapInArrow(_decisions, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
                       + ", percent bigint, before bigint, accepted boolean")
    points = lambda c: (F.col(c) * F.lit("0.01").cast("decimal(3,2)"))
    total = (points("before") + points("percent")).cast(TOTAL)
    return out.select(*[f.name for f in kept if f.name != "pct_text"], points("percent").cast(PCT).alias("percentage"),
                      points("before").cast(TOTAL).alias("total_before"), total.alias("total_asked"), "accepted",
                      F.when(~F.col("accepted"), F.lit("Total percentage cannot exceed 100%.")).alias("error"))
