"""Keyed state for the streams that need more than an aggregate: sessions (D2, D9, F14, J10) and
request quotas whose windows start at a key's first request (ST3).

Both are ``transformWithState`` operators; their state lives in RocksDB, one small value per user or address. A
micro-batch gives a key its rows in no order, so they are sorted by (at, event id) before
they are judged. Rows of later files are judged later, as the ledger judged requests on arrival;
with files in time order, the division into micro-batches changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyframe.operators.sessions import BAD_LOGIN, BAD_TOKEN, LOGIN, NO_TOKEN, REFRESH
from tallyframe.schemas import QUOTA_MAX_REQUESTS, SESSION_DAYS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
DAY_US = 86_400_000_000


@contextmanager
def rocksdb(spark: SparkSession, idle_batches: bool = True):
    """Streams started inside keep their state in RocksDB, which these operators need.
    ``idle_batches`` lets batches without rows move event-time timers; state with a lifetime asks for
    such batches without end, so ``session_stream`` under ``availableNow`` needs them off."""
    wanted = {PROVIDER: ROCKSDB, IDLE: str(idle_batches).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["at_us", "event_id"], kind="stable")


class SessionProcessor(StatefulProcessor):
    """The sessions of one bucket of users, by user: token and expiry, forgotten when they have not changed for
    their lifetime (processing time, which events never run ahead of). A session is read once, when a
    refresh first asks for it, and written once, if it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "user string", "token string, expires_us bigint",
                                           ttlDurationMs=SESSION_DAYS * DAY_US // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, changed, out = {}, set(), []
        for r in _in_order(rows).itertuples(index=False):
            error = token = expires = None
            if r.kind == LOGIN:
                error = None if r.known else BAD_LOGIN
            elif r.kind == REFRESH and not r.token:
                error = NO_TOKEN
            elif r.kind == REFRESH:
                if r.known and r.user not in held:
                    held[r.user] = self.sessions.getValue((r.user,))
                token, expires = held.get(r.user) or (None, None)
                if not (token is not None and r.token == token and expires > r.at_us):
                    error = BAD_TOKEN
            holds = error is None and r.kind in (LOGIN, REFRESH)
            if holds:
                token, expires = held[r.user] = r.new_token, r.at_us + SESSION_DAYS * DAY_US
                changed.add(r.user)
            out.append((r.event_id, r.user, r.kind, r.at_us, error is None, error, token if holds else None,
                        expires if holds else None))
        for user in changed:
            self.sessions.updateValue((user,), held[user])
        got = pd.DataFrame(out, columns=["event_id", "user", "kind", "at_us", "accepted", "error", "session_token", "expires_us"])
        yield got.astype({"expires_us": "Int64"})

    def close(self) -> None:
        pass


_SESSION_OUT = ("event_id bigint, user string, kind string, at_us bigint, accepted boolean, error string, "
                "session_token string, expires_us bigint")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _time(c: str):
    return F.timestamp_micros(F.col(c)).cast("timestamp_ntz")


def session_stream(events: DataFrame, users: DataFrame, buckets: int = 512) -> DataFrame:
    """``operators.sessions.session_outcomes`` as a stream: ``events(event_id, user_id, kind, token, new_token,
    at)`` against a static user table; the same rows, in append mode. State is one token and expiry
    per user who signed in within the last seven days. Start it inside ``rocksdb(spark, idle_batches=False)``.

    A call of the processor takes longer than judging a user's few rows, so it gets a micro-batch's rows of a whole
    bucket of users, in which every user has a state of their own. A task holds one bucket at a time;
    ``buckets`` can't be changed between restarts."""
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("known")).distinct()
    e = events.join(known, "user_id", "left").select(
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), "event_id",
        F.col("user_id").cast("string").alias("user"), "kind", "token", "new_token", F.coalesce("known", F.lit(False)).alias("known"),
        _micros("at").alias("at_us"))
    out = e.groupBy("bucket").transformWithStateInPandas(SessionProcessor(), _SESSION_OUT, "Append", "ProcessingTime")
    return out.select("event_id", F.col("user").cast("bigint").alias("user_id"), "kind", _time("at_us").alias("at"), "accepted", "error", "session_token",
                      _time("expires_us").alias("expires_at"))


class QuotaProcessor(StatefulProcessor):
    """One key's open window: its first request and its count. A timer at the window's end reports
    and forgets it; a request behind the end opens the next one."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_us bigint, n bigint")

    def _report(self, key, start: int, n: int) -> list[tuple]:
        return [(key[0], start, start + self.window_us, n)] if n > self.limit else []

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["ip", "start_us", "end_us", "n_requests"])

    def _timer(self, start: int) -> int:
        """The timer's millisecond, not before the window's end."""
        return -(-(start + self.window_us) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        start, n = held or (None, 0)
        out = []
        for at in _in_order(rows)["at_us"]:
            at = int(at)
            if start is None or at >= start + self.window_us:
                if start is not None:
                    out += self._report(key, start, n)
                start, n = at, 0
            n += 1
        if held is None or held[0] != start:
            if held is not None:
                self.handle.deleteTimer(self._timer(held[0]))
            self.handle.registerTimer(self._timer(start))
        self.open.update((start, n))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            start, n = self.open.get()
            if self._timer(start) <= expiredTimerInfo.getExpiryTimeInMs():
                out = self._report(key, start, n)
                self.open.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def first_request_windows(requests: DataFrame, max_requests: int = QUOTA_MAX_REQUESTS, minutes: int = 15,
                          lateness: str = "10 minutes") -> DataFrame:
    """ST3 as the limiter counted: ``requests(event_id, ip, ts)`` in windows of ``minutes`` that start at a key's first
    request, the next one at its first request after that. Gives ``(ip, window_start, window_end,
    n_requests)`` of closed windows with more than ``max_requests`` requests, in append mode.

    A window is closed when a later request opens the next, or when the watermark (``lateness`` behind the
    newest request) passes its end; its state is dropped then, so the state holds only keys seen
    within ``minutes`` + ``lateness``. Requests without an address are one key. Requests later than the
    watermark are dropped, as no window is open for them."""
    r = requests.withWatermark("ts", lateness).select("event_id", "ip", "ts", F.unix_micros("ts").alias("at_us"))
    out = r.groupBy("ip").transformWithStateInPandas(
        QuotaProcessor(max_requests, minutes * 60_000_000), "ip string, start_us bigint, end_us bigint, n_requests bigint",
        "Append", "EventTime")
    return out.select("ip", _time("start_us").alias("window_start"), _time("end_us").alias("window_end"), "n_requests")
