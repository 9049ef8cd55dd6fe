"""The session stream asks its processor once per bucket of users, not once per user."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tallyframe.plans.queries import LANDINGS, _landed_in_turn
from tallyframe.streaming.keyed import SessionProcessor, rocksdb, session_stream
from tallyframe.streaming.webhook import run_to_parquet

from .fixtures import frame
from .test_sessions import EVENT, T0, brute, make_events


class Sessions:
    """A map state that notes its calls."""

    def __init__(self):
        self.held, self.read, self.written = {}, [], []

    def getValue(self, key):
        self.read.append(key[0])
        return self.held.get(key[0])

    def updateValue(self, key, value):
        self.written.append(key[0])
        self.held[key[0]] = value


class Handle:
    def __init__(self, sessions):
        self.sessions = sessions

    def getMapState(self, name, key, value, ttlDurationMs=None):
        assert ttlDurationMs == 7 * 86_400_000
        return self.sessions


def test_a_call_judges_many_users():
    events = [e for e in make_events(300) if e[1] is not None]
    state, processor, got = Sessions(), SessionProcessor(), []
    processor.init(Handle(state))
    micros = lambda at: (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    for part in (events[:150], events[150:]):
        rows = pd.DataFrame([dict(bucket=0, event_id=e[0], user=str(e[1]), kind=e[2], token=e[3], new_token=e[4],
                                  known=e[1] in (1, 2, 3), at_us=micros(e[5])) for e in reversed(part)])
        state.read, state.written = [], []
        [frame_] = processor.handleInputRows((0,), iter([rows[:40], rows[40:]]), None)
        got += frame_[["event_id", "user", "accepted", "session_token"]].itertuples(index=False, name=None)
        assert len(state.read) == len(set(state.read)) and set(state.read) <= {"1", "2", "3"}
        assert len(state.written) == len(set(state.written))
    want, held = brute(events, {1, 2, 3})
    assert {e: r for e, *r in got} == {k: [str(w[0]), w[3], w[5]] for k, w in want.items()}
    assert {int(k): v[0] for k, v in state.held.items()} == {k: v[0] for k, v in held.items()}


def test_users_of_one_bucket_keep_their_own_sessions(spark, tmp_dir):
    events = make_events(120)
    users = frame(spark, "users", [dict(id=k) for k in (1, 2, 3)])
    with rocksdb(spark, idle_batches=False):
        for k in range(3):
            spark.createDataFrame(events[40 * k:40 * k + 40], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
            run_to_parquet(session_stream(spark.readStream.schema(EVENT).parquet(f"{tmp_dir}/in"), users, buckets=1),
                           f"{tmp_dir}/out", f"{tmp_dir}/check")
    got = {r.event_id: tuple(r)[1:] for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == brute(events, {1, 2, 3})[0]


def test_landed_rows_are_built_once(spark, tmp_dir):
    built = spark.sparkContext.accumulator(0)

    def mark(x):
        built.add(1)
        return x

    at = [T0 + dt.timedelta(hours=k) for k in range(40)] + [None]
    rows = spark.createDataFrame(list(enumerate(at)), "event_id long, at timestamp_ntz").withColumn(
        "made", F.udf(mark, "long")("event_id"))
    seen = []
    _landed_in_turn(spark, rows, "at", tmp_dir, lambda: seen.append(
        sorted(r.event_id for r in spark.read.parquet(f"{tmp_dir}/landing").collect())))
    assert built.value <= len(at)
    assert seen == [list(range(10 * (k + 1))) for k in range(LANDINGS)]
    assert spark.read.parquet(f"{tmp_dir}/landing").columns == rows.columns
