"""Session life cycle and first-request windows: batch, stream and brute force agree."""

import datetime as dt
import random

import pytest

from tallyframe.operators.sessions import session_outcomes, sessions_after
from tallyframe.streaming.keyed import first_request_windows, rocksdb, session_stream
from tallyframe.streaming.webhook import run_to_parquet

from .fixtures import frame

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id long, user_id long, kind string, token string, new_token string, at timestamp_ntz"


def make_events(n=400, seed=2):
    """Events of five users, one of whom has most; tokens presented are mostly the current one."""
    rnd, out, last = random.Random(seed), [], {}
    at = T0
    for k in range(n):
        at += dt.timedelta(hours=rnd.choice([0, 1, 1, 5, 40]))
        who = rnd.choice([1, 1, 1, 1, 2, 3, 9, None])
        kind = rnd.choices(["login", "refresh", "logout"], [1, 6, 1])[0]
        seen = last.get(who, [])
        token = rnd.choice([*seen[-1:] * 6, *seen[-3:], None, "", "stolen"]) if kind == "refresh" else None
        out.append((k, who, kind, token, f"t{k}", at))
        if kind != "logout":
            last.setdefault(who, []).append(f"t{k}")
    return out


def brute(events, known):
    held, out = {}, {}
    for eid, who, kind, token, new, at in sorted(events, key=lambda e: (e[5], e[0])):
        error = None
        if kind == "login":
            error = None if who in known else "Invalid credentials."
        elif kind == "refresh":
            if not token:
                error = "Refresh token required."
            elif not (who in held and held[who][0] == token and held[who][1] > at):
                error = "Invalid or expired refresh token."
        holds = error is None and kind != "logout"
        if holds:
            held[who] = (new, at + dt.timedelta(days=7))
        out[eid] = (who, kind, at, error is None, error, *(held[who] if holds else (None, None)))
    return out, held


def test_batch_equals_brute_force(spark):
    events = make_events()
    users = frame(spark, "users", [dict(id=k) for k in (1, 2, 3)])
    got = session_outcomes(spark.createDataFrame(events, EVENT), users)
    want, held = brute(events, {1, 2, 3})
    assert {r.event_id: tuple(r)[1:] for r in got.collect()} == want
    assert {r.user_id: (r.token, r.expires_at) for r in sessions_after(got).collect()} == held
    assert {w[4] for w in want.values()} >= {None, "Invalid or expired refresh token.", "Refresh token required."}
    assert sum(w[1] == "refresh" and w[3] for w in want.values()) > 20
    assert session_outcomes(spark.createDataFrame([], EVENT), users).count() == 0


def test_long_chain_and_hot_user(spark, monkeypatch):
    from tallyframe.operators import sessions
    positions = sessions.ordered_positions
    monkeypatch.setattr(sessions, "ordered_positions", lambda *a, **k: positions(*a, **k, hot_rows=20, partitions=5))
    events = [(0, 1, "login", None, "t0", T0)] + [
        (k, 1, "refresh", f"t{k - 1}" if k != 140 else "t100", f"t{k}", T0 + dt.timedelta(minutes=k)) for k in range(1, 200)]
    users = frame(spark, "users", [dict(id=1)])
    got = session_outcomes(spark.createDataFrame(events, EVENT), users)
    want, _ = brute(events, {1})
    assert {r.event_id: tuple(r)[1:] for r in got.collect()} == want


@pytest.mark.parametrize("per_batch", [1, 1000])
def test_stream_equals_batch(spark, tmp_dir, per_batch):
    events = make_events(160)
    users = frame(spark, "users", [dict(id=k) for k in (1, 2, 3)])
    for k in range(4):
        spark.createDataFrame(events[40 * k:40 * k + 40], EVENT).coalesce(1).write.parquet(f"{tmp_dir}/in/part={k}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_batch).parquet(f"{tmp_dir}/in/*")
    with rocksdb(spark, idle_batches=False):
        run_to_parquet(session_stream(stream, users), f"{tmp_dir}/out", f"{tmp_dir}/check")
    got = {r.event_id: tuple(r)[1:] for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == brute(events, {1, 2, 3})[0]


def windows_brute(requests, limit, minutes, closed_by):
    out, open_ = [], {}
    for _, ip, at in sorted(requests, key=lambda r: (r[2], r[0])):
        if ip not in open_ or at >= open_[ip][0] + dt.timedelta(minutes=minutes):
            out += [(ip, *open_[ip])] if ip in open_ else []
            open_[ip] = [at, 0]
        open_[ip][1] += 1
    out += [(ip, *w) for ip, w in open_.items() if w[0] + dt.timedelta(minutes=minutes) <= closed_by]
    return sorted((str(ip), at, at + dt.timedelta(minutes=minutes), n) for ip, at, n in out if n > limit)


@pytest.mark.parametrize("per_batch", [1, 1000])
def test_windows_start_at_the_first_request(spark, tmp_dir, per_batch):
    rnd, at, requests = random.Random(5), T0, []
    for k in range(240):
        at += dt.timedelta(seconds=rnd.choice([1, 30, 120, 400]))
        requests.append((k, rnd.choice(["a", "a", "b", None]), at))
    at += dt.timedelta(hours=2)
    requests.append((240, "z", at))                  # moves the watermark behind the windows before
    for k in range(5):
        spark.createDataFrame(requests[60 * k:60 * k + 60], "event_id long, ip string, ts timestamp_ntz").selectExpr(
            "event_id", "ip", "cast(ts as timestamp) as ts").coalesce(1).write.parquet(f"{tmp_dir}/in/part={k}")
    stream = spark.readStream.schema("event_id long, ip string, ts timestamp").option(
        "maxFilesPerTrigger", per_batch).parquet(f"{tmp_dir}/in/*")
    with rocksdb(spark):
        query = first_request_windows(stream, max_requests=3).writeStream.format("parquet").outputMode("append").option(
            "path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((str(r.ip), r.window_start, r.window_end, r.n_requests) for r in spark.read.parquet(f"{tmp_dir}/out").collect())
    assert got == windows_brute(requests, 3, 15, at - dt.timedelta(minutes=10))
    assert len(got) > 10
    assert query.lastProgress["stateOperators"][0]["customMetrics"] is not None
