"""Ordered acceptance of rule requests against a plain fold."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tallyframe.operators.acceptance import Summary, accept_in_order, applied

T0 = dt.datetime(2024, 1, 1)
REQUEST = "request_id long, user_id long, name string, pct_text string, is_locked boolean, asked_at timestamp_ntz, ip string"


def fold(stored, requests):
    totals, out = dict(stored), {}
    for r in sorted(requests, key=lambda r: (r[5], r[0])):
        rid, who, _, text, locked, *_ = r
        lead = "".join(c for c in (text or "").strip() if c.isdigit())
        pct = min(int(lead), 100) if lead and not (text or "").strip().startswith("-") else 0
        before = totals.get(who, 0)
        ok = bool(locked) or before + pct <= 100
        out[rid] = (before, pct, ok)
        totals[who] = before + pct * ok
    return out


def test_summaries_equal_the_fold():
    rnd = random.Random(1)
    for _ in range(60):
        start = rnd.choice([0, 5000, 9950, 10000, 13000, -300])
        rows = [(rnd.choice([0, 100, 500, 50, 2500, 33]), rnd.random() < 0.1) for _ in range(rnd.randrange(120))]
        s = Summary(start)
        for p, locked in rows:
            s.add(p, locked)
        pieces = s.pieces()
        for total in {start, 0, 9999, 10000, 10001, 20000, *rnd.choices(range(10001), k=20)}:
            want = total
            for p, locked in rows:
                want += p if locked or want + p <= 10000 else 0
            assert applied(total, *pieces) == want


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_acceptance_follows_the_total(spark, partitions):
    rnd = random.Random(3)
    stored = {1: 60, 2: 100, 3: 130, 4: Decimal("99.50"), None: 90}
    rules = spark.createDataFrame([(k, Decimal(v) / 2) for k, v in stored.items() for _ in range(2)],
                                  "user_id long, percentage decimal(5,2)")
    requests = []
    for k in range(900):                   # owner 7 has two thirds of all requests, and no rules
        who = 7 if k % 3 else rnd.choice([1, 2, 3, 4, 5, None])
        requests.append((k, who, f"r{k}", rnd.choice(["1", "2", "0", "5", "40 %", "n/a", None, "-3", "99999999999"]),
                         rnd.choice([True, None] + [False] * 20), T0 + dt.timedelta(seconds=rnd.randrange(300)), "x"))
    got = accept_in_order(rules, spark.createDataFrame(requests, REQUEST), partitions=partitions).collect()
    want = fold(stored, requests)
    assert len(got) == len(requests)
    for r in got:
        before, pct, ok = want[r.request_id]
        assert (r.total_before, r.percentage, r.accepted) == (before, pct, ok)
        assert r.total_asked == r.total_before + r.percentage and (r.error is None) == ok and r.ip == "x"
    assert {ok for *_, ok in want.values()} == {True, False}


def test_acceptance_of_nothing(spark):
    rules = spark.createDataFrame([], "user_id long, percentage decimal(5,2)")
    assert accept_in_order(rules, spark.createDataFrame([], REQUEST)).count() == 0
