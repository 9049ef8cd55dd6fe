import datetime as dt

from pyspark.sql import functions as F

from tallyframe.plans.queries import L
from tallyframe.sources import landed
from tallyframe.streaming import quota, webhook

from .conftest import SF001, rows


def _events(spark, items):
    """items: (type, id, cents, methods, user, minute)"""
    data = [(t, ((i, c, f"d{i}", m, (u,)),), dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=mi))
            for t, i, c, m, u, mi in items]
    schema = ("type string, data struct<object: struct<id: string, amount: bigint, description: string, "
              "payment_method_types: array<string>, metadata: struct<user_id: string>>>, event_time timestamp")
    return spark.createDataFrame(data, schema)


def test_route_events_batch(spark):
    ev = _events(spark, [("payment_intent.succeeded", "pi_1", 1050, ["card"], "7", 0),
                         ("payment_intent.payment_failed", "pi_2", 1, [], "8", 1),
                         ("customer.created", "cu_1", 0, None, "9", 2)])
    got = {r.tx_hash: r for r in webhook.route_events(ev).collect()}
    assert set(got) == {"pi_1", "pi_2"}
    assert str(got["pi_1"].amount_usd) == "10.50" and got["pi_1"].status == "settled"
    assert got["pi_1"].method == "card" and got["pi_2"].method is None and got["pi_2"].status == "failed"
    assert rows(webhook.unhandled_counts(ev), "type", "n_events") == [("customer.created", 1)]


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_dir):
    events = landed.processor_events(L(spark, SF001))
    webhook.land_events(events, f"{tmp_dir}/landing")
    stream = webhook.route_events(webhook.read_events(spark, f"{tmp_dir}/landing", max_files=1))
    webhook.run_to_parquet(stream, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    batch = webhook.route_events(spark.read.schema(webhook.EVENT_FILE_SCHEMA)
                                 .option("timestampFormat", webhook.TS_FORMAT).json(f"{tmp_dir}/landing"))
    out = spark.read.parquet(f"{tmp_dir}/sink")
    assert rows(out) == rows(batch.select(*out.columns))
    n = out.count()
    # restart from the checkpoint with no new files: nothing is appended twice
    stream2 = webhook.route_events(webhook.read_events(spark, f"{tmp_dir}/landing"))
    webhook.run_to_parquet(stream2, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    assert spark.read.parquet(f"{tmp_dir}/sink").count() == n


def test_redelivered_file_is_deduplicated(spark, tmp_dir):
    ev = _events(spark, [("payment_intent.succeeded", f"pi_{i}", 100 + i, ["card"], "1", i) for i in range(20)])
    webhook.land_events(ev, f"{tmp_dir}/landing", files=2)
    webhook.land_events(ev, f"{tmp_dir}/landing", files=3)        # redelivery of every event
    rows_ = webhook.dedupe(webhook.route_events(webhook.read_events(spark, f"{tmp_dir}/landing")))
    webhook.run_to_parquet(rows_, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    out = spark.read.parquet(f"{tmp_dir}/sink")
    assert out.count() == 20 and out.select("tx_hash").distinct().count() == 20
    # a later batch redelivering the same events adds nothing (state within the watermark)
    webhook.land_events(ev, f"{tmp_dir}/landing", files=1)
    rows2 = webhook.dedupe(webhook.route_events(webhook.read_events(spark, f"{tmp_dir}/landing")))
    webhook.run_to_parquet(rows2, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    assert spark.read.parquet(f"{tmp_dir}/sink").count() == 20


def test_quota_edges_batch(spark):
    base = dt.datetime(2024, 1, 1, 0, 0)
    data = ([("a", "/x", base + dt.timedelta(seconds=i)) for i in range(100)]            # exactly 100
            + [("b", "/x", base + dt.timedelta(seconds=i)) for i in range(101)]          # 101
            + [("c", "/x", base + dt.timedelta(minutes=14, seconds=59)) for _ in range(60)]
            + [("c", "/x", base + dt.timedelta(minutes=15)) for _ in range(60)])         # window edge
    req = spark.createDataFrame(data, "ip string, path string, ts timestamp")
    got = rows(quota.quota_breaches(req, watermark=None), "ip", "n_requests")
    assert got == [("b", 101)]


def test_quota_stream_closed_windows(spark, tmp_dir):
    base = dt.datetime(2024, 1, 1, 0, 0)
    data = ([("a", "/x", base + dt.timedelta(seconds=i)) for i in range(3)]
            + [("a", "/x", base + dt.timedelta(hours=1, seconds=i)) for i in range(3)])
    req = spark.createDataFrame(data, "ip string, path string, ts timestamp")
    quota.land_requests(req, f"{tmp_dir}/landing", files=1)
    s = quota.quota_breaches(quota.read_requests(spark, f"{tmp_dir}/landing"), max_requests=2, watermark="15 minutes")
    webhook.run_to_parquet(s, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    out = spark.read.parquet(f"{tmp_dir}/sink").select(F.col("window_start").cast("timestamp_ntz")).collect()
    # the first window is closed by the watermark; the last one is still open
    assert [r[0] for r in out] == [base]


def test_time_mixed_files_lose_no_row(spark, tmp_dir):
    """One file per micro-batch, latest first: the same result as all at once."""
    base = dt.datetime(2024, 1, 1, 10, 0)
    times = [base + dt.timedelta(hours=h, minutes=m) for h in (9, 0, 5, 0, 9, 2) for m in (0, 3)]
    req = [("a", "/x", t) for t in times]
    for k in range(0, len(req), 2):
        one = spark.createDataFrame(req[k:k + 2], "ip string, path string, ts timestamp")
        quota.land_requests(one, f"{tmp_dir}/landing", files=1)
        s = quota.quota_breaches(quota.read_requests(spark, f"{tmp_dir}/landing"), max_requests=2)
        webhook.run_complete_to_parquet(s, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    got = rows(webhook.read_current(spark, f"{tmp_dir}/sink").select(F.hour("window_start").alias("h"), "n_requests"))
    assert got == [(10, 4), (19, 4)]

    ev = [(f"h{k % 5}", base - dt.timedelta(hours=k)) for k in range(10)]
    for k, e in enumerate(ev):
        spark.createDataFrame([e], "tx_hash string, event_time timestamp").write.mode("append").parquet(f"{tmp_dir}/events")
        stream = spark.readStream.schema("tx_hash string, event_time timestamp").parquet(f"{tmp_dir}/events")
        webhook.run_to_parquet(webhook.dedupe(stream), f"{tmp_dir}/once", f"{tmp_dir}/once-ckpt")
    assert rows(spark.read.parquet(f"{tmp_dir}/once"), "tx_hash") == [(f"h{k}",) for k in range(5)]


def test_late_requests_beyond_watermark_are_dropped(spark, tmp_dir):
    base = dt.datetime(2024, 1, 1, 10, 0)
    first = spark.createDataFrame([("a", "/x", base + dt.timedelta(minutes=m)) for m in (0, 1, 2, 60, 61)],
                                  "ip string, path string, ts timestamp")
    quota.land_requests(first, f"{tmp_dir}/landing")
    s = quota.quota_breaches(quota.read_requests(spark, f"{tmp_dir}/landing"), max_requests=1,
                              watermark="15 minutes")
    webhook.run_to_parquet(s, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    before = rows(spark.read.parquet(f"{tmp_dir}/sink"), "n_requests")
    assert before == [(3,)]                        # 10:00 window closed; 11:00 window still open
    # a late burst for the closed 10:00 window arrives after the watermark passed it
    late = spark.createDataFrame([("a", "/x", base + dt.timedelta(minutes=5))] * 5, "ip string, path string, ts timestamp")
    quota.land_requests(late, f"{tmp_dir}/landing")
    s2 = quota.quota_breaches(quota.read_requests(spark, f"{tmp_dir}/landing"), max_requests=1,
                              watermark="15 minutes")
    webhook.run_to_parquet(s2, f"{tmp_dir}/sink", f"{tmp_dir}/ckpt")
    assert rows(spark.read.parquet(f"{tmp_dir}/sink"), "n_requests") == before   # late rows dropped
