"""One stream into several sinks: every row once, also after a crash between two sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.streaming import webhook
from tallyframe.streaming.sinks import SINKS, last_committed, read_sink, run_sinks

T0 = dt.datetime(2024, 1, 1, 12)


def delivery(k, kind="succeeded", days=0):
    kinds = {"succeeded": "payment_intent.succeeded", "failed": "payment_intent.payment_failed", "other": "customer.created", None: None}
    return (kinds[kind], f"pi_{k}", 100 * k, (T0 + dt.timedelta(days=days, seconds=k)))


def land(spark, path, deliveries):
    rows = spark.createDataFrame(deliveries, "type string, id string, amount long, event_time timestamp")
    rows.select("type", F.struct(F.struct(
        "id", "amount", F.lit("d").alias("description"), F.array(F.lit("card")).alias("payment_method_types"),
        F.struct(F.lit("7").alias("user_id")).alias("metadata")).alias("object")).alias("data"), "event_time").coalesce(1) \
        .write.mode("append").parquet(path)


BATCHES = [
    [delivery(1), delivery(2), delivery(2), delivery(3, "failed"), delivery(4, "other"), delivery(5, None)],
    [delivery(1), delivery(3), delivery(6, "failed"), delivery(6, "failed"), delivery(4, "other")],
    [delivery(3, "failed"), delivery(6, "failed"), delivery(7, "succeeded", days=40), delivery(1)],
]


def contents(spark, root):
    out = {}
    for name in SINKS:
        rows = read_sink(spark, root, name)
        key = {"unhandled": ["object_id"], "deliveries": ["object_id", "status", "outcome", "n_deliveries"]}.get(name, ["tx_hash"])
        out[name] = sorted(map(str, (tuple(r) for r in rows.select(*key).collect()))) if rows is not None else []
    return out


def run(spark, tmp, stop=None):
    stream = spark.readStream.schema(webhook.EVENT_FILE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")

    def before(batch_id, sink):
        if stop == (batch_id, sink):
            raise RuntimeError("cut off here")

    run_sinks(stream, f"{tmp}/out", f"{tmp}/check", before_sink=before)


@pytest.mark.parametrize("stop", [None, (1, "failed"), (1, "ledger"), (0, "deliveries")])
def test_every_row_once(spark, tmp_dir, stop):
    for k, rows in enumerate(BATCHES):
        land(spark, f"{tmp_dir}/in/part={k}", rows)
    if stop:
        with pytest.raises(Exception, match="cut off here"):
            run(spark, tmp_dir, stop)
        assert last_committed(spark, f"{tmp_dir}/out") == stop[0] - 1      # nothing of the batch is shown
        if stop[0]:
            assert len(contents(spark, f"{tmp_dir}/out")["settled"]) == 2
    run(spark, tmp_dir)
    got = contents(spark, f"{tmp_dir}/out")
    assert got["settled"] == ["('pi_1',)", "('pi_2',)", "('pi_3',)", "('pi_7',)"]
    assert got["failed"] == ["('pi_3',)", "('pi_6',)"]
    assert got["unhandled"] == ["('pi_4',)", "('pi_4',)", "('pi_5',)"]
    assert sum(int(r.rsplit(" ", 1)[1][:-1]) for r in got["deliveries"]) == sum(map(len, BATCHES))
    assert "('pi_2', 'settled', 'repeated', 1)" in got["deliveries"]
    run(spark, tmp_dir)                                 # nothing new: nothing changes
    assert contents(spark, f"{tmp_dir}/out") == got
