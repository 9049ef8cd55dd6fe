"""One webhook stream, several sinks, every row once (S8, ST1, ST2, ST4, S9).

A micro-batch of deliveries is split into four sinks in one pass: ``settled`` and ``failed`` ledger
rows, ``unhandled`` events, and ``deliveries``, an audit row for each delivery with what became of it.

Once and only once, whatever fails:

* Each sink writes a batch into a folder of its own, ``<sink>/batch=<id>``, and overwrites it. A batch that
  is run again after a crash has the same rows (the stream's offset log says so) and the same id, so it
  replaces what the crash left.
* When all sinks of a batch are written, its id goes into the ledger. ``read_sink`` shows batches of
  the ledger only, so readers see a batch in all sinks or in none.
* A redelivery is found by joining the batch against the rows of earlier batches, cut by partition to
  ``days`` around the batch's own dates, instead of by state that grows for ever. The join never
  looks at the batch's own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.streaming.webhook import HANDLED, route_events

SINKS = ("settled", "failed", "unhandled", "deliveries")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def last_committed(spark: SparkSession, root: str) -> int:
    ledger = _read(spark, f"{root}/ledger")
    return -1 if ledger is None else int(ledger.agg(F.max("batch")).first()[0])


def read_sink(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The committed rows of a sink; None as long as there is none."""
    rows = _read(spark, f"{root}/{name}")
    return None if rows is None else rows.where(F.col("batch") <= last_committed(spark, root)).drop("batch")


def _earlier(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, days: int) -> DataFrame | None:
    """Keys stored by earlier batches on dates within ``days`` of the batch's."""
    low, high = batch.where(F.col("type").isin(HANDLED)).agg(F.min("dt"), F.max("dt")).first()
    found = [_read(spark, f"{root}/{name}") for name in ("settled", "failed")]
    found = [f.where((F.col("batch") < batch_id) & F.col("dt").between(F.date_sub(F.lit(low), days), F.date_add(F.lit(high), days)))
             .select("tx_hash", "status") for f in found if f is not None and low is not None]
    return None if not found else found[0] if len(found) == 1 else found[0].unionByName(found[1])


def split(events: DataFrame, earlier: DataFrame | None) -> dict[str, DataFrame]:
    """The rows of each sink for deliveries ``(type, data, event_time, dt)`` of one batch. The first
    delivery of a payment and outcome in the batch, by time, counts, unless ``earlier`` has it."""
    handled = events.where(F.col("type").isin(HANDLED))
    routed = route_events(handled).withColumn("dt", F.to_date("event_time"))
    keys = ["tx_hash", "status"]
    payload = [c for c in routed.columns if c not in keys]
    once = routed.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct("event_time", "amount", "description")).alias("row"),
                                     F.count("*").alias("n")).select(*keys, "row.*", "n")
    if earlier is not None:
        known = earlier.distinct().withColumn("_known", F.lit(True))
        once = once.join(known, keys, "left")
    else:
        once = once.withColumn("_known", F.lit(None).cast("boolean"))
    fresh = once.where("_known is null").drop("_known", "n")
    unhandled = events.where(~F.col("type").isin(HANDLED) | F.col("type").isNull()).select(
        "type", F.col("data.object.id").alias("object_id"), "event_time", "dt")
    repeats = F.col("n") - F.when(F.col("_known").isNull(), 1).otherwise(0)
    deliveries = once.select(
        "dt", "tx_hash", "status", F.explode(F.array(
            F.struct(F.lit("stored").alias("outcome"), (F.col("n") - repeats).alias("n_deliveries")),
            F.struct(F.lit("repeated").alias("outcome"), repeats.alias("n_deliveries")))).alias("o"))
    deliveries = deliveries.select("dt", F.col("tx_hash").alias("object_id"), "status", "o.*").where("n_deliveries > 0")
    ignored = unhandled.groupBy("dt", "object_id").agg(F.count("*").alias("n_deliveries")).select(
        "dt", "object_id", F.lit(None).cast("string").alias("status"), F.lit("unhandled").alias("outcome"), "n_deliveries")
    return {"settled": fresh.where("status = 'settled'"), "failed": fresh.where("status = 'failed'"),
            "unhandled": unhandled, "deliveries": deliveries.unionByName(ignored)}


def batch_writer(root: str, days: int = 30, before_sink: Callable[[int, str], None] | None = None):
    """The ``foreachBatch`` function. ``before_sink(batch id, sink)`` is called ahead of each write (and with
    ``ledger``), so that tests can stop between two."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= last_committed(spark, root):
            return                                      # written whole by the run that was cut off
        batch = batch.withColumn("dt", F.to_date("event_time")).persist()
        try:
            parts = split(batch, _earlier(spark, root, batch, batch_id, days))
            for name in SINKS:
                if before_sink:
                    before_sink(batch_id, name)
                parts[name].write.mode("overwrite").partitionBy("dt").parquet(f"{root}/{name}/batch={batch_id}")
            if before_sink:
                before_sink(batch_id, "ledger")
            spark.range(batch_id, batch_id + 1, numPartitions=1).select(F.col("id").alias("batch")).write.mode(
                "overwrite").parquet(f"{root}/ledger/commit={batch_id}")
        finally:
            batch.unpersist()

    return write


def run_sinks(events: DataFrame, root: str, checkpoint: str, days: int = 30, every: str | None = None,
              before_sink: Callable[[int, str], None] | None = None):
    """Runs the stream ``events`` (``webhook.read_events``) into the sinks under ``root``: everything available, or with
    ``every`` (e.g. ``"1 minute"``) on that trigger, returning the started query."""
    w = events.writeStream.foreachBatch(batch_writer(root, days, before_sink)).option("checkpointLocation", checkpoint)
    if every:
        return w.trigger(processingTime=every).start()
    w.trigger(availableNow=True).start().awaitTermination()
    return None
