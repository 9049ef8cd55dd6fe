"""Processor webhook ingestion with Structured Streaming (S8, ST1, ST2, ST4).

Deliveries land as JSON lines (the event object plus its ``event_time``) in a landing
folder; a file-source stream parses them with the declared schema, routes them to
ledger rows and appends the rows to a Parquet sink. The transforms are plain
DataFrame functions, so the same code runs on a batch DataFrame (used by the tests to
compare the stream with the batch result).

State: only the de-duplicating variant holds state, bounded by the watermark: a
redelivery later than the watermark passes again (documented at-least-once limit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.money import from_cents
from tallyframe.functions.text import first_element
from tallyframe.schemas import EVENT_FAILED, EVENT_SUCCEEDED, PROCESSOR_EVENT, QTY

EVENT_FILE_SCHEMA = T.StructType(PROCESSOR_EVENT.fields + [T.StructField("event_time", T.TimestampType())])
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
HANDLED = [EVENT_SUCCEEDED, EVENT_FAILED]


def land_events(events: DataFrame, path: str, files: int | None = None) -> str:
    """Write event structs ``(type, data, event_time)`` as JSON-line files."""
    df = events.select("type", "data", "event_time")
    if files:                      # default: one file per input partition
        df = df.repartition(files)
    df.write.mode("append").option("timestampFormat", TS_FORMAT).json(path)
    return path


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The landing folder as a stream with the declared event schema."""
    r = spark.readStream.schema(EVENT_FILE_SCHEMA).option("timestampFormat", TS_FORMAT)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


def route_events(events: DataFrame) -> DataFrame:
    """ST1: succeeded -> settled receive row, failed -> failed receive row; amounts
    are integer cents / 100 for both amount columns; method = first listed (null when
    none, X21)."""
    o = F.col("data.object")
    return events.where(F.col("type").isin(HANDLED)).select(
        o["metadata"]["user_id"].cast("bigint").alias("user_id"),
        F.lit("receive").alias("type"), F.lit("Stripe").alias("gateway"),
        first_element(o["payment_method_types"]).alias("method"),
        from_cents(o["amount"]).cast(QTY).alias("amount"),
        from_cents(o["amount"]).alias("amount_usd"),
        o["description"].alias("description"),
        F.when(F.col("type") == EVENT_SUCCEEDED, "settled").otherwise("failed").alias("status"),
        o["id"].alias("tx_hash"),
        F.col("event_time"))


def unhandled_counts(events: DataFrame) -> DataFrame:
    """ST2: events of types the ledger does not handle, counted by type."""
    return (events.where(~F.col("type").isin(HANDLED) | F.col("type").isNull())
            .groupBy("type").agg(F.count("*").alias("n_events")))


def dedupe(rows: DataFrame, watermark: str | None = None) -> DataFrame:
    """ST4: drop redelivered events (same ``tx_hash``).

    By default every first delivery is kept, however late it comes and however files fall
    into micro-batches; the state holds one key per event (in RocksDB under the cluster
    profile). ``watermark`` bounds that state, at the price of dropping events that come
    later than it, first deliveries too."""
    if watermark is None:
        return rows.dropDuplicates(["tx_hash"])
    return rows.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["tx_hash"])


def run_to_parquet(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                   every: str | None = None):
    """Run a stream into Parquet with its checkpoint in ``checkpoint``.

    By default it processes everything available (``availableNow``) and returns when
    done; with ``every`` (e.g. ``"1 minute"``) it runs continuously on that
    processing-time trigger and the started query is returned."""
    w = (stream.writeStream.format("parquet").outputMode(mode)
         .option("path", sink).option("checkpointLocation", checkpoint))
    if every:
        return w.trigger(processingTime=every).start()
    w.trigger(availableNow=True).start().awaitTermination()
    return None


def read_current(spark: SparkSession, sink: str) -> DataFrame:
    """The newest whole result of ``run_complete_to_parquet``."""
    newest = spark.read.parquet(f"{sink}/ledger").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{sink}/results/{newest}")


def run_complete_to_parquet(stream: DataFrame, sink: str, checkpoint: str, every: str | None = None):
    """Run an aggregating stream in complete mode; each micro-batch's full result is written into a folder of
    its own and becomes the current one when it is whole (``read_current``), so that readers never find a
    result that is being replaced. ``every`` as in ``run_to_parquet``."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/results/{epoch}")
        batch.sparkSession.range(epoch, epoch + 1, numPartitions=1).select(F.col("id").alias("batch")).write.mode(
            "overwrite").parquet(f"{sink}/ledger/commit={epoch}")

    w = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    if every:
        return w.trigger(processingTime=every).start()
    w.trigger(availableNow=True).start().awaitTermination()
    return None
