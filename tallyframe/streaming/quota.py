"""Request quota breaches over the request log (ST3).

The ledger's limiter allowed 100 requests per key (client IP) in a 15-minute window.
Re-aimed as a report: epoch-aligned tumbling windows (Q27) counted per key, keeping
windows with more requests than the limit. The count is a partial aggregate, so a
hot key (one IP sending a third of all requests) is combined map-side per window.
In a stream the watermark bounds the state; a window is emitted once the watermark
passes its end (append mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.schemas import QUOTA_MAX_REQUESTS, QUOTA_WINDOW

REQUEST_SCHEMA = T.StructType([T.StructField("ip", T.StringType()), T.StructField("path", T.StringType()),
                               T.StructField("ts", T.TimestampType())])
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def land_requests(requests: DataFrame, path: str, files: int | None = None) -> str:
    """Write requests ``(ip, path, ts)`` as JSON-line files."""
    df = requests.select("ip", "path", "ts")
    if files:                      # default: one file per input partition
        df = df.repartition(files)
    df.write.mode("append").option("timestampFormat", TS_FORMAT).json(path)
    return path


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).option("timestampFormat", TS_FORMAT).json(path)


def quota_breaches(requests: DataFrame, max_requests: int = QUOTA_MAX_REQUESTS,
                   window: str = QUOTA_WINDOW, watermark: str | None = None) -> DataFrame:
    """ST3: ``(ip, window_start, window_end, n_requests)`` for windows with more than
    ``max_requests`` requests, open windows included.

    By default every request counts, however late (batch input, or a stream in complete
    mode: ``webhook.run_complete_to_parquet``). ``watermark`` bounds a stream's state for
    append mode: closed windows only, and later requests are dropped."""
    r = requests.withWatermark("ts", watermark) if watermark else requests
    counts = r.groupBy(F.window("ts", window).alias("w"), "ip").agg(F.count("*").alias("n_requests"))
    return counts.where(F.col("n_requests") > max_requests).select(
        "ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_requests")
