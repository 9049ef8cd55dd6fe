"""Key checks against a standing table through stored Bloom filters.

"Does this address, e-mail or item id exist?" asked for a batch of requests need not read the table's
keys. They are stored by bucket of their hash, each bucket with a Bloom filter of ``BITS_PER_KEY`` bits a
key, made when the keys are written. A request is probed against the filter of its bucket; most new
keys end there. Only the buckets of requests that remain are read, and these are verified by an exact
join, so the answer is that of ``changes.existing_keys``.

A filter is a set of 32,768-bit chunks (Spark's bitmap functions), joined to the requests' bits by
(bucket, chunk); it has about one byte and a quarter per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import materialize

BITS_PER_KEY = 10
HASHES = 4
CHUNK_BITS = 32_768


def _normal(key: Column) -> Column:
    return key.cast("string")


class KeyFilter:
    """The distinct keys of a table under ``root``, by bucket, with a filter each."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _bits(self, key: Column, size: Column) -> Column:
        """The ``HASHES`` bit numbers of a key in a filter of ``size`` bits."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(f"bit {k}"), key), size) for k in range(HASHES)])

    def build(self, table: DataFrame, key: str) -> KeyFilter:
        """Writes keys and filters; rows without a key have none. All filters have the size that the fullest
        bucket needs."""
        keys = table.select(_normal(F.col(key)).alias("key")).where("key is not null").distinct()
        keys.withColumn("bucket", self._bucket(F.col("key"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(
            f"{self.root}/keys")
        stored = self.keys()
        most = stored.groupBy("bucket").count().agg(F.max("count")).first()[0] or 1
        size = math.ceil(most * BITS_PER_KEY / CHUNK_BITS) * CHUNK_BITS
        bits = stored.select("bucket", F.explode(self._bits(F.col("key"), F.lit(size))).alias("bit"))
        chunks = bits.groupBy("bucket", (F.floor(F.col("bit") / CHUNK_BITS)).alias("chunk")).agg(
            F.bitmap_construct_agg(F.col("bit") % CHUNK_BITS).alias("bitmap"))
        chunks.withColumn("size", F.lit(size).cast("bigint")).write.parquet(f"{self.root}/filters")
        return self

    def keys(self) -> DataFrame:
        return self.spark.read.schema("key string, bucket int").parquet(f"{self.root}/keys")

    def may_exist(self, requests: DataFrame, key: str) -> DataFrame:
        """The distinct request keys (key, bucket) that the filters can't rule out."""
        filters = self.spark.read.parquet(f"{self.root}/filters")
        size = filters.agg(F.max("size")).first()[0]
        asked = requests.select(_normal(F.col(key)).alias("key")).where("key is not null").distinct()
        asked = asked.withColumn("bucket", self._bucket(F.col("key")))
        if size is None:
            return asked.limit(0)
        bits = asked.select("key", "bucket", F.explode(F.array_distinct(self._bits(F.col("key"), F.lit(size)))).alias("bit"))
        bits = bits.withColumn("chunk", F.floor(F.col("bit") / CHUNK_BITS)).withColumn("bit", F.col("bit") % CHUNK_BITS)
        byte = F.conv(F.hex(F.expr("substring(bitmap, int(bit div 8) + 1, 1)")), 16, 10).cast("int")
        is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
        hit = F.coalesce(is_set, F.lit(False))
        probed = bits.join(filters.drop("size"), ["bucket", "chunk"], "left").groupBy("key", "bucket").agg(F.min(hit).alias("all"))
        return probed.where("all").select("key", "bucket")

    def existing(self, requests: DataFrame, key: str) -> DataFrame:
        """The rows of ``requests`` whose key the table has: ``changes.existing_keys``, reading only the buckets in
        which some key passed the filter."""
        left = materialize(self.may_exist(requests, key))
        touched = [r[0] for r in left.select("bucket").distinct().collect()]            # at most ``buckets`` numbers
        found = self.keys().where(F.col("bucket").isin(touched)).join(left, ["bucket", "key"], "left_semi")
        return requests.join(found.select(F.col("key").alias("_found")), _normal(requests[key]) == F.col("_found"), "left_semi")
