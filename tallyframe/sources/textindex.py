"""Substring index over the transactions' texts.

A search for a part of an address, a description or an id reads every row. The index cuts the table
into blocks of neighbouring ids and keeps, for each three letters in a row (of lower-cased text), the
blocks that hold them: *postings* (gram, block), sorted by gram, so that a lookup reads a few row groups.
A term can only occur in a block that has all its grams. Their blocks are intersected, only those blocks
are read, and every row of them is verified by the plain search; the result is the same. Terms under
three letters read all blocks.

A gram has at most one posting per block, so postings grow with the number of blocks, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.listings import TX_COLUMNS, tx_text_search

GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct grams of a text; none of a null or short one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(GRAM))))


class TextIndex:
    """An index under ``root``: the rows by block, and the postings."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, txs: DataFrame, blocks: int | None = None) -> TextIndex:
        """Writes rows and postings; ``blocks`` defaults to the number of shuffle partitions."""
        n = blocks or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (txs.select(*TX_COLUMNS).repartitionByRange(n, "id").withColumn("block", F.spark_partition_id())
         .write.partitionBy("block").parquet(f"{self.root}/rows"))
        texts = F.array_distinct(F.concat(*[_grams(F.col(c).cast("string")) for c in ("from_address", "description", "id")]))
        postings = self.rows().select("block", F.explode(texts).alias("gram")).distinct()
        (postings.repartitionByRange(n, "gram", "block").sortWithinPartitions("gram", "block")
         .write.parquet(f"{self.root}/postings"))
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def blocks(self, term: str) -> list[int] | None:
        """The blocks that hold all grams of ``term``, at most their number; None: the index can't tell."""
        low = self.spark.range(1).select(_grams(F.lit(term))).first()[0]
        if not low:
            return None
        found = self.spark.read.parquet(f"{self.root}/postings").where(F.col("gram").isin(low))
        return [r.block for r in found.groupBy("block").count().where(F.col("count") == len(low)).collect()]

    def search(self, term: str | None, user_id=None) -> DataFrame:
        """``listings.tx_text_search`` of the indexed rows, reading only the blocks that may hold ``term``."""
        rows, among = self.rows(), self.blocks(term) if term else None
        if among is not None:
            rows = rows.where(F.col("block").isin(among))
        return tx_text_search(rows, term, user_id)
