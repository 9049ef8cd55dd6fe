"""Owner-clustered storage (S1, J8, J9): the ledger's index on ``user_id`` as bucketed tables.

Tables that are joined on their owner again and again are written once, hashed into buckets by (owner,
slot) and sorted. Spark joins and groups such tables bucket by bucket, without an exchange. An owner with
more than ``hot_rows`` rows in the *facts* would fill one bucket, so its rows are dealt over several
slots by their id, and its rows in the other tables (*sides*, few per owner) stand once in each slot.
All other owners have slot 0. The slots of hot owners are at most ``total / hot_rows`` owners and are
broadcast when the tables are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.money import share
from tallyframe.operators.allocation import PCT_TOTAL, _hundred
from tallyframe.session import materialize, scratch_path

OWNER = ["user_id", "slot"]
HOT_ROWS = 1_000_000


class Clustered:
    """Bucketed tables of one fact table and the sides it is joined with."""

    def __init__(self, spark: SparkSession, buckets: int, hot_rows: int = HOT_ROWS):
        self.spark, self.buckets, self.hot_rows = spark, buckets, hot_rows
        self.slots: DataFrame | None = None

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{name}_{uuid.uuid4().hex[:12]}"
        (df.repartition(self.buckets, *OWNER).write.bucketBy(self.buckets, *OWNER).sortBy(*OWNER)
         .option("path", scratch_path(self.spark, name)).format("parquet").saveAsTable(table))
        return self.spark.table(table)

    def fact(self, df: DataFrame, name: str, id_col: str) -> DataFrame:
        """Writes the facts; their hot owners get slots. Call it ahead of ``side``. Rows without an owner are
        one owner, who matches no side."""
        count = df.groupBy("user_id").count().where(F.col("count") > self.hot_rows)
        self.slots = materialize(count.select("user_id", F.ceil(F.col("count") / self.hot_rows).alias("_slots")))
        hot = F.broadcast(self.slots.withColumnRenamed("user_id", "_owner"))
        j = df.join(hot, F.col("user_id").eqNullSafe(F.col("_owner")), "left")
        slot = F.pmod(F.xxhash64(F.col(id_col)), F.coalesce("_slots", F.lit(1))).cast("int")
        return self._save(j.withColumn("slot", slot).drop("_owner", "_slots"), name)

    def side(self, df: DataFrame, name: str) -> DataFrame:
        """Writes rows that the facts join on their owner, once in each slot of the owner."""
        j = df.join(F.broadcast(self.slots), "user_id", "left")
        slots = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)).cast("int") - 1)
        return self._save(j.withColumn("slot", F.explode(slots)).drop("_slots"), name)


def alloc_run(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """J9 + R4 over clustered ``runs`` (fact) and ``rules`` (side): the allocations of ``allocation.alloc_run``, with the
    gate, the join to it and the join to the rules all within the buckets."""
    auto = rules.where("is_auto")
    gate = auto.groupBy(*OWNER).agg(F.sum("percentage").cast(PCT_TOTAL).alias("_total")).where(F.col("_total") == _hundred())
    fields = auto.select(*OWNER, F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "percentage")
    return (runs.join(gate, OWNER, "left_semi").join(fields, OWNER)
            .select("run_id", "user_id", "rule_id", "rule_name", "percentage", "amount",
                    share("amount", "percentage").alias("share")))
