"""Literal and generated seed rows.

Literal rows are attached to each target user by exploding a literal array of
structs: a narrow, per-row operation with a fixed fan-out, never a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def literal_array(rows: list[dict]) -> F.Column:
    """A literal ARRAY<STRUCT> from dicts with the same keys (types from the values)."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def seed_for_users(users: DataFrame, rows: list[dict], user_col: str = "id") -> DataFrame:
    """One copy of the literal ``rows`` for every user of ``users``."""
    return (users.select(F.col(user_col).alias("user_id"), F.explode(literal_array(rows)).alias("s"))
            .select("user_id", "s.*"))


def series_rows(users: DataFrame, counts: DataFrame, guard: int = 20) -> DataFrame:
    """S3 + S4 + U2: for users with fewer than ``guard`` transactions (``counts(user_id,
    count)``; missing = 0), five alloc rows of 10*i (i = 1..5) and eight micro receipts
    of 5*j (j = 1..8), stacked with ``unionByName``."""
    small = (users.join(counts, "user_id", "left")
             .where(F.coalesce(F.col("count"), F.lit(0)) < guard).select("user_id"))
    alloc = small.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")).select(
        "user_id", F.lit("alloc").alias("type"), F.lit("Internal").alias("gateway"), F.lit("alloc").alias("method"),
        (F.col("i") * 10).cast("decimal(20,8)").alias("amount"),
        (F.col("i") * 10).cast("decimal(20,2)").alias("amount_usd"),
        F.concat(F.lit("Auto allocation "), F.col("i").cast("string")).alias("description"),
        F.lit("settled").alias("status"),
        F.concat(F.lit("tx_alloc_"), F.col("i").cast("string")).alias("tx_hash"),
        F.lit(0).cast("decimal(20,2)").alias("fee"))
    micro = small.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("j")).select(
        "user_id", F.lit("receive").alias("type"), F.lit("Stripe").alias("gateway"), F.lit("card").alias("method"),
        (F.col("j") * 5).cast("decimal(20,8)").alias("amount"),
        (F.col("j") * 5).cast("decimal(20,2)").alias("amount_usd"),
        F.concat(F.lit("Micro payment "), F.col("j").cast("string")).alias("description"),
        F.lit("settled").alias("status"),
        F.concat(F.lit("tx_micro_"), F.col("j").cast("string")).alias("tx_hash"),
        F.lit(0).cast("decimal(20,2)").alias("fee"))
    return alloc.unionByName(micro)
