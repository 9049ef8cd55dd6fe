"""Swap and transfer candidates (J6, J7), without materialising pairs.

The dashboard's swap and transfer forms offer every other wallet (account) of the
same owner. Listing all pairs of an owner is quadratic in the owner's size, so these
operators never build them:

* ``swap_pairs`` checks concrete swap requests ``(request_id, user_id, from_wallet_id,
  to_wallet_id)``: two equi-joins on the wallet id decide whether both wallets exist,
  belong to the requester, and differ (the same check the form's option lists encode).
* ``transfer_pairs`` gives, per account, how many other accounts of the owner it can
  transfer to and their combined balance; the same account is never its own target
  (Q12). Both values come from one per-owner partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import checked_broadcast
from tallyframe.schemas import TOTAL


def swap_pairs(wallets: DataFrame, requests: DataFrame) -> DataFrame:
    """Validate swap requests; ``status`` is ok, unknown_from, unknown_to,
    not_owner (the from-wallet is someone else's), cross_owner (the to-wallet is) or
    same_wallet."""
    w_from = wallets.select(F.col("id").alias("from_wallet_id"), F.col("user_id").alias("from_owner"),
                            F.col("symbol").alias("from_symbol"))
    w_to = wallets.select(F.col("id").alias("to_wallet_id"), F.col("user_id").alias("to_owner"),
                          F.col("symbol").alias("to_symbol"))
    j = (requests.select("request_id", "user_id", "from_wallet_id", "to_wallet_id")
         .join(w_from, "from_wallet_id", "left")
         .join(w_to, "to_wallet_id", "left"))
    status = (F.when(F.col("from_owner").isNull(), "unknown_from")
              .when(F.col("to_owner").isNull(), "unknown_to")
              .when(F.col("from_owner") != F.col("user_id"), "not_owner")
              .when(F.col("to_owner") != F.col("user_id"), "cross_owner")
              .when(F.col("from_wallet_id") == F.col("to_wallet_id"), "same_wallet")
              .otherwise("ok"))
    return j.select("request_id", "user_id", "from_wallet_id", "to_wallet_id", "from_symbol",
                    "to_symbol", status.alias("status"))


def transfer_pairs(accounts: DataFrame) -> DataFrame:
    """Per account, the number of other accounts of its owner and their total
    balance (null balances count as 0)."""
    per_owner = checked_broadcast(accounts.groupBy("user_id").agg(
        F.count("*").alias("n_accounts"),
        F.coalesce(F.sum("balance"), F.lit(0)).cast(TOTAL).alias("owner_balance")))
    return (accounts.select("id", "user_id", "name", "balance")
            .join(per_owner, "user_id")
            .select("id", "user_id", "name",
                    (F.col("n_accounts") - 1).cast("bigint").alias("n_targets"),
                    (F.col("owner_balance") - F.coalesce(F.col("balance"), F.lit(0))).cast(TOTAL)
                    .alias("targets_balance")))
