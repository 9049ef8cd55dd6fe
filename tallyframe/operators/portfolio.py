"""Portfolio KPIs and bars per owner.

Scale notes
-----------
* Owners are few and hot (one owner may hold a third of all rows), so nothing here
  partitions a large table by owner. Every per-owner value is a partial aggregate
  (map-side combine) or a group-limited top-k, which Spark evaluates before the
  shuffle.
* J8 (compose wallets, accounts, gateways per owner) is one ``unionByName`` of narrow
  projections followed by a single ``groupBy``: one shuffle of at most one row per
  owner per map task, instead of three aggregates joined with full outer joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import usd_text
from tallyframe.functions.text import gateway_color, percent_of
from tallyframe.operators.joins import checked_broadcast
from tallyframe.operators.windows import ordered_positions
from tallyframe.schemas import MONEY, TOTAL

KPI_COLUMNS = ["user_id", "total_usd", "crypto_usd", "bank_usd", "gateway_volume_usd",
               "n_assets", "n_accounts", "n_enabled_gateways"]


def _slice(df: DataFrame, **cols) -> DataFrame:
    """Project one source to the shared (user_id, crypto, bank, gw, flags) shape."""
    shape = {"crypto": F.lit(None).cast(MONEY), "bank": F.lit(None).cast(MONEY),
             "gw": F.lit(None).cast(MONEY), "is_wallet": F.lit(0), "is_account": F.lit(0),
             "is_enabled_gw": F.lit(0)}
    shape.update(cols)
    return df.select("user_id", *[c.alias(k) for k, c in shape.items()])


def portfolio_kpis(wallets: DataFrame, accounts: DataFrame, gateways: DataFrame) -> DataFrame:
    """Per owner, the four values (total, crypto, bank, enabled gateway volume) and
    three counts (assets, linked accounts, enabled gateways). Null amounts count as 0.

    Owners appear when they have a row in any of the three sources.
    """
    enabled = F.coalesce(F.col("is_enabled"), F.lit(False))
    parts = (_slice(wallets, crypto=F.col("balance_usd"), is_wallet=F.lit(1))
             .unionByName(_slice(accounts, bank=F.col("balance"), is_account=F.lit(1)))
             .unionByName(_slice(gateways, gw=F.when(enabled, F.col("monthly_volume")),
                                 is_enabled_gw=F.when(enabled, 1).otherwise(0))))
    agg = parts.groupBy("user_id").agg(
        F.coalesce(F.sum("crypto"), F.lit(0)).cast(TOTAL).alias("crypto_usd"),
        F.coalesce(F.sum("bank"), F.lit(0)).cast(TOTAL).alias("bank_usd"),
        F.coalesce(F.sum("gw"), F.lit(0)).cast(TOTAL).alias("gateway_volume_usd"),
        F.sum("is_wallet").cast("bigint").alias("n_assets"),
        F.sum("is_account").cast("bigint").alias("n_accounts"),
        F.sum("is_enabled_gw").cast("bigint").alias("n_enabled_gateways"),
    )
    total = (F.col("crypto_usd") + F.col("bank_usd") + F.col("gateway_volume_usd")).cast(TOTAL)
    return agg.withColumn("total_usd", total).select(*KPI_COLUMNS)


def kpi_crypto(wallets: DataFrame) -> DataFrame:
    """A1: crypto value per owner (null balances count as 0) and the asset count."""
    return wallets.groupBy("user_id").agg(
        F.coalesce(F.sum("balance_usd"), F.lit(0)).cast(TOTAL).alias("crypto_usd"),
        F.count("*").alias("n_assets"))


def kpi_banks(accounts: DataFrame) -> DataFrame:
    """A2: bank balance per owner (null balances count as 0) and the account count."""
    return accounts.groupBy("user_id").agg(
        F.coalesce(F.sum("balance"), F.lit(0)).cast(TOTAL).alias("bank_usd"),
        F.count("*").alias("n_accounts"))


def kpi_gateways(gateways: DataFrame) -> DataFrame:
    """A3 + F11: monthly volume over enabled gateways per owner and their count."""
    enabled = F.coalesce(F.col("is_enabled"), F.lit(False))
    return gateways.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(enabled, F.col("monthly_volume"))), F.lit(0)).cast(TOTAL).alias("gateway_volume_usd"),
        F.count_if(enabled).alias("n_enabled_gateways"))


def portfolio_kpi_text(kpis: DataFrame) -> DataFrame:
    """KPI card texts (X2) for a ``portfolio_kpis`` result."""
    return kpis.select(
        "user_id",
        usd_text("total_usd").alias("total_text"),
        usd_text("crypto_usd").alias("crypto_text"),
        usd_text("bank_usd").alias("bank_text"),
        F.concat(usd_text("gateway_volume_usd"), F.lit("/mo")).alias("gateway_text"),
        F.concat(F.col("n_assets").cast("string"), F.lit(" digital assets")).alias("assets_text"),
        F.concat(F.col("n_accounts").cast("string"), F.lit(" linked accounts")).alias("accounts_text"),
        F.concat(F.col("n_enabled_gateways").cast("string"), F.lit(" active")).alias("gateways_text"),
    )


def bank_rank(accounts: DataFrame, top: int | None = None) -> DataFrame:
    """Position of each account in its owner's newest-first list (1-based).

    With ``top`` set, only ranks 1..top are kept; Spark then inserts a partial
    ``WindowGroupLimit`` before the shuffle, so each map task ships at most ``top``
    rows per owner and a hot owner never reaches one task whole. Without it the ranks (bigint)
    come from ``ordered_positions``, which splits hot owners.
    """
    if top is None:
        return ordered_positions(accounts, "user_id", [F.col("created_at").desc(), F.col("id").desc()], position="rank")
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return accounts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# The bar layout: positions of the dashboard's six bars. Bank bars take the owner's
# accounts by newest-first rank in the order 1st, 4th, 2nd, 3rd (Q20: labelled with the
# account's own name; the rank is kept as a column).
BANK_BAR_RANKS = [1, 4, 2, 3]


def portfolio_bars(wallets: DataFrame, accounts: DataFrame, gateways: DataFrame) -> DataFrame:
    """R2 (U1 + A9 + W4): per owner, six bars: the crypto total, one bar for each of the
    first four accounts in newest-first order (0 and an em dash when the owner has fewer
    accounts, as the dashboard shows), and the enabled gateway volume. Each bar carries
    its percent of the owner's largest bar (maximum floored at 1).
    """
    kpis = portfolio_kpis(wallets, accounts, gateways)
    # One KPI row per owner is exploded into its six bar slots (a literal array, no
    # join), so the KPI aggregate runs once for all bars. Bank slots carry the rank
    # they show and are filled from the owner's first four accounts.
    def slot(pos, label, rank, value):
        return F.struct(F.lit(pos).alias("bar_pos"), F.lit(label).cast("string").alias("slot_label"),
                        F.lit(rank).cast("int").alias("rank"), value.cast(MONEY).alias("slot_value"))

    slot_list = ([slot(1, "Crypto", None, F.col("crypto_usd"))]
                 + [slot(i + 2, None, r, F.lit(None)) for i, r in enumerate(BANK_BAR_RANKS)]
                 + [slot(6, "GW Volume", None, F.col("gateway_volume_usd"))])
    slots = kpis.select("user_id", F.explode(F.array(*slot_list)).alias("s")).select("user_id", "s.*")
    ranked = bank_rank(accounts, top=len(BANK_BAR_RANKS)).select(
        "user_id", "rank", F.col("name").alias("acct_name"), F.col("id").alias("account_id"),
        F.col("balance").alias("acct_balance"))
    is_bank = F.col("rank").isNotNull()
    bars = slots.join(ranked, ["user_id", "rank"], "left").select(
        "user_id", "bar_pos",
        F.when(is_bank, F.coalesce(F.col("acct_name"), F.lit("—"))).otherwise(F.col("slot_label")).alias("label"),
        "account_id",
        F.when(is_bank, F.coalesce(F.col("acct_balance"), F.lit(0))).otherwise(F.col("slot_value"))
        .cast(MONEY).alias("value"))
    # Six bars per owner by construction, so the owner's maximum is a window over a
    # bounded group: no join back and no second pass over the bars.
    vmax = F.greatest(F.max("value").over(Window.partitionBy("user_id")), F.lit(1).cast(MONEY))
    return (bars.withColumn("pct", percent_of("value", vmax))
            .withColumn("value_text", usd_text("value")))


def _with_percent_of_max(bars: DataFrame, value: str) -> DataFrame:
    """A9 + W4: percent of the owner's maximum (floored at 1), rounded to an integer.

    The per-owner maximum is a partial aggregate (one row per owner) joined back on
    ``user_id`` through a size-checked broadcast, so the bars are not shuffled by owner.
    """
    vmax = checked_broadcast(
        bars.groupBy("user_id").agg(F.greatest(F.max(value), F.lit(1).cast(MONEY)).alias("vmax")))
    return (bars.join(vmax, "user_id")
            .withColumn("pct", percent_of(value, "vmax"))
            .withColumn("value_text", usd_text(value))
            .drop("vmax"))


def gateway_volume_bars(gateways: DataFrame) -> DataFrame:
    """R6 (F13 + A9 + W4): gateways with positive volume, enabled or not, with percent
    of the owner's largest volume and the gateway colour (X17)."""
    active = gateways.where(F.col("monthly_volume") > 0).select(
        "user_id", F.col("id").alias("gateway_id"), "name", "monthly_volume")
    return (_with_percent_of_max(active, "monthly_volume")
            .withColumn("color", gateway_color("name")))
