"""Landed feed parsers (S5 prices, S6 bank links, S7 chain balances).

Each parser takes the landed JSON text as it arrives and produces typed rows; nothing
is collected to the driver. Bad or failed replies become rows with a status, so one
failed call never hides the others (the reference's per-wallet failure isolation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import lamports_to_sol, with_wei_to_eth
from tallyframe.schemas import (BANK_FEED, ETH_REPLY, MONEY, PRICE_COIN_IDS, PRICE_MAP,
                                SOL_REPLY)
from tallyframe.session import materialize


def price_feed(replies: DataFrame, coin_ids: list[str] | None = None) -> DataFrame:
    """``replies(reply_id, fetched_at, body)`` -> latest price per requested coin.

    The body is a map coin id -> {usd, usd_24h_change}; error bodies carry no coin and
    drop out. Ties go to the largest reply id, a bigint; a reply without a time counts as the oldest.

    Only the newest replies are parsed: those of the last hour (a filter on ``fetched_at`` that
    reaches the scan), then of the last 8, 64, ... hours, until each requested coin has
    a price. Whatever is older than all found prices can't be the latest of any coin; a coin that
    no reply carries leads to the whole feed being read. One number per step reaches the driver.
    """
    ids = list(dict.fromkeys(coin_ids or PRICE_COIN_IDS))
    micros = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    oldest, newest = replies.agg(F.min(micros), F.max(micros)).first()
    span = 3_600_000_000
    while newest is not None and newest - span > oldest:
        since = F.timestamp_micros(F.lit(newest - span)).cast(replies.schema["fetched_at"].dataType)
        latest = materialize(_latest_prices(replies.where(F.col("fetched_at") > since), ids))
        if latest.count() == len(ids):
            return latest
        span *= 8
    return _latest_prices(replies, ids)


def _latest_prices(replies: DataFrame, ids: list[str]) -> DataFrame:
    """Latest price of each coin of ``ids`` in ``replies``: a ``max_by`` over one decimal made of time and
    reply id, hash-aggregated map-side without a sort."""
    ticks = (replies
             .select("reply_id", "fetched_at", F.explode(F.from_json("body", PRICE_MAP)).alias("coin_id", "p"))
             .where(F.col("coin_id").isin(ids) & F.col("p.usd").isNotNull()))
    # Microseconds above 64 bits of reply id: ordered like the pair (fetched_at, reply_id).
    at = F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(-(1 << 62)))
    order = (at.cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(38,0)") \
        + F.col("reply_id").cast("decimal(19,0)")
    ticks = ticks.select("coin_id", "p", "fetched_at", order.cast("decimal(38,0)").alias("at"))
    return ticks.groupBy("coin_id").agg(
        F.max_by(F.col("p.usd"), F.col("at")).alias("usd"),
        F.max_by(F.col("p.usd_24h_change"), F.col("at")).alias("usd_24h_change"),
        F.max("fetched_at").alias("as_of"))


def bank_feed(replies: DataFrame) -> DataFrame:
    """``replies(link_id, user_id, body)`` -> one row per linked account, in array
    order; ``available`` falls back to 0 (not to the current balance, Q24) and a missing
    or empty currency to USD."""
    p = replies.select("link_id", "user_id", F.from_json("body", BANK_FEED).alias("r"))
    return (p.select("link_id", "user_id", F.col("r.item_id").alias("item_id"),
                     F.col("r.institution").alias("institution"),
                     F.posexplode(F.col("r.accounts")).alias("pos", "a"))
            .select("link_id", "user_id", "item_id", "institution", "pos",
                    F.col("a.name").alias("name"), F.col("a.type").alias("account_type"),
                    F.col("a.mask").alias("last4"),
                    F.coalesce(F.col("a.balances.available"), F.lit(0)).cast(MONEY).alias("balance"),
                    F.coalesce(F.nullif(F.col("a.balances.iso_currency_code"), F.lit("")), F.lit("USD")).alias("currency")))


def chain_balances(replies: DataFrame) -> DataFrame:
    """S7 + X9: ``replies(address, network, body)`` -> live balance per reply; ``fetched_at`` is
    carried along where the replies have it.

    Ethereum replies hold hex wei (converted exactly, see ``with_wei_to_eth``); Solana
    replies hold integer lamports. ``status`` is ok, failed (no result), bad_hex
    (malformed or more than 31 hex digits, reported before any arithmetic),
    overflow (does not fit DECIMAL(20,8)) or unsupported (another network).
    Each reply is parsed once; later steps read the parsed columns.
    """
    at = [c for c in ("fetched_at",) if c in replies.columns]
    parsed = replies.select(
        "address", "network", *at, F.lower("network").alias("_net"),
        F.from_json("body", ETH_REPLY)["result"].alias("_eth"),
        F.from_json("body", SOL_REPLY)["result"]["value"].alias("_sol"))
    eth = parsed.withColumn("_eth", F.when(F.col("_net") == "ethereum", F.col("_eth")))
    conv = with_wei_to_eth(eth, "_eth", "_eth_balance", "_hex_ok")
    net = F.col("_net")
    live = (F.when(net == "ethereum", F.col("_eth_balance"))
            .when(net == "solana", lamports_to_sol("_sol")))
    status = (F.when((net == "ethereum") & F.col("_eth").isNull(), "failed")
              .when((net == "ethereum") & ~F.col("_hex_ok"), "bad_hex")
              .when((net == "solana") & F.col("_sol").isNull(), "failed")
              .when(~net.isin("ethereum", "solana"), "unsupported")
              .when(live.isNull(), "overflow")
              .otherwise("ok"))
    return conv.select("address", "network", *at, live.alias("live_balance"), status.alias("status"))
