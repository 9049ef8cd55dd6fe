"""Landed feed payloads shaped from the driver tables.

The ledger reads three outside feeds (coin prices, bank-link replies, chain balance
replies) and one event stream (processor webhooks). The driver data has none of them,
so these functions shape rows of driver tables into the payloads' JSON text: one
landed record per source row, grouped only where a payload holds a list (three bank
accounts per link reply). They only give rows in the schema the parsing jobs expect;
all parsing, validation, conversion and joining happens in ``feeds`` and the
operators, on whatever payloads arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.sources.bindings import Ledger

# Price multipliers per coin id used to shape one price reply from one event value.
PRICE_FACTORS = {"bitcoin": 4000.0, "ethereum": 250.0, "tether": 0.04, "binancecoin": 12.0,
                 "solana": 6.0, "matic-network": 0.02}


def price_replies(led: Ledger) -> DataFrame:
    """One price reply per event (a poll); ``error`` events land an error
    body; replies polled on ``signup`` events omit tether."""
    ev = led.driver("events")
    entries = ", ".join(
        f"'{coin}', named_struct('usd', value * {factor}D, 'usd_24h_change', (value - 25.0D) / 10.0D)"
        for coin, factor in PRICE_FACTORS.items())
    body = F.expr(
        "CASE WHEN event_type = 'error' THEN '{\"error\":\"rate limited\"}' ELSE "
        f"to_json(map_filter(map({entries}), (k, v) -> k <> 'tether' OR event_type <> 'signup')) END")
    return ev.select(F.col("event_id").alias("reply_id"), F.col("ts").alias("fetched_at"),
                     body.alias("body"))


def bank_link_replies(led: Ledger) -> DataFrame:
    """One account-link reply per three consecutive customers: item id, institution,
    and the three accounts (available balance missing for every 11th customer, currency
    missing for every 4th). Some items are not linked yet, and some replies name none."""
    cust = led.driver("customer").selectExpr(
        "c_custkey div 3 AS grp", "c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment")
    acct = F.struct(
        F.expr("'Linked ' || lower(c_mktsegment)").alias("name"),
        F.expr("lower(c_mktsegment)").alias("type"),
        F.expr("lpad(CAST((c_custkey * 37) % 10000 AS STRING), 4, '0')").alias("mask"),
        F.struct(
            F.expr("CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(20,2)) END").alias("available"),
            F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'USD' END").alias("iso_currency_code"),
        ).alias("balances"))
    grouped = cust.groupBy("grp").agg(
        F.min("c_nationkey").alias("user_id"),
        F.min("c_custkey").alias("first_key"),
        F.sort_array(F.collect_list(F.struct("c_custkey", acct.alias("a")))).alias("rows"))
    body = F.to_json(F.struct(
        F.when(F.col("grp") % 10 == 3, F.concat(F.lit("new-item-"), F.col("grp").cast("string")))
        .when(F.col("grp") % 23 != 5, F.concat(F.lit("item-"), F.col("grp").cast("string"))).alias("item_id"),
        F.element_at(F.array(*[F.lit(b) for b in ["Chase", "Wise", "Mercury", "Bank of America"]]),
                     (F.col("grp") % 4 + 1).cast("int")).alias("institution"),
        F.transform("rows", lambda r: r["a"]).alias("accounts")))
    return grouped.select(F.col("grp").alias("link_id"), F.col("user_id").cast("bigint").alias("user_id"),
                          body.alias("body"))


def chain_replies(led: Ledger) -> DataFrame:
    """One balance reply per wallet on an Ethereum or Solana network (any case): hex
    wei for Ethereum, lamports for Solana, scaled from the part's size; every 11th
    wallet's call failed, every 17th holds 0, every 19th Ethereum reply carries 32 hex
    digits (too large)."""
    wallets = (led.crypto_wallets.where(F.lower("network").isin("ethereum", "solana"))
               .select("id", "address", "network"))
    part = led.driver("part").select(F.col("p_partkey").alias("id"), "p_partkey", "p_size")
    eth_hex = F.expr(
        "CASE WHEN p_partkey % 19 = 0 THEN '0x' || repeat('f', 32) "
        "WHEN p_partkey % 17 = 0 THEN '0x0' "
        "ELSE '0x' || lower(hex(p_partkey)) || lpad(lower(hex(CAST(p_size AS BIGINT) * 1000000000000000)), 16, '0') END")
    lamports = F.expr("CAST(p_size AS BIGINT) * 1000000000 + p_partkey")
    body = (F.when(F.expr("p_partkey % 11 = 0"), F.lit('{"jsonrpc":"2.0","id":1,"error":{"code":-32000}}'))
            .when(F.lower("network") == "solana",
                  F.to_json(F.struct(F.struct(lamports.alias("value")).alias("result"))))
            .otherwise(F.to_json(F.struct(eth_hex.alias("result")))))
    return wallets.join(part, "id").select("address", "network", body.alias("body"))


def processor_events(led: Ledger) -> DataFrame:
    """Processor webhook deliveries ``(type, data, event_time)``, one per event:
    purchases succeed, errors fail, other types are unhandled; amounts are integer
    cents; every 5th event lists no payment method."""
    return led.driver("events").select(
        F.expr("CASE event_type WHEN 'purchase' THEN 'payment_intent.succeeded' "
               "WHEN 'error' THEN 'payment_intent.payment_failed' "
               "ELSE 'customer.' || event_type END").alias("type"),
        F.struct(F.struct(
            F.expr("'pi_' || CAST(event_id AS STRING)").alias("id"),
            F.expr("CAST(round(value * 100) AS BIGINT)").alias("amount"),
            F.expr("'Order ' || CAST(event_id AS STRING)").alias("description"),
            F.expr("CASE WHEN event_id % 5 = 0 THEN CAST(array() AS ARRAY<STRING>) "
                   "ELSE array('card', 'link') END").alias("payment_method_types"),
            F.struct(F.col("user_id").cast("string").alias("user_id")).alias("metadata"),
        ).alias("object")).alias("data"),
        F.col("ts").cast("timestamp").alias("event_time"))


def session_events(led: Ledger) -> DataFrame:
    """Sign-in events ``(event_id, user_id, kind, token, new_token, at)``, one per event: sign-ups log in, errors log
    out, all others refresh with the token of the user's event before (every 5th with an older
    one, every 9th with none). Some users are unknown."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = led.driver("events").select("event_id", "user_id", "event_type", "ts", F.lag("event_id").over(order).alias("prev"),
                                     F.lag("event_id", 2).over(order).alias("older"))
    return ev.select(
        "event_id", F.expr("CAST(CASE WHEN user_id % 20 = 7 THEN user_id + 100000000 ELSE user_id END AS BIGINT)").alias("user_id"),
        F.expr("CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' ELSE 'refresh' END").alias("kind"),
        F.expr("CASE WHEN event_type IN ('signup', 'error') OR event_id % 9 = 0 THEN NULL "
               "ELSE 'st_' || CAST(CASE WHEN event_id % 5 = 0 THEN older ELSE prev END AS STRING) END").alias("token"),
        F.expr("'st_' || CAST(event_id AS STRING)").alias("new_token"), F.col("ts").alias("at"))


def request_log(led: Ledger) -> DataFrame:
    """API request log ``(event_id, ip, path, ts)``: one request per event, from the client
    address of its user."""
    return led.driver("events").select(
        "event_id", F.expr("'10.' || CAST(user_id % 256 AS STRING) || '.0.1'").alias("ip"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("path"),
        F.col("ts").cast("timestamp").alias("ts"))
