"""Small ledger fixtures: the two seed sets and the edge rows of FIXTURES.md."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import types as T

from tallyframe.schemas import LEDGER_SCHEMAS

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def ts(minutes: int = 0) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def frame(spark, table: str, rows: list[dict]):
    """A ledger-table DataFrame from dicts; missing columns are NULL."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata)
                           for f in LEDGER_SCHEMAS[table].fields])    # edge rows may miss NOT NULL fields
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


# Seed set B (one owner, user 1): wallets, accounts, gateways, rules.
SEED_B_WALLETS = [
    ("Primary Bitcoin", "bc1qxy2kgdygjrsqtzq2n0yrf2493p83kkfjhx0wlh", "BTC", "Bitcoin", "2.4812", "158420.14"),
    ("Ethereum Wallet", "0x742d35Cc6634C0532925a3b844Bc454e4438f44e", "ETH", "Ethereum", "18.7400", "56980.22"),
    ("Tether USDT", "0xdAC17F958D2ee523a2206206994597C13D831ec7", "USDT", "Ethereum", "24500.00", "24500.00"),
    ("BNB Chain", "bnb1jxfh2g85fka8zt3uagcfyk2vcrd5es7xqegkwy", "BNB", "BSC", "45.200", "13204.80"),
    ("Solana Wallet", "9xnEbqBTGpAqLPi3CXoA8rCMzWM5k2VLtT1M2Q3K4n", "SOL", "Solana", "312.50", "46406.25"),
    ("Polygon MATIC", "0x89205A3A3b2A69De6Dbf7f01ED13B2108B2c43e7", "MATIC", "Polygon", "9840.00", "5904.00"),
]
SEED_B_ACCOUNTS = [
    ("Chase Business Checking", "JPMorgan Chase", "checking", "4821", "284750.00", "verified"),
    ("Bank of America Savings", "Bank of America", "savings", "9344", "52000.00", "verified"),
    ("Wise Multi-Currency", "Wise", "digital", "7701", "18200.00", "verified"),
    ("Mercury Business", "Mercury", "checking", "2290", "91400.00", "pending"),
]
SEED_B_GATEWAYS = [
    ("Stripe", "2.90", "0.30", True, "142800.00", 1847),
    ("PayPal", "3.49", "0.49", True, "38400.00", 412),
    ("Wise", "0.41", "0.00", True, "91200.00", 203),
    ("Cash App", "1.50", "0.00", False, "12600.00", 89),
    ("Coinbase", "1.49", "0.00", True, "67200.00", 334),
    ("Revolut", "0.00", "0.00", False, "0.00", 0),
]
SEED_B_RULES = [
    ("Operations Reserve", "15.00", False, True), ("Partner Payouts", "30.00", False, True),
    ("Platform Revenue", "25.00", True, True), ("Compliance Reserve", "10.00", True, True),
    ("Growth Fund", "12.00", False, False), ("Founder Distribution", "8.00", False, False),
]
SEED_A_RULES = [("Operations", "40.00"), ("Reserve", "20.00"), ("Investment", "20.00"),
                ("Taxes", "10.00"), ("Profit", "10.00")]


def seed_b(spark, user_id: int = 1):
    wallets = frame(spark, "crypto_wallets", [
        dict(id=i + 1, user_id=user_id, name=n, address=a, symbol=s, network=net, balance=D(b),
             balance_usd=D(u), is_verified=True, created_at=ts(i))
        for i, (n, a, s, net, b, u) in enumerate(SEED_B_WALLETS)])
    accounts = frame(spark, "bank_accounts", [
        dict(id=i + 1, user_id=user_id, name=n, bank_name=bn, account_type=t, last4=l4, balance=D(b),
             currency="USD", status=st, created_at=ts(i))
        for i, (n, bn, t, l4, b, st) in enumerate(SEED_B_ACCOUNTS)])
    gateways = frame(spark, "payment_gateways", [
        dict(id=i + 1, user_id=user_id, name=n, fee=D(f), fixed_fee=D(ff), is_enabled=e,
             monthly_volume=D(v), transaction_count=c, created_at=ts(i))
        for i, (n, f, ff, e, v, c) in enumerate(SEED_B_GATEWAYS)])
    rules = frame(spark, "allocation_rules", [
        dict(id=i + 1, user_id=user_id, name=n, percentage=D(p), is_locked=lk, is_auto=au,
             color="#3D8EF0", created_at=ts(i))
        for i, (n, p, lk, au) in enumerate(SEED_B_RULES)])
    return wallets, accounts, gateways, rules


def seed_a_rules(spark, user_id: int = 2):
    return frame(spark, "allocation_rules", [
        dict(id=100 + i, user_id=user_id, name=n, percentage=D(p), is_locked=True, is_auto=True,
             created_at=ts(i)) for i, (n, p) in enumerate(SEED_A_RULES)])
