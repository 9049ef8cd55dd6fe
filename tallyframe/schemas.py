"""Ledger table schemas, payload schemas and fixed value domains.

Types follow the ledger's table definitions: money is DECIMAL everywhere (no doubles
after loading), timestamps are zone-less (TIMESTAMP_NTZ) and are cast to TIMESTAMP
only where a watermark needs event time.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(20, 2)       # USD amounts
QTY = T.DecimalType(20, 8)         # asset quantities
PCT = T.DecimalType(5, 2)          # percentages 0..100
FEE_PCT = T.DecimalType(5, 2)
FIXED_FEE = T.DecimalType(10, 2)
SHARE = T.DecimalType(26, 6)       # allocation share: scale 2 amount x scale 2 pct x 0.01
TOTAL = T.DecimalType(30, 2)       # sums of MONEY


def _f(name, dtype, nullable=True, max_len=None):
    meta = {"max_len": max_len} if max_len else {}
    return T.StructField(name, dtype, nullable, meta)


S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()

# ---------------------------------------------------------------------------
# Ledger tables. ``max_len`` metadata carries the declared VARCHAR length (V6).
# ---------------------------------------------------------------------------
USERS = T.StructType([
    _f("id", L, False), _f("email", S, False, 255), _f("password_hash", S, False, 255),
    _f("first_name", S, False, 100), _f("last_name", S, False, 100),
    _f("role", S, True, 50), _f("status", S, True, 20),
    _f("stripe_customer_id", S, True, 255), _f("last_login", TS),
    _f("created_at", TS), _f("updated_at", TS),
])

REFRESH_TOKENS = T.StructType([
    _f("id", L, False), _f("user_id", L), _f("token", S, False),
    _f("expires_at", TS, False), _f("created_at", TS),
])

CRYPTO_WALLETS = T.StructType([
    _f("id", L, False), _f("user_id", L), _f("name", S, False, 100),
    _f("address", S, False, 255), _f("symbol", S, False, 10), _f("network", S, False, 50),
    _f("balance", QTY), _f("balance_usd", MONEY), _f("is_verified", B),
    _f("created_at", TS), _f("updated_at", TS),
])

BANK_ACCOUNTS = T.StructType([
    _f("id", L, False), _f("user_id", L), _f("name", S, False, 100),
    _f("bank_name", S, False, 100), _f("account_type", S, False, 50),
    _f("last4", S, False, 4), _f("routing_number", S, True, 50), _f("balance", MONEY),
    _f("currency", S, True, 3), _f("status", S, True, 20), _f("plaid_item_id", S, True, 255),
    _f("plaid_access_token", S), _f("created_at", TS), _f("updated_at", TS),
])

PAYMENT_GATEWAYS = T.StructType([
    _f("id", L, False), _f("user_id", L), _f("name", S, False, 100),
    _f("api_key", S), _f("webhook_secret", S), _f("fee", FEE_PCT), _f("fixed_fee", FIXED_FEE),
    _f("is_enabled", B), _f("monthly_volume", MONEY), _f("transaction_count", I),
    _f("created_at", TS), _f("updated_at", TS),
])

ALLOCATION_RULES = T.StructType([
    _f("id", L, False), _f("user_id", L), _f("name", S, False, 100),
    _f("percentage", PCT, False), _f("color", S, True, 20), _f("is_locked", B),
    _f("is_auto", B), _f("created_at", TS), _f("updated_at", TS),
])

TRANSACTIONS = T.StructType([
    _f("id", L, False), _f("user_id", L), _f("type", S, False, 20),
    _f("gateway", S, True, 50), _f("method", S, True, 50), _f("amount", QTY, False),
    _f("amount_usd", MONEY, False), _f("from_address", S), _f("to_address", S),
    _f("description", S), _f("status", S, True, 20), _f("tx_hash", S, True, 255),
    _f("fee", MONEY), _f("created_at", TS), _f("updated_at", TS),
])

AUDIT_LOGS = T.StructType([
    _f("id", L, False), _f("user_id", L), _f("action", S, False, 100),
    _f("resource", S, False, 100), _f("details", S), _f("ip_address", S, True, 45),
    _f("created_at", TS),
])

LEDGER_SCHEMAS: dict[str, T.StructType] = {
    "users": USERS,
    "refresh_tokens": REFRESH_TOKENS,
    "crypto_wallets": CRYPTO_WALLETS,
    "bank_accounts": BANK_ACCOUNTS,
    "payment_gateways": PAYMENT_GATEWAYS,
    "allocation_rules": ALLOCATION_RULES,
    "transactions": TRANSACTIONS,
    "audit_logs": AUDIT_LOGS,
}

# Child tables and the foreign key to users, with the ON DELETE action.
USER_CHILDREN = {
    "refresh_tokens": "cascade",
    "crypto_wallets": "cascade",
    "bank_accounts": "cascade",
    "payment_gateways": "cascade",
    "allocation_rules": "cascade",
    "transactions": "cascade",
    "audit_logs": "set_null",
}

# ---------------------------------------------------------------------------
# Fixed values that must equal the ledger's definitions.
# ---------------------------------------------------------------------------
# CHECK domains (NULL passes a CHECK).
ROLES = ["admin", "user", "auditor"]
USER_STATUSES = ["active", "suspended", "deleted"]
ACCOUNT_STATUSES = ["pending", "verified", "error"]
TX_TYPES = ["receive", "send", "swap", "alloc", "fee"]
TX_STATUSES = ["pending", "confirmed", "settled", "failed", "reversed"]

# Column defaults applied on insert.
DEFAULTS = {
    "users": {"role": "user", "status": "active"},
    "crypto_wallets": {"balance": 0, "balance_usd": 0, "is_verified": False},
    "bank_accounts": {"balance": 0, "currency": "USD", "status": "pending"},
    "payment_gateways": {"fee": 0, "fixed_fee": 0, "is_enabled": True,
                         "monthly_volume": 0, "transaction_count": 0},
    "allocation_rules": {"color": "#3D8EF0", "is_locked": False, "is_auto": True},
    "transactions": {"status": "pending", "fee": 0},
}

# Audit action codes written by the ledger.
AUDIT_ACTIONS = ["create_user", "change_user_status", "add_rule", "delete_rule",
                 "run_allocation", "login", "link_bank", "delete_bank", "add_wallet",
                 "delete_wallet"]

# Wallet form field lengths after trim: (min, max).
WALLET_FIELD_LENGTHS = {"name": (1, 100), "address": (10, 255), "symbol": (2, 10),
                        "network": (2, 50)}

# Price-feed coin ids requested by the ledger, and the wallet symbol of each.
PRICE_COIN_IDS = ["bitcoin", "ethereum", "tether", "binancecoin", "solana", "matic-network"]
SYMBOL_TO_COIN = {"BTC": "bitcoin", "ETH": "ethereum", "USDT": "tether",
                  "BNB": "binancecoin", "SOL": "solana", "MATIC": "matic-network"}

# Dashboard colour maps (symbol -> colour, gateway name -> colour) and rule palette.
SYMBOL_COLORS = {"BTC": "var(--btc)", "ETH": "var(--eth)", "USDT": "var(--usdt)",
                 "BNB": "var(--bnb)", "SOL": "var(--sol)", "MATIC": "var(--matic)"}
GATEWAY_COLORS = {"Stripe": "#635BFF", "PayPal": "#009CDE", "Wise": "#9FE870",
                  "CashApp": "#00D64F", "Coinbase": "#3B82F6", "Revolut": "#E50914"}
RULE_PALETTE = ["#3D8EF0", "#00E5A0", "#00D4FF", "#FFB800", "#A855F7", "#F5C518", "#FF4757"]
DEFAULT_SYMBOL_COLOR = "var(--blue)"
DEFAULT_GATEWAY_COLOR = "#3D8EF0"

# The two literal allocation rule sets of the ledger's seed data:
# (set, position, name, percentage, color, is_locked, is_auto)
RULE_SETS = [
    ("A", 1, "Operations", "40.00", "#3D8EF0", True, True),
    ("A", 2, "Reserve", "20.00", "#F39C12", True, True),
    ("A", 3, "Investment", "20.00", "#2ECC71", True, True),
    ("A", 4, "Taxes", "10.00", "#E74C3C", True, True),
    ("A", 5, "Profit", "10.00", "#9B59B6", True, True),
    ("B", 1, "Operations Reserve", "15.00", "#3D8EF0", False, True),
    ("B", 2, "Partner Payouts", "30.00", "#00E5A0", False, True),
    ("B", 3, "Platform Revenue", "25.00", "#A855F7", True, True),
    ("B", 4, "Compliance Reserve", "10.00", "#FFB800", True, True),
    ("B", 5, "Growth Fund", "12.00", "#00D4FF", False, False),
    ("B", 6, "Founder Distribution", "8.00", "#F5C518", False, False),
]

# Request quota: more than 100 requests per key in a 15-minute window.
QUOTA_MAX_REQUESTS = 100
QUOTA_WINDOW = "15 minutes"

# Processor event types routed to ledger rows.
EVENT_SUCCEEDED = "payment_intent.succeeded"
EVENT_FAILED = "payment_intent.payment_failed"

# Transaction page defaults.
PAGE_LIMIT = 50
PAGE_OFFSET = 0

# Session lifetime.
SESSION_DAYS = 7

# ---------------------------------------------------------------------------
# Payload schemas of landed feeds and events.
# ---------------------------------------------------------------------------
PRICE_MAP = T.MapType(S, T.StructType([
    T.StructField("usd", T.DoubleType()), T.StructField("usd_24h_change", T.DoubleType())]))

BANK_FEED = T.StructType([
    T.StructField("item_id", S), T.StructField("institution", S),
    T.StructField("accounts", T.ArrayType(T.StructType([
        T.StructField("name", S), T.StructField("type", S), T.StructField("mask", S),
        T.StructField("balances", T.StructType([
            T.StructField("available", MONEY), T.StructField("iso_currency_code", S)])),
    ]))),
])

ETH_REPLY = T.StructType([T.StructField("result", S)])
SOL_REPLY = T.StructType([T.StructField("result", T.StructType([T.StructField("value", L)]))])

PROCESSOR_EVENT = T.StructType([
    T.StructField("type", S),
    T.StructField("data", T.StructType([T.StructField("object", T.StructType([
        T.StructField("id", S), T.StructField("amount", L), T.StructField("description", S),
        T.StructField("payment_method_types", T.ArrayType(S)),
        T.StructField("metadata", T.StructType([T.StructField("user_id", S)])),
    ]))])),
])

RUN_DETAILS = T.StructType([
    T.StructField("amount", MONEY), T.StructField("source", S),
    T.StructField("allocations", T.ArrayType(T.StructType([
        T.StructField("ruleId", L), T.StructField("ruleName", S),
        T.StructField("amount", SHARE), T.StructField("percentage", PCT)]))),
])

LOG_LINE = T.StructType([
    T.StructField("level", S), T.StructField("message", S), T.StructField("timestamp", T.TimestampType()),
])
