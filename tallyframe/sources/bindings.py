"""Binding of the driver's tables to the ledger model.

The ledger tables do not exist in the driver data, so each one is a *view expression*
over driver tables: a FROM clause (one table, optionally joined) plus one SQL expression
per ledger column. The same text builds the Spark DataFrame (``selectExpr``) and the
DuckDB oracle CTE, so both engines see identical ledger rows. Where the two dialects
spell something differently, a column carries a ``(spark, duckdb)`` pair.

Owners are the 25 nations (``user_id = n_nationkey``) for wallets, accounts, gateways
and transactions; users, allocation rules, sessions and audit rows belong to
customers/event users. Row counts of every ledger table scale with the driver's sf.
The bindings only shape rows into the ledger schema; no query result depends on how
they are built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schemas import RULE_SETS

Expr = str | tuple[str, str]


@dataclass(frozen=True)
class Binding:
    base: str                                   # driver table (or literal relation name)
    columns: tuple[tuple[str, Expr], ...]
    joins: tuple[tuple[str, str], ...] = ()     # (driver table, join condition)
    where: str | None = None

    def expr(self, col: Expr, dialect: str) -> str:
        if isinstance(col, tuple):
            return col[0] if dialect == "spark" else col[1]
        return col

    def select_list(self, dialect: str) -> list[str]:
        return [f"{self.expr(e, dialect)} AS {name}" for name, e in self.columns]


def _ts(spark_base: str, unit: str, amount: str) -> tuple[str, str]:
    """Timestamp offset written in both dialects."""
    return (f"timestampadd({unit}, {amount}, TIMESTAMP_NTZ'{spark_base}')",
            f"TIMESTAMP '{spark_base}' + to_{unit.lower()}s({amount})")


def _ts_div(spark_base: str, key: str, div: int) -> tuple[str, str]:
    """Timestamp offset by ``key div div`` minutes (integer division differs by dialect)."""
    return (f"timestampadd(MINUTE, {key} div {div}, TIMESTAMP_NTZ'{spark_base}')",
            f"TIMESTAMP '{spark_base}' + to_minutes({key} // {div})")


def _case(expr: str, values: list[str], quote: bool = True) -> str:
    """CASE <expr> WHEN 0 THEN v0 WHEN 1 THEN v1 ... ELSE v_last END."""
    parts = []
    for i, v in enumerate(values[:-1]):
        lit = f"'{v}'" if quote else v
        parts.append(f"WHEN {i} THEN {lit}")
    last = f"'{values[-1]}'" if quote else values[-1]
    return f"CASE {expr} " + " ".join(parts) + f" ELSE {last} END"


# Fixed label lists used by the bindings (names as they appear in the ledger's seeds).
BANK_NAMES = ["JPMorgan Chase", "Bank of America", "Wise", "Mercury", "First Demo Bank"]
ACCOUNT_NAMES = ["Chase Business Checking", "Bank of America Savings", "Wise Multi-Currency",
                 "Mercury Business", "Main Checking"]
GATEWAY_NAMES = ["Stripe", "PayPal", "Wise", "Cash App", "Coinbase", "Revolut"]
GATEWAY_FEES = ["2.90", "3.49", "0.41", "1.50", "1.49", "0.00"]
GATEWAY_FIXED_FEES = ["0.30", "0.49", "0.00", "0.00", "0.00", "0.00"]
WALLET_SYMBOLS = ["BTC", "ETH", "USDT", "BNB", "SOL", "MATIC"]
WALLET_NETWORKS = ["Bitcoin", "Ethereum", "ETHEREUM", "BSC", "Solana", "Polygon"]
TX_GATEWAYS = ["Stripe", "PayPal", "Wise", "Crypto", "Internal", "Coinbase"]
TX_METHODS = ["card", "ACH", "wire", "Bank"]


def rule_sets_sql() -> str:
    """The literal rule sets as an inline VALUES relation (same text in both dialects)."""
    rows = ", ".join(
        f"('{s}', {p}, '{n}', CAST({pct} AS DECIMAL(5,2)), '{c}', {str(lk).upper()}, {str(au).upper()})"
        for s, p, n, pct, c, lk, au in RULE_SETS)
    return (f"(SELECT * FROM (VALUES {rows}) AS rs(rule_set, pos, rule_name, rule_pct, "
            f"rule_color, rule_locked, rule_auto))")


WALLET_SYMBOL = _case("p_partkey % 6", WALLET_SYMBOLS)
ETH_LIKE_ADDRESS = "'0x' || lpad(lower(hex(p_partkey * 7919)), 40, '0')"

BINDINGS: dict[str, Binding] = {
    "users": Binding("customer", (
        ("id", "CAST(c_custkey AS BIGINT)"),
        ("email", "'  ' || upper(c_name) || '@EXAMPLE.COM '"),
        ("password_hash", "'not-a-hash'"),
        ("first_name", "CASE WHEN c_custkey % 211 <> 5 THEN split_part(c_name, '#', 1) END"),
        ("last_name", "CASE WHEN c_custkey % 223 = 7 THEN '  ' ELSE split_part(c_name, '#', 2) END"),
        ("role", "CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'auditor' "
                 "WHEN 'HOUSEHOLD' THEN 'owner' ELSE 'user' END"),
        ("status", "CASE WHEN c_custkey % 101 = 3 THEN 'locked' WHEN c_acctbal < 0 THEN 'suspended' "
                   "WHEN c_acctbal < 100 THEN NULL ELSE 'active' END"),
        ("stripe_customer_id", "CASE WHEN c_custkey % 4 = 0 THEN 'cus_' || CAST(c_custkey AS STRING) END"),
        ("last_login", ("CAST(NULL AS TIMESTAMP_NTZ)", "CAST(NULL AS TIMESTAMP)")),
        ("created_at", _ts("2023-01-01 00:00:00", "MINUTE", "c_custkey")),
        ("updated_at", _ts("2023-01-01 00:00:00", "MINUTE", "c_custkey")),
    )),
    "refresh_tokens": Binding("events", (
        ("id", "CAST(event_id AS BIGINT)"),
        ("user_id", "CAST(user_id AS BIGINT)"),
        ("token", "'rt_' || CAST(event_id AS STRING)"),
        ("expires_at", "ts + INTERVAL '7' DAY"),
        ("created_at", "ts"),
    ), where="event_type = 'signup'"),
    "crypto_wallets": Binding("part", (
        ("id", "CAST(p_partkey AS BIGINT)"),
        ("user_id", "CAST(p_partkey % 25 AS BIGINT)"),
        ("name", "CASE WHEN p_partkey % 409 = 10 THEN repeat('long name ', 12) WHEN p_partkey % 401 <> 9 THEN p_name END"),
        ("address", "CASE WHEN p_partkey % 50 = 7 THEN 'w' || CAST(p_partkey AS STRING) "
                    "WHEN p_partkey % 6 = 0 THEN 'bc1q' || lpad(lower(hex(p_partkey * 7919)), 38, '0') "
                    "WHEN p_partkey % 6 = 4 THEN 'So1' || lpad(upper(hex(p_partkey * 7919)), 41, 'x') "
                    f"ELSE {ETH_LIKE_ADDRESS} END"),
        ("symbol", WALLET_SYMBOL),
        ("network", _case("p_partkey % 6", WALLET_NETWORKS)),
        ("balance", "CAST(p_size AS DECIMAL(20,8))"),
        ("balance_usd", "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(20,2)) END"),
        ("is_verified", "p_size % 2 = 0"),
        ("created_at", _ts_div("2023-06-01 00:00:00", "p_partkey", 3)),
        ("updated_at", _ts_div("2023-06-01 00:00:00", "p_partkey", 3)),
    )),
    "bank_accounts": Binding("customer", (
        ("id", "CAST(c_custkey AS BIGINT)"),
        ("user_id", "CAST(c_nationkey AS BIGINT)"),
        ("name", _case("c_custkey % 5", ACCOUNT_NAMES)),
        ("bank_name", _case("c_custkey % 5", BANK_NAMES)),
        ("account_type", "lower(c_mktsegment)"),
        ("last4", "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"),
        ("routing_number", "CASE WHEN c_custkey % 2 = 0 THEN '111000025' END"),
        ("balance", "CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(20,2)) END"),
        ("currency", "'USD'"),
        ("status", "CASE WHEN c_custkey % 103 = 5 THEN 'closed' WHEN c_custkey % 3 = 0 THEN 'verified' "
                   "WHEN c_custkey % 3 = 1 THEN 'pending' ELSE 'error' END"),
        ("plaid_item_id", ("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'item-' || CAST(c_custkey div 2 AS STRING) END",
                           "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'item-' || CAST(c_custkey // 2 AS STRING) END")),
        ("plaid_access_token", "'access-' || CAST(c_custkey AS STRING)"),
        # ties in groups of four accounts: the id tie-break is required
        ("created_at", _ts_div("2023-02-01 00:00:00", "c_custkey", 4)),
        ("updated_at", _ts_div("2023-02-01 00:00:00", "c_custkey", 4)),
    )),
    "payment_gateways": Binding("supplier", (
        ("id", "CAST(s_suppkey AS BIGINT)"),
        ("user_id", "CAST(s_nationkey AS BIGINT)"),
        ("name", _case("s_suppkey % 6", GATEWAY_NAMES)),
        ("api_key", "'sk_' || CAST(s_suppkey AS STRING)"),
        ("webhook_secret", "'whsec_' || CAST(s_suppkey AS STRING)"),
        ("fee", f"CAST({_case('s_suppkey % 6', GATEWAY_FEES, quote=False)} AS DECIMAL(5,2))"),
        ("fixed_fee", f"CAST({_case('s_suppkey % 6', GATEWAY_FIXED_FEES, quote=False)} AS DECIMAL(10,2))"),
        ("is_enabled", "s_suppkey % 3 <> 0"),
        ("monthly_volume", "CASE WHEN s_suppkey % 41 = 0 THEN NULL ELSE CAST(s_acctbal AS DECIMAL(20,2)) END"),
        ("transaction_count", "CAST(s_suppkey % 2000 AS INT)"),
        ("created_at", _ts("2023-03-01 00:00:00", "MINUTE", "s_suppkey")),
        ("updated_at", _ts("2023-03-01 00:00:00", "MINUTE", "s_suppkey")),
    )),
    "allocation_rules": Binding("customer", (
        ("id", "CAST(c_custkey * 10 + pos AS BIGINT)"),
        ("user_id", "CAST(c_custkey AS BIGINT)"),
        ("name", "CASE WHEN c_custkey % 311 = 8 AND pos = 2 THEN NULL ELSE rule_name END"),
        # owners on target, below it and over it, and some percentages out of range
        ("percentage", "CAST(CASE WHEN c_custkey % 307 = 6 AND pos = 5 THEN 120 WHEN c_custkey % 9 = 4 AND pos = 1 "
                       "THEN rule_pct - 12.50 WHEN c_custkey % 9 = 7 AND pos = 1 THEN rule_pct + 5 ELSE rule_pct END AS DECIMAL(5,2))"),
        ("color", "rule_color"),
        ("is_locked", "rule_locked"),
        ("is_auto", "rule_auto"),
        ("created_at", _ts("2023-09-01 00:00:00", "MINUTE", "pos")),
        ("updated_at", _ts("2023-09-01 00:00:00", "MINUTE", "pos")),
    ), joins=(("@rule_sets", "rule_set = CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END"),)),
    "transactions": Binding("orders", (
        ("id", "CAST(o_orderkey AS BIGINT)"),
        ("user_id", "CAST(c_nationkey AS BIGINT)"),
        ("type", "CASE WHEN o_orderkey % 1009 = 3 THEN 'refund' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'receive' WHEN '2-HIGH' THEN 'send' "
                 "WHEN '3-MEDIUM' THEN 'swap' WHEN '4-NOT SPECIFIED' THEN 'alloc' ELSE 'fee' END END"),
        ("gateway", _case("o_orderkey % 6", TX_GATEWAYS)),
        ("method", "CASE o_orderkey % 5 WHEN 0 THEN 'card' WHEN 1 THEN 'ACH' WHEN 2 THEN 'wire' "
                   "WHEN 3 THEN 'Bank' ELSE NULL END"),
        ("amount", "CAST(o_totalprice AS DECIMAL(20,8))"),
        ("amount_usd", "CAST(o_totalprice AS DECIMAL(20,2))"),
        ("from_address", "CASE WHEN o_orderkey % 3 = 0 THEN 'acct_' || CAST(o_custkey AS STRING) END"),
        ("to_address", "CASE WHEN o_orderkey % 3 = 1 THEN 'acct_' || CAST(o_custkey AS STRING) END"),
        ("description", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE "
                        "c_name || ' order ' || CAST(o_orderkey AS STRING) END"),
        ("status", "CASE WHEN o_orderkey % 1013 = 4 THEN 'void' WHEN o_orderstatus = 'F' THEN 'settled' "
                   "WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'confirmed' END"),
        ("tx_hash", "'tx_' || CAST(o_orderkey AS STRING)"),
        ("fee", "CAST(CAST(o_totalprice AS DECIMAL(20,2)) * CAST(0.0029 AS DECIMAL(5,4)) AS DECIMAL(20,2))"),
        ("created_at", "o_orderdate"),
        ("updated_at", "o_orderdate"),
    ), joins=(("customer", "o_custkey = c_custkey"),)),
    "audit_logs": Binding("events", (
        ("id", "CAST(event_id AS BIGINT)"),
        ("user_id", "CAST(CASE WHEN event_id % 499 = 11 THEN 9000000000 ELSE user_id END AS BIGINT)"),
        ("action", "event_type"),
        ("resource", "'events'"),
        ("details", "props"),
        ("ip_address", "'10.' || CAST(user_id % 256 AS STRING) || '.0.1'"),
        ("created_at", "ts"),
    )),
}

LEDGER_TABLES = tuple(BINDINGS)


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "@rule_sets":
        return spark.sql(f"SELECT * FROM {rule_sets_sql()}")
    return read_driver(spark, sf_dir, name)


def ledger(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One ledger table as a lazy DataFrame with the ledger schema."""
    from tallyframe.schemas import LEDGER_SCHEMAS

    b = BINDINGS[name]
    df = _relation(spark, sf_dir, b.base)
    if b.where:
        df = df.where(b.where)
    for other, cond in b.joins:
        df = df.join(_relation(spark, sf_dir, other), F.expr(cond), "inner")
    out = df.selectExpr(*b.select_list("spark"))
    schema = LEDGER_SCHEMAS[name]
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


class Ledger:
    """Lazy accessor for all ledger tables of one driver directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BINDINGS:
            return ledger(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def driver(self, name: str) -> DataFrame:
        return read_driver(self.spark, self.sf_dir, name)


# ---------------------------------------------------------------------------
# DuckDB side (oracle)
# ---------------------------------------------------------------------------
_DUCK_TYPES = {"timestamp_ntz": "TIMESTAMP", "string": "VARCHAR", "bigint": "BIGINT",
               "int": "INTEGER", "boolean": "BOOLEAN"}


def duck_type(spark_type: str) -> str:
    return _DUCK_TYPES.get(spark_type, spark_type.upper())


def duck_cte(name: str) -> str:
    from tallyframe.schemas import LEDGER_SCHEMAS

    b = BINDINGS[name]
    rel = {"@rule_sets": rule_sets_sql()}
    src = rel.get(b.base, b.base)
    for other, cond in b.joins:
        src += f" JOIN {rel.get(other, other)} ON {cond}"
    inner = f"SELECT {', '.join(b.select_list('duckdb'))} FROM {src}"
    if b.where:
        inner += f" WHERE {b.where}"
    casts = ", ".join(f"CAST({f.name} AS {duck_type(f.dataType.simpleString())}) AS {f.name}"
                      for f in LEDGER_SCHEMAS[name].fields)
    return f"{name} AS (SELECT {casts} FROM ({inner}) AS b)"


def with_ledger(sql: str, *tables: str, extra_ctes: tuple[str, ...] = ()) -> str:
    """Prefix ``sql`` with CTEs for the named ledger tables (DuckDB dialect)."""
    ctes = [duck_cte(t) for t in tables] + list(extra_ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
