"""Data-quality rules (V1-V6): the constraints PostgreSQL enforced, as Spark checks.

Every check returns violation rows ``(table_name, row_id, column_name, violation)``,
one per failed rule, so the valid rows are the input minus the flagged ids and
``valid + violating = input`` holds per table. Checks are narrow projections and
partial aggregates; none needs a shuffle except uniqueness (one ``groupBy`` on the
key, combined map-side) and orphans (an anti-join on ``user_id``; AQE's skew-join
rule splits hot owners).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.schemas import (ACCOUNT_STATUSES, LEDGER_SCHEMAS, ROLES, TX_STATUSES, TX_TYPES,
                                USER_STATUSES, WALLET_FIELD_LENGTHS)

VIOLATION_COLUMNS = ["table_name", "row_id", "column_name", "violation"]

# V1: CHECK domains per (table, column). NULL passes a CHECK.
DOMAINS = {
    ("users", "role"): ROLES,
    ("users", "status"): USER_STATUSES,
    ("bank_accounts", "status"): ACCOUNT_STATUSES,
    ("transactions", "type"): TX_TYPES,
    ("transactions", "status"): TX_STATUSES,
}
RANGES = {("allocation_rules", "percentage"): (0, 100)}

# V3: required (NOT NULL) columns per table; for user text fields a blank value counts
# as missing, as the create-user form requires.
REQUIRED = {
    "users": ["email", "password_hash", "first_name", "last_name"],
    "refresh_tokens": ["token", "expires_at"],
    "crypto_wallets": ["name", "address", "symbol", "network"],
    "bank_accounts": ["name", "bank_name", "account_type", "last4"],
    "payment_gateways": ["name"],
    "allocation_rules": ["name", "percentage"],
    "transactions": ["type", "amount", "amount_usd"],
    "audit_logs": ["action", "resource"],
}
BLANK_IS_MISSING = {"users": ["email", "first_name", "last_name"]}


def _rows(table: str, df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame | None:
    """Turn (column, violation, failed-condition) checks into violation rows."""
    if not checks:
        return None
    arr = F.array(*[F.when(cond, F.struct(F.lit(col).alias("column_name"), F.lit(code).alias("violation")))
                    for col, code, cond in checks])
    any_failed = reduce(Column.__or__, [cond for _, _, cond in checks])      # few rows reach the array
    return (df.where(any_failed).select(F.col("id").alias("row_id"), F.explode(F.array_compact(arr)).alias("v"))
            .select(F.lit(table).alias("table_name"), "row_id", "v.column_name", "v.violation"))


def _union(parts: list[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def check_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """V1 + V3: domain, range and required-field violations of every given table."""
    out = []
    for table, df in tables.items():
        checks = []
        for (t, col), allowed in DOMAINS.items():
            if t == table:
                checks.append((col, "domain", ~F.coalesce(F.col(col).isin(allowed), F.lit(True))))
        for (t, col), (lo, hi) in RANGES.items():
            if t == table:
                checks.append((col, "range", ~F.coalesce(F.col(col).between(lo, hi), F.lit(True))))
        for col in REQUIRED.get(table, []):
            missing = F.col(col).isNull()
            if col in BLANK_IS_MISSING.get(table, []):
                missing = missing | (F.trim(F.col(col)) == "")
            checks.append((col, "required", missing))
        out.append(_rows(table, df, checks))
    return _union(out)


def wallet_validation(wallets: DataFrame) -> DataFrame:
    """V2: wallet form fields must have trimmed lengths within their bounds; every
    failing field is reported (not only the first)."""
    checks = [(col, f"length {lo}-{hi}", ~F.coalesce(F.length(F.trim(F.col(col))).between(lo, hi), F.lit(False)))
              for col, (lo, hi) in WALLET_FIELD_LENGTHS.items()]
    return _rows("crypto_wallets", wallets, checks)


# V4: unique keys; NULL keys never collide.
UNIQUE_KEYS = {"users": "email", "crypto_wallets": "address", "bank_accounts": "plaid_item_id"}


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """V4: key values held by more than one row, with the number of rows."""
    out = []
    for table, key in UNIQUE_KEYS.items():
        if table not in tables:
            continue
        out.append(tables[table].where(F.col(key).isNotNull()).groupBy(key).count()
                   .where(F.col("count") > 1)
                   .select(F.lit(table).alias("table_name"), F.lit(key).alias("column_name"),
                           F.col(key).cast("string").alias("key_value"), F.col("count").alias("n_rows")))
    return _union(out)


def orphan_rows(users: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """V5: child rows whose ``user_id`` has no user (NULL foreign keys pass)."""
    ids = users.select(F.col("id").alias("user_id"))
    # One narrow union and one join: the users are shuffled (or broadcast) once, not per table.
    rows = _union([df.select(F.lit(t).alias("table_name"), F.col("id").alias("row_id"), "user_id")
                   for t, df in children.items()])
    return (rows.where(F.col("user_id").isNotNull()).join(ids, "user_id", "left_anti")
            .select("table_name", "row_id", "user_id"))


def length_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """V6: text longer than its declared VARCHAR length (from schema metadata)."""
    out = []
    for table, df in tables.items():
        checks = [(f.name, f"longer than {f.metadata['max_len']}", F.length(F.col(f.name)) > f.metadata["max_len"])
                  for f in LEDGER_SCHEMAS[table].fields if f.metadata.get("max_len")]
        out.append(_rows(table, df, checks))
    return _union(out)


def decimal_overflow(raw: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """V6 for numbers: raw values that do not fit their declared DECIMAL type
    (``try_cast`` is null while the input is not)."""
    checks = [(c, f"does not fit {t}", F.col(c).isNotNull() & F.col(c).try_cast(t).isNull())
              for c, t in columns.items()]
    return _rows("raw", raw.withColumnRenamed(id_col, "id"), checks)
