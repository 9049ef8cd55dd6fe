"""Registered queries: every operator of the inventory, run over the bound ledger.

Each builder reads whole driver tables through the bindings; each oracle is an
independent DuckDB formulation of the same result over the same bindings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import portfolio
from tallyframe.plans.registry import REGISTRY, query
from tallyframe.sources.bindings import Ledger, duck_type, with_ledger


def L(spark: SparkSession, sf_dir: str) -> Ledger:
    # Ledger timestamps are zone-less; stream windows and text formats are defined in UTC.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Ledger(spark, sf_dir)


# ---------------------------------------------------------------------------
# Portfolio
# ---------------------------------------------------------------------------
_KPI_BODY = """
SELECT coalesce(w.user_id, b.user_id, g.user_id) AS user_id,
       CAST(coalesce(w.crypto, 0) + coalesce(b.bank, 0) + coalesce(g.gw, 0) AS DECIMAL(30,2)) AS total_usd,
       CAST(coalesce(w.crypto, 0) AS DECIMAL(30,2)) AS crypto_usd,
       CAST(coalesce(b.bank, 0) AS DECIMAL(30,2)) AS bank_usd,
       CAST(coalesce(g.gw, 0) AS DECIMAL(30,2)) AS gateway_volume_usd,
       CAST(coalesce(w.n, 0) AS BIGINT) AS n_assets,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n_accounts,
       CAST(coalesce(g.n_enabled, 0) AS BIGINT) AS n_enabled_gateways
FROM (SELECT user_id, sum(balance_usd) AS crypto, count(*) AS n FROM crypto_wallets GROUP BY user_id) w
FULL OUTER JOIN (SELECT user_id, sum(balance) AS bank, count(*) AS n FROM bank_accounts GROUP BY user_id) b
  ON w.user_id = b.user_id
FULL OUTER JOIN (SELECT user_id, sum(CASE WHEN is_enabled THEN monthly_volume END) AS gw,
                        count(*) FILTER (WHERE is_enabled) AS n_enabled
                 FROM payment_gateways GROUP BY user_id) g
  ON coalesce(w.user_id, b.user_id) = g.user_id
"""
_KPI_SQL = with_ledger(_KPI_BODY, "crypto_wallets", "bank_accounts", "payment_gateways")


@query("portfolio_kpis", oracle=_KPI_SQL)
def q_portfolio_kpis(spark, sf_dir):
    """R1 (A1-A5, J8): per-owner portfolio total, crypto, bank and enabled gateway
    volume, with asset, account and enabled-gateway counts."""
    led = L(spark, sf_dir)
    return portfolio.portfolio_kpis(led.crypto_wallets, led.bank_accounts, led.payment_gateways)


@query("kpi_crypto", oracle=with_ledger("""
SELECT user_id, CAST(coalesce(sum(balance_usd), 0) AS DECIMAL(30,2)) AS crypto_usd, count(*) AS n_assets
FROM crypto_wallets GROUP BY user_id""", "crypto_wallets"))
def q_kpi_crypto(spark, sf_dir):
    """A1: every owner's crypto total (null balances as 0) and asset count."""
    return portfolio.kpi_crypto(L(spark, sf_dir).crypto_wallets)


@query("kpi_banks", oracle=with_ledger("""
SELECT user_id, CAST(coalesce(sum(balance), 0) AS DECIMAL(30,2)) AS bank_usd, count(*) AS n_accounts
FROM bank_accounts GROUP BY user_id""", "bank_accounts"))
def q_kpi_banks(spark, sf_dir):
    """A2: every owner's bank total (null balances as 0) and linked-account count."""
    return portfolio.kpi_banks(L(spark, sf_dir).bank_accounts)


@query("kpi_gateways", oracle=with_ledger("""
SELECT user_id, CAST(coalesce(sum(CASE WHEN is_enabled THEN monthly_volume END), 0) AS DECIMAL(30,2)) AS gateway_volume_usd,
       count(*) FILTER (WHERE is_enabled) AS n_enabled_gateways
FROM payment_gateways GROUP BY user_id""", "payment_gateways"))
def q_kpi_gateways(spark, sf_dir):
    """A3 + F11: every owner's monthly volume over enabled gateways and their count."""
    return portfolio.kpi_gateways(L(spark, sf_dir).payment_gateways)


# ---------------------------------------------------------------------------
# DuckDB spellings of the display helpers (oracle side only)
# ---------------------------------------------------------------------------
def usd_sql(x: str) -> str:
    return f"('$' || printf('%,.2f', round(CAST(coalesce({x}, 0) AS DECIMAL(38,2)), 2)))"


def fixed_sql(x: str, d: int) -> str:
    return f"CAST(CAST(round(CAST(coalesce({x}, 0) AS DECIMAL(20,8)), {d}) AS DECIMAL(28,{d})) AS VARCHAR)"


def short_sql(x: str) -> str:
    return f"(CASE WHEN length({x}) > 16 THEN left({x}, 8) || '…' || right({x}, 6) ELSE {x} END)"


def case_map_sql(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE '{default}' END)"


STATUS_COLOR_SQL = ("(CASE WHEN status IN ('active','confirmed','settled','verified') THEN 'green' "
                    "WHEN status IN ('processing','pending') THEN 'amber' "
                    "WHEN status IN ('inactive','failed','error') THEN 'red' ELSE 'gray' END)")
TYPE_COLOR_SQL = ("(CASE type WHEN 'receive' THEN 'green' WHEN 'send' THEN 'red' WHEN 'swap' "
                  "THEN 'purple' WHEN 'alloc' THEN 'amber' ELSE 'gray' END)")
TX_COLS_SQL = ("id, user_id, type, gateway, method, amount, amount_usd, from_address, to_address, "
               "description, status, tx_hash, fee, created_at")


# ---------------------------------------------------------------------------
# Listings (F1-F5, F9, F17, X3, X7, X12, X14-X18)
# ---------------------------------------------------------------------------
from tallyframe.operators import listings  # noqa: E402
from tallyframe.schemas import GATEWAY_COLORS, SYMBOL_COLORS  # noqa: E402


@query("list_wallets", oracle=with_ledger(f"""
SELECT id, user_id, name, address, symbol, network, balance, balance_usd, is_verified, created_at,
       {short_sql('address')} AS short_address,
       {fixed_sql('balance', 4)} AS balance_text,
       {usd_sql('balance_usd')} AS balance_usd_text,
       {case_map_sql('symbol', SYMBOL_COLORS, 'var(--blue)')} AS color
FROM crypto_wallets""", "crypto_wallets"))
def q_list_wallets(spark, sf_dir):
    """F1 + X3 + X7 + X17: every owner's wallet cards, newest first."""
    return listings.list_wallets(L(spark, sf_dir).crypto_wallets)


@query("list_banks", oracle=with_ledger(f"""
SELECT id, user_id, name, bank_name, account_type, last4, balance, currency, status, created_at,
       '••••' || last4 AS masked, {STATUS_COLOR_SQL} AS status_color,
       {usd_sql('balance')} AS balance_text
FROM bank_accounts""", "bank_accounts"))
def q_list_banks(spark, sf_dir):
    """F2 + X5 + X15: every owner's bank cards without secrets, newest first."""
    return listings.list_banks(L(spark, sf_dir).bank_accounts)


@query("list_gateways", oracle=with_ledger(f"""
SELECT id, user_id, name, fee, fixed_fee, is_enabled, monthly_volume, transaction_count, created_at,
       printf('%,.2f', round(fee, 2)) || '%' ||
         CASE WHEN coalesce(fixed_fee, 0) > 0 THEN ' + $' || printf('%,.2f', round(fixed_fee, 2)) ELSE '' END
         AS fee_label,
       {case_map_sql('name', GATEWAY_COLORS, '#3D8EF0')} AS color,
       left(name, 1) AS initial,
       {usd_sql('monthly_volume')} AS volume_text
FROM payment_gateways""", "payment_gateways"))
def q_list_gateways(spark, sf_dir):
    """F3 + X16 + X17: every owner's gateway cards without key and secret."""
    return listings.list_gateways(L(spark, sf_dir).payment_gateways)


@query("list_rules", oracle=with_ledger("""
SELECT id, user_id, name, percentage, color, is_locked, is_auto, created_at,
       row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS position,
       CASE WHEN is_locked THEN 'Locked' ELSE 'Adjustable' END || ' · ' ||
       CASE WHEN is_auto THEN 'Auto-run' ELSE 'Manual only' END AS meta
FROM allocation_rules""", "allocation_rules"))
def q_list_rules(spark, sf_dir):
    """F4 + O2: every user's allocation rules, oldest first, with positions."""
    return listings.list_rules(L(spark, sf_dir).allocation_rules)


@query("user_directory", oracle=with_ledger("""
SELECT id, lower(trim(email)) AS email, trim(first_name) AS first_name, trim(last_name) AS last_name,
       role, status, stripe_customer_id, last_login, created_at, updated_at,
       coalesce(nullif(concat_ws(' ', nullif(trim(first_name), ''), nullif(trim(last_name), '')), ''), lower(trim(email))) AS display_name,
       upper(left(trim(first_name), 1) || left(trim(last_name), 1)) AS initials,
       upper(left(role, 1)) || substring(role, 2) AS role_label
FROM users""", "users"))
def q_user_directory(spark, sf_dir):
    """F5 + F9 + X12 + X14 + X18: the user directory without password hashes."""
    return listings.user_directory(L(spark, sf_dir).users)


@query("find_users", oracle=with_ledger("""
SELECT id, lower(trim(email)) AS email, trim(first_name) AS first_name, trim(last_name) AS last_name,
       role, status, stripe_customer_id, last_login, created_at, updated_at,
       coalesce(nullif(concat_ws(' ', nullif(trim(first_name), ''), nullif(trim(last_name), '')), ''), lower(trim(email))) AS display_name,
       upper(left(trim(first_name), 1) || left(trim(last_name), 1)) AS initials,
       upper(left(role, 1)) || substring(role, 2) AS role_label
FROM users
WHERE lower(trim(email)) IN (SELECT lower(trim(upper(c_name) || '@example.com')) FROM customer)""", "users"))
def q_find_users(spark, sf_dir):
    """look users up by e-mail after normalising both sides (X12); the lookup
    list is every customer's address typed in another case."""
    led = L(spark, sf_dir)
    emails = led.driver("customer").selectExpr("upper(c_name) || '@example.com' AS email")
    return listings.find_users(led.users, emails)


@query("users_by_id", oracle=with_ledger("""
SELECT e.event_id AS request_id, u.id, u.email, u.first_name, u.last_name, u.role, u.stripe_customer_id,
       CASE WHEN u.id IS NULL THEN 'User not found.' END AS error
FROM events e LEFT JOIN users u ON u.id = e.user_id""", "users"))
def q_users_by_id(spark, sf_dir):
    """F9 + F17: profile and customer id by user id; every event asks for its user."""
    led = L(spark, sf_dir)
    asked = led.driver("events").selectExpr("event_id AS request_id", "CAST(user_id AS BIGINT) AS user_id")
    return listings.users_by_id(led.users, asked)


# ---------------------------------------------------------------------------
# Transactions: search, pages, lookups, statement
# ---------------------------------------------------------------------------
def _page_sql(where: str, lo: int, hi: int) -> str:
    return with_ledger(f"""
SELECT {TX_COLS_SQL}, position FROM (
  SELECT {TX_COLS_SQL},
         row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position
  FROM transactions WHERE {where}) t
WHERE position > {lo} AND position <= {hi}""", "transactions")


@query("tx_search", oracle=_page_sql("type = 'receive'", 0, 50))
def q_tx_search(spark, sf_dir):
    """F6 + F16 + O1 + O3: each owner's newest 50 'receive' transactions."""
    return listings.tx_search(L(spark, sf_dir).transactions, type="receive")


@query("tx_gateway_in", oracle=_page_sql("gateway IN ('Stripe', 'Wise', 'Internal')", 0, 50))
def q_tx_gateway_in(spark, sf_dir):
    """F7 + F15: the bank page's gateway list 'Stripe,Wise,Internal' (with stray
    blanks, which are trimmed and dropped), newest 50 per owner."""
    return listings.tx_search(L(spark, sf_dir).transactions, gateway=" Stripe , Wise,,Internal, ")


@query("tx_page", oracle=with_ledger(f"""
SELECT {TX_COLS_SQL} FROM transactions ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10
""", "transactions"))
def q_tx_page(spark, sf_dir):
    """O3: one global newest-first page; limit 'abc' falls back to 50, offset 10."""
    return listings.tx_page(L(spark, sf_dir).transactions, limit="abc", offset="10")


@query("recent_tx", oracle=_page_sql("TRUE", 0, 6))
def q_recent_tx(spark, sf_dir):
    """The six newest transactions of every owner."""
    return listings.recent_tx(L(spark, sf_dir).transactions, 6)


@query("tx_by_id", oracle=with_ledger("""
SELECT * FROM transactions t
WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_id = t.id AND e.user_id = t.user_id)
""", "transactions"))
def q_tx_by_id(spark, sf_dir):
    """F8: owner-checked point lookups, one request per event (id = event_id, owner =
    the event's user); requests for another owner's id find nothing."""
    led = L(spark, sf_dir)
    requests = led.driver("events").selectExpr("event_id AS id", "user_id")
    found, _ = listings.tx_by_id(led.transactions, requests)
    return found


@query("tx_text_search", oracle=with_ledger(f"""
SELECT {TX_COLS_SQL} FROM transactions
WHERE coalesce(contains(lower(from_address), 'order 12'), FALSE)
   OR coalesce(contains(lower(description), 'order 12'), FALSE)
   OR contains(CAST(id AS VARCHAR), 'order 12')""", "transactions"))
def q_tx_text_search(spark, sf_dir):
    """case-insensitive search for 'ORDER 12' over address, description and id,
    across all rows."""
    return listings.tx_text_search(L(spark, sf_dir).transactions, "ORDER 12")


@query("tx_statement", oracle=with_ledger(f"""
SELECT id, user_id, type, gateway, method, amount_usd, status, created_at,
       CASE WHEN type = 'send' THEN '-' ELSE '+' END || {usd_sql('abs(amount_usd)')} AS amount_text,
       coalesce(nullif(description, ''), nullif(from_address, ''), '—') AS description_text,
       coalesce(nullif(from_address, ''), nullif(description, ''), '—') AS bank_description_text,
       coalesce(method, '—') AS method_text,
       coalesce(gateway, '—') AS gateway_text,
       {STATUS_COLOR_SQL} AS status_color,
       upper(type) AS type_label,
       {TYPE_COLOR_SQL} AS type_color,
       strftime(created_at, '%H:%M:%S') AS time_text,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS datetime_text,
       strftime(created_at, '%a, %b %-d, %Y') AS date_text,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso_text
FROM transactions""", "transactions"))
def q_tx_statement(spark, sf_dir):
    """R3 (X1-X6, X13): every transaction as a statement line with display texts."""
    return listings.tx_statement(L(spark, sf_dir).transactions)


# ---------------------------------------------------------------------------
# Allocation
# ---------------------------------------------------------------------------
from tallyframe.operators import acceptance, allocation  # noqa: E402
from tallyframe.schemas import RULE_PALETTE  # noqa: E402


def _runs(led: Ledger):
    """Allocation runs: every ``alloc`` transaction is one run of its amount."""
    return led.transactions.where("type = 'alloc'").selectExpr(
        "id AS run_id", "user_id", "amount_usd AS amount", "created_at")


_RUNS_SQL = "runs AS (SELECT id AS run_id, user_id, amount_usd AS amount, created_at FROM transactions WHERE type = 'alloc')"
_SHARE_SQL = "CAST(CAST({a} AS DECIMAL(20,2)) * {p} * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(26,6))"


@query("rule_totals", oracle=with_ledger("""
SELECT user_id, CAST(t AS DECIMAL(7,2)) AS total_pct, t = 100 AS is_on_target,
       CAST(greatest(100 - t, 0) AS DECIMAL(7,2)) AS remaining_pct,
       CAST(greatest(t - 100, 0) AS DECIMAL(7,2)) AS over_by_pct,
       CASE WHEN t = 100 THEN NULL
            WHEN t < 100 THEN 'Rules sum to ' || CAST(CAST(t AS DECIMAL(7,2)) AS VARCHAR) || '% — Remaining: '
                              || CAST(CAST(100 - t AS DECIMAL(7,2)) AS VARCHAR) || '%'
            ELSE 'Rules sum to ' || CAST(CAST(t AS DECIMAL(7,2)) AS VARCHAR) || '% — Over by '
                 || CAST(CAST(t - 100 AS DECIMAL(7,2)) AS VARCHAR) || '%' END AS warning
FROM (SELECT user_id, sum(percentage) AS t FROM allocation_rules GROUP BY user_id) s""",
                                         "allocation_rules"))
def q_rule_totals(spark, sf_dir):
    """Every user's rule total with on-target flag, remaining and over-by."""
    return allocation.rule_totals(L(spark, sf_dir).allocation_rules)


def _cap_candidates(led: Ledger):
    """New-rule requests: one per event; the percentage text comes from the
    event's JSON props (``k``), unparsable for every 13th event."""
    return led.driver("events").selectExpr(
        "event_id AS request_id", "user_id", "'Rule ' || CAST(event_id AS STRING) AS name",
        "CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE get_json_object(props, '$.k') END AS pct_text",
        "value > 40 AS is_locked")


_CAP_BODY = """
SELECT request_id, c.user_id, name, CAST(pct AS DECIMAL(5,2)) AS percentage, is_locked,
       CAST(coalesce(e.t, 0) AS DECIMAL(7,2)) AS existing_pct,
       CAST(coalesce(e.t, 0) + pct AS DECIMAL(7,2)) AS new_total_pct,
       (coalesce(e.t, 0) + pct <= 100) OR coalesce(is_locked, FALSE) AS accepted,
       CASE WHEN NOT ((coalesce(e.t, 0) + pct <= 100) OR coalesce(is_locked, FALSE))
            THEN 'Total percentage cannot exceed 100%.' END AS error
FROM (SELECT event_id AS request_id, user_id, 'Rule ' || CAST(event_id AS VARCHAR) AS name,
             least(greatest(coalesce(TRY_CAST(CASE WHEN event_id % 13 = 0 THEN 'n/a'
                                                   ELSE json_extract_string(props, '$.k') END AS INTEGER), 0), 0), 100) AS pct,
             value > 40 AS is_locked
      FROM events) c
LEFT JOIN (SELECT user_id, sum(percentage) AS t FROM allocation_rules GROUP BY user_id) e
  ON c.user_id = e.user_id"""


@query("rule_cap_check", oracle=with_ledger(_CAP_BODY, "allocation_rules"))
def q_rule_cap_check(spark, sf_dir):
    """A7 + X8: decide each event's new-rule request against the owner's
    existing total (cap 100 unless locked), parsing and clamping the percentage."""
    led = L(spark, sf_dir)
    return allocation.rule_cap_check(led.allocation_rules, _cap_candidates(led))


def _rule_requests(led: Ledger):
    """New-rule requests in their order: one per event, at its time, from its user's address;
    percentages as typed (unparsable for every 13th event, far too large for every 29th)."""
    return led.driver("events").selectExpr(
        "event_id AS request_id", "CAST(user_id AS BIGINT) AS user_id", "'Rule ' || CAST(event_id AS STRING) AS name",
        "CASE WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 29 = 0 THEN '99999999999' "
        "ELSE CAST(event_id % 11 AS STRING) || '%' END AS pct_text",
        "event_id % 17 = 0 AS is_locked", "ts AS asked_at", f"{_IP} AS ip_address")


_IP = "'10.' || CAST(user_id % 256 AS STRING) || '.0.1'"
_IP_SQL = "'10.' || CAST(user_id % 256 AS VARCHAR) || '.0.1'"
_ACCEPT_CTES = ("""rule_requests AS (
  SELECT event_id AS request_id, CAST(user_id AS BIGINT) AS user_id, 'Rule ' || CAST(event_id AS VARCHAR) AS name,
         CAST(CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 29 = 0 THEN 100 ELSE event_id % 11 END AS DECIMAL(5,2)) AS pct,
         event_id % 17 = 0 AS is_locked, ts AS asked_at, """ + _IP_SQL + """ AS ip_address,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events)""", """accepted_rules AS (
  SELECT r.*, CAST(coalesce(t.total, 0) AS DECIMAL(18,2)) AS before,
         is_locked OR coalesce(t.total, 0) + pct <= 100 AS ok
  FROM rule_requests r LEFT JOIN (SELECT user_id, sum(percentage) AS total FROM allocation_rules GROUP BY user_id) t
    USING (user_id) WHERE n = 1
  UNION ALL
  SELECT r.*, CAST(a.before + CASE WHEN a.ok THEN a.pct ELSE 0 END AS DECIMAL(18,2)),
         r.is_locked OR a.before + CASE WHEN a.ok THEN a.pct ELSE 0 END + r.pct <= 100
  FROM accepted_rules a JOIN rule_requests r ON r.user_id = a.user_id AND r.n = a.n + 1)""")


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("rule_acceptance", oracle=recursive(with_ledger("""
SELECT request_id, user_id, name, is_locked, asked_at, ip_address, CAST(pct AS DECIMAL(5,2)) AS percentage,
       before AS total_before, CAST(before + pct AS DECIMAL(18,2)) AS total_asked, ok AS accepted,
       CASE WHEN NOT ok THEN 'Total percentage cannot exceed 100%.' END AS error
FROM accepted_rules""", "allocation_rules", extra_ctes=_ACCEPT_CTES)))
def q_rule_acceptance(spark, sf_dir):
    """A7 + X8 in order: every event's new-rule request decided against the owner's stored
    total plus all requests accepted before it; refused requests add nothing."""
    led = L(spark, sf_dir)
    return acceptance.accept_in_order(led.allocation_rules, _rule_requests(led))


@query("alloc_run", oracle=with_ledger(f"""
SELECT r.run_id, r.user_id, a.id AS rule_id, a.name AS rule_name, a.percentage, r.amount,
       {_SHARE_SQL.format(a='r.amount', p='a.percentage')} AS share
FROM runs r
JOIN (SELECT user_id, sum(percentage) AS t FROM allocation_rules WHERE is_auto GROUP BY user_id) g
  ON g.user_id = r.user_id AND g.t = 100
JOIN allocation_rules a ON a.user_id = r.user_id AND a.is_auto""",
                                       "transactions", "allocation_rules", extra_ctes=(_RUNS_SQL,)))
def q_alloc_run(spark, sf_dir):
    """R4 (F12, A8, J9, X11): every alloc transaction split over its owner's auto
    rules when they sum to exactly 100; exact DECIMAL shares."""
    led = L(spark, sf_dir)
    allocations, _ = allocation.alloc_run(_runs(led), led.allocation_rules)
    return allocations


@query("alloc_rejects", oracle=with_ledger("""
SELECT r.run_id, r.user_id, r.amount, CAST(coalesce(g.t, 0) AS DECIMAL(7,2)) AS rule_total_pct,
       'Total percentage must be 100%. Current total: ' || CAST(CAST(coalesce(g.t, 0) AS DECIMAL(7,2)) AS VARCHAR) || '%' AS error
FROM runs r
LEFT JOIN (SELECT user_id, sum(percentage) AS t FROM allocation_rules WHERE is_auto GROUP BY user_id) g
  ON g.user_id = r.user_id
WHERE coalesce(g.t, 0) <> 100""", "transactions", "allocation_rules", extra_ctes=(_RUNS_SQL,)))
def q_alloc_rejects(spark, sf_dir):
    """A8 second output: runs rejected because the owner's auto rules do not sum to
    exactly 100 (seed set B sums to 80 over auto rules)."""
    led = L(spark, sf_dir)
    _, rejects = allocation.alloc_run(_runs(led), led.allocation_rules)
    return rejects


@query("alloc_preview", oracle=with_ledger(f"""
SELECT l.user_id, a.id AS rule_id, a.name AS rule_name, a.color, a.percentage, l.amount,
       {_SHARE_SQL.format(a='l.amount', p='a.percentage')} AS share,
       '$' || printf('%,.2f', round({_SHARE_SQL.format(a='l.amount', p='a.percentage')}, 2)) AS share_text,
       t.t <> 100 AS warn, CAST(t.t AS DECIMAL(7,2)) AS all_rules_pct
FROM (SELECT user_id, amount FROM (
        SELECT user_id, amount, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, run_id DESC) AS rn
        FROM runs) x WHERE rn = 1) l
JOIN (SELECT user_id, sum(percentage) AS t FROM allocation_rules GROUP BY user_id) t ON t.user_id = l.user_id
JOIN allocation_rules a ON a.user_id = l.user_id""",
                                           "transactions", "allocation_rules", extra_ctes=(_RUNS_SQL,)))
def q_alloc_preview(spark, sf_dir):
    """R5 + R8: each owner's latest run amount previewed over all rules (no gate),
    with a warning flag when the rules do not sum to 100."""
    led = L(spark, sf_dir)
    return allocation.alloc_preview(allocation.latest_amount(_runs(led)), led.allocation_rules)


@query("rule_offsets", oracle=with_ledger("""
SELECT user_id, id, name, percentage,
       CAST(coalesce(sum(percentage) OVER (PARTITION BY user_id ORDER BY created_at, id
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(7,2)) AS offset_pct,
       CAST(sum(percentage) OVER (PARTITION BY user_id ORDER BY created_at, id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(7,2)) AS end_pct
FROM allocation_rules""", "allocation_rules"))
def q_rule_offsets(spark, sf_dir):
    """Donut offsets: running sum of each user's earlier rule percentages."""
    return allocation.rule_offsets(L(spark, sf_dir).allocation_rules)


_PALETTE_SQL = "[" + ", ".join(f"'{c}'" for c in RULE_PALETTE) + "]"


@query("rule_colors", oracle=with_ledger(f"""
SELECT user_id, id, name, pos AS position,
       {_PALETTE_SQL}[((pos - 1) % {len(RULE_PALETTE)}) + 1] AS palette_color
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS pos
      FROM allocation_rules) r""", "allocation_rules"))
def q_rule_colors(spark, sf_dir):
    """Palette colour by rule position modulo 7."""
    return allocation.rule_colors(L(spark, sf_dir).allocation_rules)


# ---------------------------------------------------------------------------
# Bars, ranks, candidates
# ---------------------------------------------------------------------------
from tallyframe.operators import pairs  # noqa: E402

_RANK_SQL = ("SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank "
             "FROM bank_accounts")
_BARS_CTE = f"""bars AS (
  SELECT user_id, 1 AS bar_pos, 'Crypto' AS label, CAST(NULL AS BIGINT) AS account_id,
         CAST(crypto_usd AS DECIMAL(20,2)) AS value FROM kpis
  UNION ALL
  SELECT s.user_id, CASE s.rank WHEN 1 THEN 2 WHEN 4 THEN 3 WHEN 2 THEN 4 ELSE 5 END, coalesce(r.name, '—'), r.id,
         CAST(coalesce(r.balance, 0) AS DECIMAL(20,2))
  FROM (SELECT user_id, v.rank FROM kpis, (VALUES (1), (2), (3), (4)) AS v(rank)) s
  LEFT JOIN ({_RANK_SQL}) r ON r.user_id = s.user_id AND r.rank = s.rank
  UNION ALL
  SELECT user_id, 6, 'GW Volume', CAST(NULL AS BIGINT), CAST(gateway_volume_usd AS DECIMAL(20,2)) FROM kpis)"""


def _pct_sql(v: str, rel: str) -> str:
    return f"""
SELECT b.*, CAST(floor(b.{v} * 100 / m.vmax + 0.5) AS INTEGER) AS pct, {usd_sql('b.' + v)} AS value_text
FROM {rel} b JOIN (SELECT user_id, greatest(max({v}), 1) AS vmax FROM {rel} GROUP BY user_id) m
  ON b.user_id = m.user_id"""


@query("portfolio_bars", oracle=with_ledger(_pct_sql("value", "bars"),
                                            "crypto_wallets", "bank_accounts", "payment_gateways",
                                            extra_ctes=(f"kpis AS ({_KPI_BODY})", _BARS_CTE)))
def q_portfolio_bars(spark, sf_dir):
    """R2 (U1, A9, W2, W4): each owner's six bars (crypto, first four accounts in
    newest-first order, enabled gateway volume) with percent of the largest."""
    led = L(spark, sf_dir)
    return portfolio.portfolio_bars(led.crypto_wallets, led.bank_accounts, led.payment_gateways)


@query("gateway_volume_bars", oracle=with_ledger(
    f"SELECT x.*, {case_map_sql('x.name', GATEWAY_COLORS, '#3D8EF0')} AS color FROM ("
    + _pct_sql("monthly_volume", "active") + ") x",
    "payment_gateways",
    extra_ctes=("active AS (SELECT user_id, id AS gateway_id, name, monthly_volume FROM payment_gateways "
                "WHERE monthly_volume > 0)",)))
def q_gateway_volume_bars(spark, sf_dir):
    """R6 (F13, A9, W4, X17): gateways with positive volume, percent of the owner's
    largest volume, and colour."""
    return portfolio.gateway_volume_bars(L(spark, sf_dir).payment_gateways)


@query("bank_rank", oracle=with_ledger(
    f"SELECT id, user_id, name, balance, created_at, CAST(rank AS INTEGER) AS rank FROM ({_RANK_SQL}) r WHERE rank <= 4",
    "bank_accounts"))
def q_bank_rank(spark, sf_dir):
    """The first four accounts of each owner in newest-first order (bar sources)."""
    return (portfolio.bank_rank(L(spark, sf_dir).bank_accounts, top=4)
            .select("id", "user_id", "name", "balance", "created_at", "rank"))


def _swap_requests(led: Ledger):
    """Swap requests: one per line item; requester, from- and to-wallet come from the
    line's supplier, part and line number."""
    return led.driver("lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS request_id", "CAST(l_suppkey % 25 AS BIGINT) AS user_id",
        "l_partkey AS from_wallet_id", "l_partkey + 25 * (l_linenumber - 1) AS to_wallet_id")


@query("swap_pairs", oracle=with_ledger("""
SELECT r.request_id, r.user_id, r.from_wallet_id, r.to_wallet_id, f.symbol AS from_symbol, t.symbol AS to_symbol,
       CASE WHEN f.id IS NULL THEN 'unknown_from' WHEN t.id IS NULL THEN 'unknown_to'
            WHEN f.user_id <> r.user_id THEN 'not_owner' WHEN t.user_id <> r.user_id THEN 'cross_owner'
            WHEN r.from_wallet_id = r.to_wallet_id THEN 'same_wallet' ELSE 'ok' END AS status
FROM (SELECT l_orderkey * 10 + l_linenumber AS request_id, CAST(l_suppkey % 25 AS BIGINT) AS user_id,
             l_partkey AS from_wallet_id, l_partkey + 25 * (l_linenumber - 1) AS to_wallet_id FROM lineitem) r
LEFT JOIN crypto_wallets f ON f.id = r.from_wallet_id
LEFT JOIN crypto_wallets t ON t.id = r.to_wallet_id""", "crypto_wallets"))
def q_swap_pairs(spark, sf_dir):
    """Validate every swap request (both wallets the requester's, and distinct)
    with two joins on wallet id; no owner's wallet pairs are enumerated."""
    led = L(spark, sf_dir)
    return pairs.swap_pairs(led.crypto_wallets, _swap_requests(led))


@query("transfer_pairs", oracle=with_ledger("""
SELECT a.id, a.user_id, a.name, CAST(o.n - 1 AS BIGINT) AS n_targets,
       CAST(o.s - coalesce(a.balance, 0) AS DECIMAL(30,2)) AS targets_balance
FROM bank_accounts a
JOIN (SELECT user_id, count(*) AS n, coalesce(sum(balance), 0) AS s FROM bank_accounts GROUP BY user_id) o
  ON o.user_id = a.user_id""", "bank_accounts"))
def q_transfer_pairs(spark, sf_dir):
    """J7 (Q12): per account, how many other accounts of the owner it can transfer
    to, and their combined balance."""
    return pairs.transfer_pairs(L(spark, sf_dir).bank_accounts)


# ---------------------------------------------------------------------------
# Feeds and valuation
# ---------------------------------------------------------------------------
from tallyframe.operators import valuation  # noqa: E402
from tallyframe.sources import feeds, landed  # noqa: E402
from tallyframe.schemas import SYMBOL_TO_COIN  # noqa: E402

_COINS_SQL = "coins(coin_id, factor) AS (VALUES " + ", ".join(
    f"('{c}', CAST({f} AS DOUBLE))" for c, f in landed.PRICE_FACTORS.items()) + ")"
_PRICES_CTE = """prices AS (
  SELECT coin_id, usd, usd_24h_change, as_of FROM (
    SELECT c.coin_id, e.value * c.factor AS usd, (e.value - 25.0) / 10.0 AS usd_24h_change,
           max(e.ts) OVER (PARTITION BY c.coin_id) AS as_of,
           row_number() OVER (PARTITION BY c.coin_id ORDER BY e.ts DESC, e.event_id DESC) AS rn
    FROM events e JOIN coins c ON NOT (c.coin_id = 'tether' AND e.event_type = 'signup')
    WHERE e.event_type <> 'error') t
  WHERE rn = 1)"""


@query("price_feed", oracle=with_ledger("SELECT * FROM prices", extra_ctes=(_COINS_SQL, _PRICES_CTE)))
def q_price_feed(spark, sf_dir):
    """Parse every landed price reply (coin map JSON) and keep the latest price
    and 24h change per requested coin id; error replies drop out."""
    return feeds.price_feed(landed.price_replies(L(spark, sf_dir)))


_BANK_FEED_SQL = """
SELECT c_custkey // 3 AS link_id,
       CAST(min(c_nationkey) OVER (PARTITION BY c_custkey // 3) AS BIGINT) AS user_id,
       CASE WHEN (c_custkey // 3) % 10 = 3 THEN 'new-item-' || CAST(c_custkey // 3 AS VARCHAR)
            WHEN (c_custkey // 3) % 23 <> 5 THEN 'item-' || CAST(c_custkey // 3 AS VARCHAR) END AS item_id,
       (['Chase', 'Wise', 'Mercury', 'Bank of America'])[(c_custkey // 3) % 4 + 1] AS institution,
       CAST(row_number() OVER (PARTITION BY c_custkey // 3 ORDER BY c_custkey) - 1 AS INTEGER) AS pos,
       'Linked ' || lower(c_mktsegment) AS name, lower(c_mktsegment) AS account_type,
       lpad(CAST((c_custkey * 37) % 10000 AS VARCHAR), 4, '0') AS last4,
       CAST(coalesce(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(20,2)) END, 0) AS DECIMAL(20,2)) AS balance,
       coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'USD' END, ''), 'USD') AS currency
FROM customer"""


@query("bank_feed", oracle=_BANK_FEED_SQL)
def q_bank_feed(spark, sf_dir):
    """Parse every landed bank-link reply into one row per account (array order
    kept), with available -> 0 and currency -> USD fallbacks."""
    return feeds.bank_feed(landed.bank_link_replies(L(spark, sf_dir)))


@query("linked_per_institution", oracle=f"""
SELECT user_id, institution, count(*) AS n_accounts FROM ({_BANK_FEED_SQL}) f GROUP BY user_id, institution""")
def q_linked_per_institution(spark, sf_dir):
    """A10: accounts linked per owner and institution, from the parsed link replies."""
    return valuation.linked_per_institution(feeds.bank_feed(landed.bank_link_replies(L(spark, sf_dir))))


_CHAIN_CTE = """chain AS (
  SELECT r.address, r.network,
         CASE WHEN r.failed THEN NULL
              WHEN r.is_sol THEN CAST(CAST(r.lamports AS DECIMAL(20,0)) * CAST(0.000000001 AS DECIMAL(10,9)) AS DECIMAL(20,8))
              WHEN length(r.digits) > 31 THEN NULL
              ELSE TRY_CAST(CASE WHEN length(r.units) <= 8 THEN '0.' || lpad(r.units, 8, '0')
                                 ELSE left(r.units, length(r.units) - 8) || '.' || right(r.units, 8) END AS DECIMAL(20,8)) END
           AS live_balance,
         CASE WHEN r.failed THEN 'failed' WHEN r.is_sol THEN 'ok' WHEN length(r.digits) > 31 THEN 'bad_hex' ELSE 'ok' END AS status
  FROM (
    SELECT id, address, p_partkey % 11 = 0 AS failed, lower(network) = 'solana' AS is_sol, network,
           CAST(p_size AS BIGINT) * 1000000000 + p_partkey AS lamports, digits,
           CASE WHEN length(digits) > 31 THEN NULL
                ELSE CASE WHEN length(CAST(CAST('0x0' || digits AS HUGEINT) + 5000000000 AS VARCHAR)) > 10
                          THEN left(CAST(CAST('0x0' || digits AS HUGEINT) + 5000000000 AS VARCHAR),
                                    length(CAST(CAST('0x0' || digits AS HUGEINT) + 5000000000 AS VARCHAR)) - 10)
                          ELSE '0' END END AS units
    FROM (SELECT *, ltrim(CASE WHEN p_partkey % 19 = 0 THEN repeat('f', 32) WHEN p_partkey % 17 = 0 THEN '0'
                               ELSE lower(hex(p_partkey)) || lpad(lower(hex(CAST(p_size AS BIGINT) * 1000000000000000)), 16, '0')
                          END, '0') AS digits
          FROM crypto_wallets w JOIN part ON part.p_partkey = w.id
          WHERE lower(w.network) IN ('ethereum', 'solana')) p) r)"""


@query("chain_balance", oracle=with_ledger("SELECT * FROM chain", "crypto_wallets", extra_ctes=(_CHAIN_CTE,)))
def q_chain_balance(spark, sf_dir):
    """S7 + X9: parse every wallet's landed balance reply: hex wei -> ETH exactly
    (values past 2^64 included), lamports -> SOL; failed and malformed replies kept
    as status rows."""
    return feeds.chain_balances(landed.chain_replies(L(spark, sf_dir)))


_REFRESH_CTE = """refreshed AS (
  SELECT w.id, w.user_id, w.name, w.address, w.symbol, w.network,
         CAST(CASE WHEN lower(w.network) IN ('ethereum', 'solana') AND c.live_balance IS NOT NULL
                   THEN c.live_balance ELSE w.balance END AS DECIMAL(20,8)) AS balance,
         w.balance_usd, w.is_verified, w.created_at, w.updated_at,
         CASE WHEN lower(w.network) IN ('ethereum', 'solana') AND c.live_balance IS NOT NULL
              THEN 'live' ELSE 'stored' END AS balance_source
  FROM crypto_wallets w
  LEFT JOIN (SELECT * FROM chain WHERE status = 'ok') c
    ON c.address = w.address AND lower(c.network) = lower(w.network))"""


def _refreshed(led: Ledger):
    return valuation.wallet_refresh(led.crypto_wallets, feeds.chain_balances(landed.chain_replies(led)))


@query("wallet_refresh", oracle=with_ledger("SELECT * FROM refreshed", "crypto_wallets",
                                            extra_ctes=(_CHAIN_CTE, _REFRESH_CTE)))
def q_wallet_refresh(spark, sf_dir):
    """Refresh Ethereum/Solana wallet balances from the parsed chain replies by
    (address, network); failed calls keep the stored balance."""
    return _refreshed(L(spark, sf_dir))


_COIN_CASE = "CASE upper(symbol) " + " ".join(
    f"WHEN '{s}' THEN '{c}'" for s, c in SYMBOL_TO_COIN.items()) + " END"


@query("wallet_valuation", oracle=with_ledger(f"""
SELECT w.id, w.user_id, w.name, w.symbol, w.network, w.coin_id, w.balance,
       CAST(coalesce(CAST(p.usd AS DECIMAL(18,6)), 0) AS DECIMAL(18,6)) AS price_usd,
       CAST(w.balance * coalesce(CAST(p.usd AS DECIMAL(18,6)), 0) AS DECIMAL(20,2)) AS usd_value,
       p.usd_24h_change AS change_24h,
       {fixed_sql('w.balance', 6)} AS balance_text,
       {usd_sql('CAST(w.balance * coalesce(CAST(p.usd AS DECIMAL(18,6)), 0) AS DECIMAL(20,2))')} AS usd_value_text
FROM (SELECT *, {_COIN_CASE} AS coin_id FROM refreshed) w
LEFT JOIN prices p ON p.coin_id = w.coin_id""", "crypto_wallets",
                                              extra_ctes=(_CHAIN_CTE, _REFRESH_CTE, _COINS_SQL, _PRICES_CTE)))
def q_wallet_valuation(spark, sf_dir):
    """R7 (J4, J5, X3): value every refreshed wallet at the latest feed price of its
    coin (no price -> 0), with the feed's 24h change."""
    led = L(spark, sf_dir)
    prices = feeds.price_feed(landed.price_replies(led))
    return valuation.wallet_valuation(_refreshed(led), prices)


# ---------------------------------------------------------------------------
# Validation (V1-V6)
# ---------------------------------------------------------------------------
from tallyframe.operators import quality  # noqa: E402
from tallyframe.schemas import LEDGER_SCHEMAS, WALLET_FIELD_LENGTHS  # noqa: E402
from tallyframe.sources.bindings import LEDGER_TABLES  # noqa: E402


def _all_tables(led: Ledger) -> dict:
    return {t: getattr(led, t) for t in LEDGER_TABLES}


def _in_list(vals) -> str:
    return ", ".join(f"'{v}'" for v in vals)


def _check_sql() -> str:
    parts = []
    for (t, col), allowed in quality.DOMAINS.items():
        parts.append(f"SELECT '{t}' AS table_name, id AS row_id, '{col}' AS column_name, 'domain' AS violation "
                     f"FROM {t} WHERE {col} IS NOT NULL AND {col} NOT IN ({_in_list(allowed)})")
    for (t, col), (lo, hi) in quality.RANGES.items():
        parts.append(f"SELECT '{t}', id, '{col}', 'range' FROM {t} WHERE NOT ({col} BETWEEN {lo} AND {hi})")
    for t, cols in quality.REQUIRED.items():
        for col in cols:
            cond = f"{col} IS NULL"
            if col in quality.BLANK_IS_MISSING.get(t, []):
                cond += f" OR trim({col}) = ''"
            parts.append(f"SELECT '{t}', id, '{col}', 'required' FROM {t} WHERE {cond}")
    return with_ledger("\nUNION ALL\n".join(parts), *LEDGER_TABLES)


@query("check_violations", oracle=_check_sql())
def q_check_violations(spark, sf_dir):
    """V1 + V3: CHECK-domain, percentage-range and required-field violations over all
    eight ledger tables (NULL passes a CHECK; blank user names count as missing)."""
    return quality.check_violations(_all_tables(L(spark, sf_dir)))


@query("wallet_validation", oracle=with_ledger("\nUNION ALL\n".join(
    f"SELECT 'crypto_wallets' AS table_name, id AS row_id, '{c}' AS column_name, 'length {lo}-{hi}' AS violation "
    f"FROM crypto_wallets WHERE NOT coalesce(length(trim({c})) BETWEEN {lo} AND {hi}, FALSE)"
    for c, (lo, hi) in WALLET_FIELD_LENGTHS.items()), "crypto_wallets"))
def q_wallet_validation(spark, sf_dir):
    """V2: wallet name/address/symbol/network trimmed lengths, all failures reported."""
    return quality.wallet_validation(L(spark, sf_dir).crypto_wallets)


@query("unique_violations", oracle=with_ledger("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{k}' AS column_name, CAST({k} AS VARCHAR) AS key_value, count(*) AS n_rows "
    f"FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1"
    for t, k in quality.UNIQUE_KEYS.items()), *quality.UNIQUE_KEYS))
def q_unique_violations(spark, sf_dir):
    """V4: e-mail, wallet address and bank item id values held by several rows (NULL
    item ids never collide)."""
    return quality.unique_violations(_all_tables(L(spark, sf_dir)))


_CHILDREN = [t for t in LEDGER_TABLES if t != "users"]


@query("orphan_rows", oracle=with_ledger("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, id AS row_id, user_id FROM {t} c "
    f"WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = c.user_id)"
    for t in _CHILDREN), *LEDGER_TABLES))
def q_orphan_rows(spark, sf_dir):
    """V5: child rows of the seven user-owned tables whose user does not exist."""
    led = L(spark, sf_dir)
    return quality.orphan_rows(led.users, {t: getattr(led, t) for t in _CHILDREN})


def _length_sql() -> str:
    parts = []
    for t in LEDGER_TABLES:
        for f in LEDGER_SCHEMAS[t].fields:
            n = f.metadata.get("max_len")
            if n:
                parts.append(f"SELECT '{t}' AS table_name, id AS row_id, '{f.name}' AS column_name, "
                             f"'longer than {n}' AS violation FROM {t} WHERE length({f.name}) > {n}")
    return with_ledger("\nUNION ALL\n".join(parts), *LEDGER_TABLES)


@query("length_violations", oracle=_length_sql())
def q_length_violations(spark, sf_dir):
    """V6: text values longer than their declared VARCHAR length, all tables."""
    return quality.length_violations(_all_tables(L(spark, sf_dir)))


@query("decimal_overflow", oracle="""
SELECT 'raw' AS table_name, o_orderkey AS row_id, 'o_totalprice' AS column_name,
       'does not fit decimal(7,2)' AS violation
FROM orders WHERE o_totalprice IS NOT NULL AND TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL""")
def q_decimal_overflow(spark, sf_dir):
    """V6 (numbers): order totals that would overflow a DECIMAL(7,2) column on load."""
    raw = L(spark, sf_dir).driver("orders").select("o_orderkey", "o_totalprice")
    return quality.decimal_overflow(raw, "o_orderkey", {"o_totalprice": "decimal(7,2)"})


# ---------------------------------------------------------------------------
# Change application
# ---------------------------------------------------------------------------
from tallyframe.operators import changes  # noqa: E402
from tallyframe.schemas import RULE_SETS  # noqa: E402

AS_OF = "2024-02-01 00:00:00"
SESSION_AS_OF = "2024-01-25 00:00:00"
_BANK_COLS = [f.name for f in LEDGER_SCHEMAS["bank_accounts"].fields]


def _bank_changes(led: Ledger):
    return feeds.bank_feed(landed.bank_link_replies(led)).selectExpr(
        "user_id", "item_id AS plaid_item_id", "name", "institution AS bank_name", "account_type", "last4",
        "balance", "currency", "'verified' AS status", "link_id", "pos")


_BANK_TYPES = {f.name: duck_type(f.dataType.simpleString()) for f in LEDGER_SCHEMAS["bank_accounts"].fields}
_UPSERT_COLS = ["name", "bank_name", "account_type", "last4", "balance", "currency", "status"]


def _bank_upsert_sql() -> str:
    src = {"name": "c.name", "bank_name": "c.institution", "account_type": "c.account_type",
           "last4": "c.last4", "balance": "c.balance", "currency": "c.currency", "status": "'verified'"}
    null = src | {"id": "(SELECT max(id) FROM bank_accounts) + c.nth", "user_id": "c.user_id",
                  "created_at": f"TIMESTAMP '{AS_OF}'", "updated_at": f"TIMESTAMP '{AS_OF}'"}
    sel = []
    for col in _BANK_COLS:
        if col == "id":
            sel.append("coalesce(t.id, (SELECT max(id) FROM bank_accounts) + c.attempt) AS id")
        elif col == "user_id":
            sel.append("CASE WHEN t.id IS NULL THEN c.user_id ELSE t.user_id END AS user_id")
        elif col in src:
            sel.append(f"CASE WHEN c.item_id IS NOT NULL THEN {src[col]} ELSE t.{col} END AS {col}")
        elif col == "plaid_item_id":
            sel.append("coalesce(t.plaid_item_id, c.item_id) AS plaid_item_id")
        elif col == "created_at":
            sel.append(f"CASE WHEN t.id IS NULL THEN TIMESTAMP '{AS_OF}' ELSE t.created_at END AS created_at")
        elif col == "updated_at":
            sel.append(f"CASE WHEN c.item_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE t.updated_at END AS updated_at")
        else:
            sel.append(f"t.{col}")
    return with_ledger(f"""
SELECT {', '.join(sel)},
       CASE WHEN t.id IS NOT NULL AND c.item_id IS NOT NULL THEN 'updated'
            WHEN t.id IS NULL THEN 'inserted' ELSE 'unchanged' END AS change,
       coalesce(c.n_changes, 0) AS n_changes
FROM (SELECT * FROM bank_accounts WHERE plaid_item_id IS NOT NULL) t
FULL OUTER JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY link_id DESC, pos DESC) AS rn,
                                       count(*) OVER (PARTITION BY item_id) AS n_changes,
                                       min(nth) OVER (PARTITION BY item_id) AS attempt
                                FROM attempts WHERE item_id IS NOT NULL) x WHERE rn = 1) c
  ON t.plaid_item_id = c.item_id
UNION ALL
SELECT {', '.join(f"CAST({null.get(col, 'NULL')} AS {_BANK_TYPES[col]}) AS {col}" for col in _BANK_COLS)}, 'inserted', CAST(1 AS BIGINT)
FROM attempts c WHERE item_id IS NULL
UNION ALL
SELECT *, 'unchanged', CAST(0 AS BIGINT) FROM bank_accounts WHERE plaid_item_id IS NULL""", "bank_accounts",
                       extra_ctes=(f"attempts AS (SELECT *, row_number() OVER (ORDER BY link_id, pos) AS nth FROM ({_BANK_FEED_SQL}) f)",))


@query("bank_upsert", oracle=_bank_upsert_sql())
def q_bank_upsert(spark, sf_dir):
    """D1 + W3 (Q13, Q14): upsert every parsed bank-link account into the account
    snapshot on item id; the last account of an item wins, seven columns are
    overwritten, owner/id/created_at kept, NULL item ids untouched."""
    led = L(spark, sf_dir)
    return changes.upsert(led.bank_accounts, _bank_changes(led), "plaid_item_id", _UPSERT_COLS,
                          ["link_id", "pos"], AS_OF)


def _PCT_VALID():
    """The update route refuses percentages outside 0..100 (and missing ones)."""
    return F.col("percentage").between(0, 100)


def _rule_changes(led: Ledger):
    """Percentage edits: one per event; every 4th targets another owner's rule."""
    return led.driver("events").selectExpr(
        "event_id", "ts",
        "CAST(user_id * 10 + (event_id % 6) + 1 AS BIGINT) AS id",
        "CAST(CASE WHEN event_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS BIGINT) AS user_id",
        "try_cast(get_json_object(props, '$.k') AS DECIMAL(5,2)) AS percentage")


_RULE_CHANGES_SQL = """rule_changes AS (
  SELECT event_id, ts, CAST(user_id * 10 + (event_id % 6) + 1 AS BIGINT) AS id,
         CAST(CASE WHEN event_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS BIGINT) AS user_id,
         TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(5,2)) AS percentage
  FROM events)"""


@query("apply_updates", oracle=with_ledger(f"""
SELECT r.id, r.user_id, r.name,
       CAST(CASE WHEN c.id IS NOT NULL THEN c.percentage ELSE r.percentage END AS DECIMAL(5,2)) AS percentage,
       r.color, r.is_locked, r.is_auto, r.created_at,
       CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE r.updated_at END AS updated_at,
       c.id IS NOT NULL AS changed
FROM allocation_rules r
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, user_id ORDER BY ts DESC, event_id DESC) AS rn
                          FROM rule_changes WHERE percentage BETWEEN 0 AND 100) x WHERE rn = 1) c
  ON c.id = r.id AND c.user_id = r.user_id""", "allocation_rules", extra_ctes=(_RULE_CHANGES_SQL,)))
def q_apply_updates(spark, sf_dir):
    """D4 + D8: owner-checked percentage updates (values outside 0..100 refused, last
    valid edit per rule wins) applied to the rule snapshot, touching updated_at of
    changed rows."""
    led = L(spark, sf_dir)
    snap, _ = changes.apply_updates(led.allocation_rules, _rule_changes(led), ["percentage"],
                                    ["ts", "event_id"], AS_OF, valid=_PCT_VALID())
    return snap


def _wallet_deletes(led: Ledger):
    """Wallet delete requests: one per event."""
    return led.driver("events").selectExpr(
        "event_id AS request_id", "CAST(event_id div 5 AS BIGINT) AS id", "CAST(user_id % 25 AS BIGINT) AS user_id")


_WALLET_DELETES_SQL = """wallet_deletes AS (
  SELECT event_id AS request_id, CAST(event_id // 5 AS BIGINT) AS id, CAST(user_id % 25 AS BIGINT) AS user_id
  FROM events)"""


@query("apply_deletes", oracle=with_ledger("""
SELECT * FROM crypto_wallets w
WHERE EXISTS (SELECT 1 FROM wallet_deletes d WHERE d.id = w.id AND d.user_id = w.user_id)""",
                                         "crypto_wallets", extra_ctes=(_WALLET_DELETES_SQL,)))
def q_apply_deletes(spark, sf_dir):
    """Owner-checked wallet deletes; returns the deleted rows (RETURNING *)."""
    led = L(spark, sf_dir)
    _, deleted, _ = changes.apply_deletes(led.crypto_wallets, _wallet_deletes(led))
    return deleted


@query("delete_survivors", oracle=with_ledger("""
SELECT * FROM crypto_wallets w
WHERE NOT EXISTS (SELECT 1 FROM wallet_deletes d WHERE d.id = w.id AND d.user_id = w.user_id)""",
                                            "crypto_wallets", extra_ctes=(_WALLET_DELETES_SQL,)))
def q_delete_survivors(spark, sf_dir):
    """The wallet snapshot after the owner-checked deletes."""
    led = L(spark, sf_dir)
    survivors, _, _ = changes.apply_deletes(led.crypto_wallets, _wallet_deletes(led))
    return survivors


@query("change_rejects", oracle=with_ledger("""
SELECT 'rule_update' AS request_kind, event_id AS request_id, id, user_id, 'not found or not owned' AS reason
FROM rule_changes c
WHERE percentage BETWEEN 0 AND 100
  AND NOT EXISTS (SELECT 1 FROM allocation_rules r WHERE r.id = c.id AND r.user_id = c.user_id)
UNION ALL
SELECT 'rule_update', event_id, id, user_id, 'invalid value' FROM rule_changes
WHERE NOT coalesce(percentage BETWEEN 0 AND 100, FALSE)
UNION ALL
SELECT 'wallet_delete', request_id, id, user_id, 'not found or not owned' FROM wallet_deletes d
WHERE NOT EXISTS (SELECT 1 FROM crypto_wallets w WHERE w.id = d.id AND w.user_id = d.user_id)""",
                                          "allocation_rules", "crypto_wallets",
                                          extra_ctes=(_RULE_CHANGES_SQL, _WALLET_DELETES_SQL)))
def q_change_rejects(spark, sf_dir):
    """Update and delete requests that were refused: invalid percentage, or no
    row of the requesting owner (not found, or another owner's row)."""
    led = L(spark, sf_dir)
    _, upd_rej = changes.apply_updates(led.allocation_rules, _rule_changes(led), ["percentage"],
                                       ["ts", "event_id"], AS_OF, valid=_PCT_VALID())
    _, _, del_rej = changes.apply_deletes(led.crypto_wallets, _wallet_deletes(led))
    return (upd_rej.selectExpr("'rule_update' AS request_kind", "event_id AS request_id", "id", "user_id", "reason")
            .unionByName(del_rej.selectExpr("'wallet_delete' AS request_kind", "request_id", "id", "user_id",
                                            "'not found or not owned' AS reason")))


def _user_requests(led: Ledger):
    """User-creation requests: one per event. Every third asks for an e-mail a
    customer already has (typed in another case, with spaces); every seventh leaves
    the last name blank; the role comes from the event value."""
    return led.driver("events").selectExpr(
        "event_id AS request_id",
        "CASE WHEN event_id % 3 = 0 THEN ' Customer#' || lpad(CAST(user_id AS STRING), 9, '0') || '@Example.com' "
        "ELSE 'new' || CAST(user_id AS STRING) || '@example.com' END AS email",
        "'First' || CAST(event_id AS STRING) AS first_name",
        "CASE WHEN event_id % 7 = 0 THEN '  ' ELSE 'Last' || CAST(user_id AS STRING) END AS last_name",
        "CASE WHEN value > 40 THEN 'auditor' WHEN value < 5 THEN 'owner' ELSE NULL END AS role")


_USER_REQ_SQL = """reqs AS (
  SELECT event_id AS request_id,
         lower(trim(CASE WHEN event_id % 3 = 0 THEN ' Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@Example.com'
                         ELSE 'new' || CAST(user_id AS VARCHAR) || '@example.com' END)) AS email,
         trim('First' || CAST(event_id AS VARCHAR)) AS first_name,
         trim(CASE WHEN event_id % 7 = 0 THEN '  ' ELSE 'Last' || CAST(user_id AS VARCHAR) END) AS last_name,
         coalesce(CASE WHEN value > 40 THEN 'auditor' WHEN value < 5 THEN 'owner' ELSE NULL END, 'user') AS role
  FROM events)"""


_USER_CREATE_BODY = """
SELECT request_id, email, first_name, last_name, role,
       CASE WHEN err IS NULL THEN 'active' END AS status, err IS NULL AS accepted, err AS error
FROM (
  SELECT r.*,
         CASE WHEN coalesce(r.email, '') = '' OR coalesce(r.first_name, '') = '' OR coalesce(r.last_name, '') = ''
                THEN 'Email, password, first name, and last name are required.'
              WHEN r.role NOT IN ('admin', 'user', 'auditor') THEN 'Invalid role.'
              WHEN EXISTS (SELECT 1 FROM users u WHERE lower(trim(u.email)) = r.email)
                   OR r.request_id <> (SELECT min(r2.request_id) FROM reqs r2
                                       WHERE r2.email = r.email AND coalesce(r2.email, '') <> ''
                                         AND coalesce(r2.first_name, '') <> '' AND coalesce(r2.last_name, '') <> ''
                                         AND r2.role IN ('admin', 'user', 'auditor'))
                THEN 'A user with this email already exists.' END AS err
  FROM reqs r) x"""


@query("user_create", oracle=with_ledger(_USER_CREATE_BODY, "users", extra_ctes=(_USER_REQ_SQL,)))
def q_user_create(spark, sf_dir):
    """Admin user creation (X12, V3, J1, D3, D11): every event's request
    normalised, checked for required fields, allowed role and an e-mail that is new
    (in the table and earlier in the batch); accepted rows are the new active users."""
    led = L(spark, sf_dir)
    return changes.create_users(led.users, _user_requests(led))


_STATUSES = ["active", "suspended", "deleted"]


def _status_changes(led: Ledger):
    """Status changes by an admin: one per event, for user ``user_id * 7``;
    the status cycles through the allowed values plus one that is not allowed."""
    return led.driver("events").selectExpr(
        "event_id", "ts", "CAST(user_id * 7 AS BIGINT) AS id",
        "CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'suspended' WHEN 2 THEN 'deleted' "
        "ELSE 'banned' END AS status")


_USER_STATUS_BODY = f"""
SELECT u.id, u.email, u.password_hash, u.first_name, u.last_name, u.role,
       CASE WHEN c.id IS NOT NULL THEN c.status ELSE u.status END AS status,
       u.stripe_customer_id, u.last_login, u.created_at,
       CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE u.updated_at END AS updated_at,
       c.id IS NOT NULL AS changed
FROM users u LEFT JOIN (
  SELECT id, status FROM (
    SELECT id, status, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS rn
    FROM (SELECT event_id, ts, CAST(user_id * 7 AS BIGINT) AS id,
                 CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'suspended' WHEN 2 THEN 'deleted'
                      ELSE 'banned' END AS status
          FROM events) e
    WHERE status IN ('active', 'suspended', 'deleted')) x WHERE rn = 1) c ON c.id = u.id"""


@query("user_status_update", oracle=with_ledger(_USER_STATUS_BODY, "users"))
def q_user_status_update(spark, sf_dir):
    """D4 (user status) + D8: admin status changes without an owner check; values
    outside active/suspended/deleted are refused; the last valid change per user
    applies and touches updated_at."""
    led = L(spark, sf_dir)
    snap, _ = changes.apply_updates(led.users, _status_changes(led), ["status"], ["ts", "event_id"], AS_OF,
                                    keys=("id",), valid=F.col("status").isin(_STATUSES))
    return snap


def _rule_deletes(led: Ledger):
    """Rule delete requests: one per event, for one of the user's rules."""
    return led.driver("events").selectExpr(
        "event_id AS request_id", "CAST(user_id * 10 + (event_id % 6) + 1 AS BIGINT) AS id",
        "CAST(user_id AS BIGINT) AS user_id")


def _bank_deletes(led: Ledger):
    """Bank account delete requests: one per event."""
    return led.driver("events").selectExpr(
        "event_id AS request_id", "CAST(event_id div 7 AS BIGINT) AS id", "CAST(user_id % 25 AS BIGINT) AS user_id")


@query("rule_deletes", oracle=with_ledger("""
SELECT * FROM allocation_rules r WHERE EXISTS (
  SELECT 1 FROM events e WHERE CAST(e.user_id * 10 + (e.event_id % 6) + 1 AS BIGINT) = r.id AND CAST(e.user_id AS BIGINT) = r.user_id)""",
                                        "allocation_rules"))
def q_rule_deletes(spark, sf_dir):
    """D5 (rules): owner-checked rule deletes, one request per event; returns
    the deleted rows."""
    led = L(spark, sf_dir)
    _, deleted, _ = changes.apply_deletes(led.allocation_rules, _rule_deletes(led))
    return deleted


@query("bank_deletes", oracle=with_ledger("""
SELECT * FROM bank_accounts b WHERE EXISTS (
  SELECT 1 FROM events e WHERE CAST(e.event_id // 7 AS BIGINT) = b.id AND CAST(e.user_id % 25 AS BIGINT) = b.user_id)""",
                                        "bank_accounts"))
def q_bank_deletes(spark, sf_dir):
    """D5 (accounts): owner-checked bank account deletes, one request per
    event; returns the deleted rows."""
    led = L(spark, sf_dir)
    _, deleted, _ = changes.apply_deletes(led.bank_accounts, _bank_deletes(led))
    return deleted


def _gateway_toggles(led: Ledger):
    """Enable/disable requests: one per event, for gateway ``user_id`` by owner
    ``user_id % 25``; the new flag comes from the event value."""
    return led.driver("events").selectExpr(
        "event_id", "ts", "CAST(user_id AS BIGINT) AS id", "CAST(user_id % 25 AS BIGINT) AS user_id",
        "value > 25 AS is_enabled")


@query("gateway_toggle", oracle=with_ledger(f"""
SELECT g.id, g.user_id, g.name, g.api_key, g.webhook_secret, g.fee, g.fixed_fee,
       CASE WHEN c.id IS NOT NULL THEN c.is_enabled ELSE g.is_enabled END AS is_enabled,
       g.monthly_volume, g.transaction_count, g.created_at,
       CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE g.updated_at END AS updated_at,
       c.id IS NOT NULL AS changed
FROM payment_gateways g LEFT JOIN (
  SELECT id, user_id, is_enabled FROM (
    SELECT CAST(user_id AS BIGINT) AS id, CAST(user_id % 25 AS BIGINT) AS user_id, value > 25 AS is_enabled,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) x WHERE rn = 1) c
  ON c.id = g.id AND c.user_id = g.user_id""", "payment_gateways"))
def q_gateway_toggle(spark, sf_dir):
    """D4 (gateway flag) + D8: owner-checked enable/disable of gateways; the last
    request per gateway wins; requests for another owner's gateway change nothing."""
    led = L(spark, sf_dir)
    snap, _ = changes.apply_updates(led.payment_gateways, _gateway_toggles(led), ["is_enabled"],
                                    ["ts", "event_id"], AS_OF)
    return snap


_CHILD_TABLES = ["refresh_tokens", "crypto_wallets", "bank_accounts", "payment_gateways",
                 "allocation_rules", "transactions"]


def _removed(led: Ledger):
    return led.users.where("status = 'suspended'")


@query("cascade_delete", oracle=with_ledger("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_before, "
    f"count(*) FILTER (WHERE user_id IN (SELECT id FROM users WHERE status = 'suspended')) AS n_removed, "
    f"count(*) FILTER (WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM users WHERE status = 'suspended')) AS n_kept "
    f"FROM {t}" for t in _CHILD_TABLES), "users", *_CHILD_TABLES))
def q_cascade_delete(spark, sf_dir):
    """Removing every suspended user cascades over the six child tables; rows
    before, removed and kept per table."""
    led = L(spark, sf_dir)
    return changes.cascade_summary({t: getattr(led, t) for t in _CHILD_TABLES}, _removed(led))


@query("cascade_survivors", oracle=with_ledger("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, id, user_id FROM {t} "
    f"WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM users WHERE status = 'suspended')"
    for t in _CHILD_TABLES), "users", *_CHILD_TABLES))
def q_cascade_survivors(spark, sf_dir):
    """The rows of all six child tables that stay once the suspended users are removed."""
    led = L(spark, sf_dir)
    kept = changes.cascade_delete({t: getattr(led, t) for t in _CHILD_TABLES}, _removed(led))
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(t).alias("table_name"), "id", "user_id") for t, df in kept.items()])


@query("audit_set_null", oracle=with_ledger("""
SELECT a.id, CASE WHEN s.id IS NULL THEN a.user_id END AS user_id, a.action, a.resource, a.details,
       a.ip_address, a.created_at, s.id IS NOT NULL AS actor_removed
FROM audit_logs a LEFT JOIN (SELECT id FROM users WHERE status = 'suspended') s ON s.id = a.user_id""",
                                          "users", "audit_logs"))
def q_audit_set_null(spark, sf_dir):
    """Audit rows of removed (suspended) users keep their row with a NULL actor."""
    led = L(spark, sf_dir)
    return changes.audit_set_null(led.audit_logs, _removed(led))


@query("fill_customer_id", oracle=with_ledger("""
SELECT u.id, coalesce(u.stripe_customer_id, p.customer_id) AS stripe_customer_id,
       u.stripe_customer_id IS NULL AND p.customer_id IS NOT NULL AS filled
FROM users u LEFT JOIN (
  SELECT user_id, customer_id FROM (
    SELECT user_id, 'cus_' || CAST(event_id AS VARCHAR) AS customer_id,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
    FROM events) x WHERE rn = 1) p ON p.user_id = u.id""", "users"))
def q_fill_customer_id(spark, sf_dir):
    """D10 (Q23): give users without a processor customer id the id from their first
    event; existing ids are kept."""
    led = L(spark, sf_dir)
    proposals = led.driver("events").selectExpr(
        "user_id", "'cus_' || CAST(event_id AS STRING) AS customer_id", "ts", "event_id")
    return changes.fill_customer_id(led.users, proposals, ["ts", "event_id"])


_LATEST_SESSION_SQL = """latest AS (
  SELECT id, user_id, token, expires_at, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
    FROM refresh_tokens WHERE user_id IS NOT NULL) x WHERE rn = 1)"""


@query("latest_session", oracle=with_ledger("SELECT user_id, id, token, expires_at, created_at FROM latest",
                                          "refresh_tokens", extra_ctes=(_LATEST_SESSION_SQL,)))
def q_latest_session(spark, sf_dir):
    """D2 + W3 (Q15): one session per user, the latest signup's token with its
    7-day expiry."""
    return changes.latest_session(L(spark, sf_dir).refresh_tokens)


@query("rotate_sessions", oracle=with_ledger("""
SELECT l.user_id, l.id, coalesce(r.token, l.token) AS token,
       coalesce(r.ts + INTERVAL 7 DAY, l.expires_at) AS expires_at, l.created_at, r.token IS NOT NULL AS rotated
FROM latest l LEFT JOIN (
  SELECT user_id, token, ts FROM (
    SELECT user_id, 'rt_rot_' || CAST(event_id AS VARCHAR) AS token, ts,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'rt_rot_' || CAST(event_id AS VARCHAR) DESC) AS rn
    FROM events) x WHERE rn = 1) r ON r.user_id = l.user_id""",
                                           "refresh_tokens", extra_ctes=(_LATEST_SESSION_SQL,)))
def q_rotate_sessions(spark, sf_dir):
    """D9 + X20: rotate each user's session on their latest event: new token,
    expiry seven days after it."""
    led = L(spark, sf_dir)
    rotations = led.driver("events").selectExpr(
        "user_id", "'rt_rot_' || CAST(event_id AS STRING) AS token", "ts AS at")
    return changes.rotate_sessions(changes.latest_session(led.refresh_tokens), rotations)


@query("live_sessions", oracle=with_ledger(f"""
SELECT l.user_id, l.id, l.token, l.expires_at, l.created_at, lower(trim(u.email)) AS email,
       u.first_name, u.last_name, u.role
FROM latest l JOIN users u ON u.id = l.user_id
WHERE l.expires_at > TIMESTAMP '{SESSION_AS_OF}'""", "refresh_tokens", "users", extra_ctes=(_LATEST_SESSION_SQL,)))
def q_live_sessions(spark, sf_dir):
    """F14 + J10 + X20: sessions whose expiry (signup + 7 days) is after the as-of
    time, joined to existing users."""
    led = L(spark, sf_dir)
    return changes.live_sessions(changes.latest_session(led.refresh_tokens), led.users, SESSION_AS_OF)


@query("session_check", oracle=with_ledger(f"""
SELECT request_id, user_id,
       CASE WHEN error IS NULL THEN lower(trim(email)) END AS email,
       CASE WHEN error IS NULL THEN first_name END AS first_name,
       CASE WHEN error IS NULL THEN last_name END AS last_name,
       CASE WHEN error IS NULL THEN role END AS role, error IS NULL AS accepted, error
FROM (SELECT e.event_id AS request_id, CAST(e.user_id AS BIGINT) AS user_id, u.email, u.first_name, u.last_name, u.role,
             CASE WHEN NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = e.user_id
                                   AND l.token = 'rt_' || CAST(e.event_id AS VARCHAR)
                                   AND l.expires_at > TIMESTAMP '{SESSION_AS_OF}') THEN 'Invalid or expired refresh token.'
                  WHEN u.id IS NULL THEN 'User not found.' END AS error
      FROM events e LEFT JOIN users u ON u.id = e.user_id) x""", "refresh_tokens", "users",
                                         extra_ctes=(_LATEST_SESSION_SQL,)))
def q_session_check(spark, sf_dir):
    """every event presents a token; only a user's latest, unexpired one passes."""
    led = L(spark, sf_dir)
    asked = led.driver("events").selectExpr("event_id AS request_id", "CAST(user_id AS BIGINT) AS user_id",
                                            "'rt_' || CAST(event_id AS STRING) AS token")
    return changes.session_check(changes.latest_session(led.refresh_tokens), led.users, asked, SESSION_AS_OF)


def _wallet_adds(led: Ledger):
    """Add-wallet requests: one per order (two orders ask for each address)."""
    return led.driver("orders").selectExpr(
        "o_orderkey AS request_id", "CAST(o_orderkey % 25 AS BIGINT) AS user_id",
        "'Wallet ' || CAST(o_orderkey AS STRING) AS name",
        "'0x' || lpad(lower(hex((o_orderkey div 2) * 7919)), 40, '0') AS address",
        "'ETH' AS symbol", "'Ethereum' AS network",
        "CAST(NULL AS DECIMAL(20,8)) AS balance", "CAST(NULL AS DECIMAL(20,2)) AS balance_usd",
        "CAST(NULL AS BOOLEAN) AS is_verified")


_WALLET_ADDS_SQL = """adds AS (
  SELECT o_orderkey AS request_id, CAST(o_orderkey % 25 AS BIGINT) AS user_id,
         'Wallet ' || CAST(o_orderkey AS VARCHAR) AS name,
         '0x' || lpad(lower(hex((o_orderkey // 2) * 7919)), 40, '0') AS address,
         'ETH' AS symbol, 'Ethereum' AS network, CAST(NULL AS DECIMAL(20,8)) AS balance,
         CAST(NULL AS DECIMAL(20,2)) AS balance_usd, CAST(NULL AS BOOLEAN) AS is_verified
  FROM orders)"""
_FIRST_NEW_ADDS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY request_id) AS rn FROM adds) x
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM crypto_wallets w WHERE w.address = x.address)"""


@query("existing_keys", oracle=with_ledger(
    "SELECT * FROM adds a WHERE EXISTS (SELECT 1 FROM crypto_wallets w WHERE w.address = a.address)",
    "crypto_wallets", extra_ctes=(_WALLET_ADDS_SQL,)))
def q_existing_keys(spark, sf_dir):
    """Add-wallet requests whose address already exists ('Wallet already exists')."""
    led = L(spark, sf_dir)
    return changes.existing_keys(_wallet_adds(led), led.crypto_wallets, "address")


@query("insert_absent", oracle=with_ledger(
    f"SELECT request_id, user_id, name, address, symbol, network, balance, balance_usd, is_verified FROM ({_FIRST_NEW_ADDS}) y",
    "crypto_wallets", extra_ctes=(_WALLET_ADDS_SQL,)))
def q_insert_absent(spark, sf_dir):
    """J2 + D3: add-wallet requests inserted only for new addresses; of two requests
    for one address the first wins."""
    led = L(spark, sf_dir)
    return changes.insert_absent(led.crypto_wallets, _wallet_adds(led), "address", ["request_id"])


@query("default_fill", oracle=with_ledger(
    "SELECT request_id, user_id, name, address, symbol, network, CAST(coalesce(balance, 0) AS DECIMAL(20,8)) AS balance, "
    f"CAST(coalesce(balance_usd, 0) AS DECIMAL(20,2)) AS balance_usd, coalesce(is_verified, FALSE) AS is_verified FROM ({_FIRST_NEW_ADDS}) y",
    "crypto_wallets", extra_ctes=(_WALLET_ADDS_SQL,)))
def q_default_fill(spark, sf_dir):
    """The inserted wallets with the column defaults filled (balance 0, USD
    balance 0, not verified)."""
    led = L(spark, sf_dir)
    new = changes.insert_absent(led.crypto_wallets, _wallet_adds(led), "address", ["request_id"])
    return changes.fill_defaults(new, "crypto_wallets")


@query("resolve_owner", oracle=with_ledger("""
SELECT 'Primary BTC Wallet' AS name, 'bc1qseed' || CAST(c_custkey AS VARCHAR) AS address, 'BTC' AS symbol,
       'bitcoin' AS network, lower(c_name) || '@example.com' AS owner_email, u.id AS user_id
FROM customer c JOIN users u ON lower(trim(u.email)) = lower(trim(lower(c.c_name) || '@example.com'))""", "users"))
def q_resolve_owner(spark, sf_dir):
    """Seed wallet rows keyed by their owner's e-mail resolve to the owner's id
    by a join on the normalised e-mail."""
    led = L(spark, sf_dir)
    seed = led.driver("customer").selectExpr(
        "'Primary BTC Wallet' AS name", "'bc1qseed' || CAST(c_custkey AS STRING) AS address", "'BTC' AS symbol",
        "'bitcoin' AS network", "lower(c_name) || '@example.com' AS owner_email")
    return changes.resolve_owner(seed, led.users)


_SET_B = [r for r in RULE_SETS if r[0] == "B"]


def _set_b_sql() -> str:
    rows = ", ".join(f"('{n}', CAST({p} AS DECIMAL(5,2)), '{c}', {str(lk).upper()}, {str(au).upper()})"
                     for _, _, n, p, c, lk, au in _SET_B)
    return f"(SELECT * FROM (VALUES {rows}) AS s(name, percentage, color, is_locked, is_auto))"


@query("seed_rules", oracle=with_ledger(f"""
SELECT u.id AS user_id, s.name, s.percentage, s.color, s.is_locked, s.is_auto
FROM users u JOIN {_set_b_sql()} s ON TRUE
WHERE u.role = 'admin'
  AND NOT EXISTS (SELECT 1 FROM allocation_rules r WHERE r.user_id = u.id AND r.name = s.name)""",
                                      "users", "allocation_rules"))
def q_seed_rules(spark, sf_dir):
    """S2 + D3 (Q15): load the literal demo rule set for every admin user, skipping
    (user, rule name) pairs that already exist."""
    led = L(spark, sf_dir)
    from decimal import Decimal

    from tallyframe.sources.seeds import seed_for_users
    rows = [{"name": n, "percentage": Decimal(p), "color": c, "is_locked": lk, "is_auto": au}
            for _, _, n, p, c, lk, au in _SET_B]
    batch = seed_for_users(led.users.where("role = 'admin'"), rows).withColumn(
        "percentage", F.col("percentage").cast("decimal(5,2)"))
    existing = led.allocation_rules.select("user_id", "name")
    return batch.join(existing, ["user_id", "name"], "left_anti").select(
        "user_id", "name", "percentage", "color", "is_locked", "is_auto")


@query("series_rows", oracle="""
WITH small AS (SELECT c_custkey AS user_id FROM customer c
               WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) < 20)
SELECT user_id, 'alloc' AS type, 'Internal' AS gateway, 'alloc' AS method,
       CAST(10 * i AS DECIMAL(20,8)) AS amount, CAST(10 * i AS DECIMAL(20,2)) AS amount_usd,
       'Auto allocation ' || CAST(i AS VARCHAR) AS description, 'settled' AS status,
       'tx_alloc_' || CAST(i AS VARCHAR) AS tx_hash, CAST(0 AS DECIMAL(20,2)) AS fee
FROM small, range(1, 6) t(i)
UNION ALL
SELECT user_id, 'receive', 'Stripe', 'card', CAST(5 * j AS DECIMAL(20,8)), CAST(5 * j AS DECIMAL(20,2)),
       'Micro payment ' || CAST(j AS VARCHAR), 'settled', 'tx_micro_' || CAST(j AS VARCHAR), CAST(0 AS DECIMAL(20,2))
FROM small, range(1, 9) t(j)""")
def q_series_rows(spark, sf_dir):
    """S3 + S4 + U2: for every user with fewer than 20 transactions (the guard), the
    generated series: five alloc rows of 10*i and eight micro receipts of 5*j,
    stacked by unionByName."""
    from tallyframe.sources.seeds import series_rows
    led = L(spark, sf_dir)
    counts = led.driver("orders").groupBy(F.col("o_custkey").alias("user_id")).count()
    users = led.driver("customer").select(F.col("c_custkey").alias("user_id"))
    return series_rows(users, counts, guard=20)


# ---------------------------------------------------------------------------
# Audit, logs, scans
# ---------------------------------------------------------------------------
from tallyframe.session import scratch_path, sized_tasks  # noqa: E402
from tallyframe.sources import audit, tables  # noqa: E402


def _run_audit(led: Ledger):
    return audit.run_audit(allocation.run_records(_runs(led), led.allocation_rules).withColumn("ip_address", F.expr(_IP)))


_ACCEPTED_SQL = f"""accepted AS (
  SELECT r.run_id, r.user_id, r.created_at, r.amount, a.id AS rule_id, a.name AS rule_name, a.percentage,
         {_SHARE_SQL.format(a='r.amount', p='a.percentage')} AS share
  FROM runs r
  JOIN (SELECT user_id, sum(percentage) AS t FROM allocation_rules WHERE is_auto GROUP BY user_id) g
    ON g.user_id = r.user_id AND g.t = 100
  JOIN allocation_rules a ON a.user_id = r.user_id AND a.is_auto)"""


def _audit_append_sql() -> str:
    at = f"TIMESTAMP '{AS_OF}'"
    return recursive(with_ledger(f"""
SELECT user_id, 'run_allocation' AS action, 'allocation' AS resource,
       to_json({{'amount': CAST(amount AS DECIMAL(20,2)), 'source': 'all',
                 'allocations': list({{'ruleId': rule_id, 'ruleName': rule_name, 'amount': share,
                                      'percentage': CAST(percentage AS DECIMAL(18,2))}} ORDER BY rule_id)}})::VARCHAR AS details,
       {_IP_SQL} AS ip_address, created_at, run_id AS ref_id
FROM accepted GROUP BY run_id, user_id, created_at, amount
UNION ALL
SELECT user_id, 'add_rule', 'allocation_rules',
       to_json({{'name': name, 'percentage': CAST(pct AS DECIMAL(18,2))}})::VARCHAR, ip_address, asked_at, request_id
FROM accepted_rules WHERE ok
UNION ALL
SELECT user_id, 'add_wallet', 'crypto_wallets',
       to_json({{'name': name, 'address': address, 'symbol': symbol, 'network': network}})::VARCHAR, {_IP_SQL}, {at}, request_id
FROM ({_FIRST_NEW_ADDS}) a
UNION ALL
SELECT user_id, 'delete_wallet', 'crypto_wallets', to_json({{'id': id}})::VARCHAR, {_IP_SQL}, {at}, id
FROM crypto_wallets w WHERE EXISTS (SELECT 1 FROM wallet_deletes d WHERE d.id = w.id AND d.user_id = w.user_id)
UNION ALL
SELECT user_id, 'link_bank', 'bank_accounts', to_json({{'institution': institution, 'accounts': count(*)}})::VARCHAR,
       {_IP_SQL}, {at}, link_id
FROM ({_BANK_FEED_SQL}) f GROUP BY link_id, user_id, institution
UNION ALL
SELECT user_id, 'login', 'auth', CAST(NULL AS VARCHAR), {_IP_SQL}, created_at, id FROM refresh_tokens
UNION ALL
SELECT user_id, 'create_user', 'users', to_json({{'email': email, 'role': role}})::VARCHAR, {_IP_SQL}, {at},
       request_id
FROM (SELECT uc.*, CAST(e.user_id AS BIGINT) AS user_id FROM ({_USER_CREATE_BODY}) uc JOIN events e ON e.event_id = uc.request_id) c
WHERE accepted
UNION ALL
SELECT user_id, 'change_user_status', 'users',
       to_json({{'target_user_id': id, 'status': status}})::VARCHAR, {_IP_SQL}, {at}, id
FROM (SELECT us.*, CAST(id // 7 AS BIGINT) AS user_id FROM ({_USER_STATUS_BODY}) us) c WHERE changed
UNION ALL
SELECT user_id, 'delete_rule', 'allocation_rules', to_json({{'id': id}})::VARCHAR, {_IP_SQL}, {at}, id
FROM allocation_rules r WHERE EXISTS (
  SELECT 1 FROM events e WHERE CAST(e.user_id * 10 + (e.event_id % 6) + 1 AS BIGINT) = r.id AND CAST(e.user_id AS BIGINT) = r.user_id)
UNION ALL
SELECT user_id, 'delete_bank', 'bank_accounts', to_json({{'id': id}})::VARCHAR, {_IP_SQL}, {at}, id
FROM bank_accounts b WHERE EXISTS (
  SELECT 1 FROM events e WHERE CAST(e.event_id // 7 AS BIGINT) = b.id AND CAST(e.user_id % 25 AS BIGINT) = b.user_id)""",
        "transactions", "allocation_rules", "crypto_wallets", "users", "refresh_tokens", "bank_accounts",
        extra_ctes=(_RUNS_SQL, _ACCEPTED_SQL, _WALLET_ADDS_SQL, _WALLET_DELETES_SQL, _USER_REQ_SQL, *_ACCEPT_CTES)))


def _audit_rows(led: Ledger):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    rules_ok = acceptance.accept_in_order(led.allocation_rules, _rule_requests(led)).where("accepted")
    added = changes.insert_absent(led.crypto_wallets, _wallet_adds(led), "address", ["request_id"])
    _, deleted, _ = changes.apply_deletes(led.crypto_wallets, _wallet_deletes(led))
    links = (feeds.bank_feed(landed.bank_link_replies(led))
             .groupBy("link_id", "user_id", "institution").agg(F.count("*").alias("accounts")))
    asked = led.driver("events").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("bigint"))
    created = changes.create_users(led.users, _user_requests(led).join(asked, "request_id")).where("accepted")
    status_snap, _ = changes.apply_updates(
        led.users, _status_changes(led).withColumn("user_id", F.expr("id div 7")), ["status"], ["ts", "event_id"], AS_OF,
        keys=("id",), valid=F.col("status").isin(_STATUSES), carry=("user_id",))
    _, rules_gone, _ = changes.apply_deletes(led.allocation_rules, _rule_deletes(led))
    _, banks_gone, _ = changes.apply_deletes(led.bank_accounts, _bank_deletes(led))

    def rows(df, action, resource, details, ref, at=at):
        return audit.action_audit(df.withColumn("at", at).withColumn("ip_address", F.expr(_IP)), action, resource, details,
                                  ref, "at")

    return audit.audit_union([
        rows(led.refresh_tokens, "login", "auth", None, "id", F.col("created_at")),
        rows(created, "create_user", "users", ["email", "role"], "request_id"),
        rows(status_snap.where("changed").select(F.col("id").alias("target_user_id"), "status", "user_id"),
             "change_user_status", "users", ["target_user_id", "status"], "target_user_id"),
        rows(rules_gone, "delete_rule", "allocation_rules", ["id"], "id"),
        rows(banks_gone, "delete_bank", "bank_accounts", ["id"], "id"),
        _run_audit(led),
        rows(rules_ok, "add_rule", "allocation_rules", ["name", "percentage"], "request_id", F.col("asked_at")),
        rows(added, "add_wallet", "crypto_wallets", ["name", "address", "symbol", "network"], "request_id"),
        rows(deleted, "delete_wallet", "crypto_wallets", ["id"], "id"),
        rows(links, "link_bank", "bank_accounts", ["institution", "accounts"], "link_id"),
    ])


@query("audit_append", oracle=_audit_append_sql())
def q_audit_append(spark, sf_dir):
    """S9 + X19: audit rows for all ten of the ledger's actions, built from the jobs
    that perform them: login (each session creation, no details), create_user
    (accepted user requests), change_user_status (applied status changes),
    run_allocation (accepted runs with their allocation list), add_rule (accepted
    rule requests), delete_rule and delete_bank (owner-checked deletes), add_wallet
    (inserted wallets), delete_wallet (deleted wallets) and link_bank (institution and
    account count per link), each with its actor and client address. The rows are appended to
    the date-partitioned sink and read back from it. Tasks are cut by the rows of the tables."""
    led, sink = L(spark, sf_dir), scratch_path(spark, "audit")
    with sized_tasks(spark, sum(led.driver(t).count() for t in ("customer", "orders", "part", "events"))):
        audit.append_audit(_audit_rows(led), sink, period="month")
    return spark.read.parquet(sink).select(audit.AUDIT_COLUMNS)


@query("audit_details", oracle=with_ledger("""
SELECT run_id, user_id, created_at, CAST(amount AS DECIMAL(20,2)) AS amount, 'all' AS source,
       rule_id, rule_name, share, percentage FROM accepted""",
                                         "transactions", "allocation_rules", extra_ctes=(_RUNS_SQL, _ACCEPTED_SQL)))
def q_audit_details(spark, sf_dir):
    """S10 + X19: the run_allocation audit records parsed back from their JSON details
    into one typed row per allocation."""
    return audit.audit_details(_run_audit(L(spark, sf_dir)))


@query("last_run_breakdown", oracle=with_ledger(f"""
SELECT l.user_id, a.id AS rule_id, a.name AS rule_name, a.color, a.percentage, l.amount,
       {_SHARE_SQL.format(a='l.amount', p='a.percentage')} AS share,
       '$' || printf('%,.2f', round({_SHARE_SQL.format(a='l.amount', p='a.percentage')}, 2)) AS share_text,
       t.t <> 100 AS warn, CAST(t.t AS DECIMAL(7,2)) AS all_rules_pct
FROM (SELECT DISTINCT user_id, run_id, CAST(amount AS DECIMAL(20,2)) AS amount FROM (
        SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY created_at DESC, run_id DESC) AS rk
        FROM accepted) x WHERE rk = 1) l
JOIN (SELECT user_id, sum(percentage) AS t FROM allocation_rules GROUP BY user_id) t ON t.user_id = l.user_id
JOIN allocation_rules a ON a.user_id = l.user_id""",
                                              "transactions", "allocation_rules", extra_ctes=(_RUNS_SQL, _ACCEPTED_SQL)))
def q_last_run_breakdown(spark, sf_dir):
    """Each owner's last audited run amount (read back from the audit details,
    not a constant) broken down over all the owner's rules."""
    led = L(spark, sf_dir)
    runs = (audit.audit_details(_run_audit(led))
            .select("run_id", "user_id", "created_at", "amount").distinct())
    return allocation.alloc_preview(allocation.latest_amount(runs), led.allocation_rules)


@query("log_errors", oracle="""
SELECT 'error' AS level, 'event ' || CAST(event_id AS VARCHAR) || ' failed for user ' || CAST(user_id AS VARCHAR) AS message,
       date_trunc('millisecond', ts) AS timestamp
FROM events WHERE event_type = 'error'""")
def q_log_errors(spark, sf_dir):
    """Land the application log as JSON lines (one line per event, millisecond
    ISO timestamps), read it back with its declared schema, keep level 'error'."""
    led = L(spark, sf_dir)
    lines = led.driver("events").select(F.to_json(F.struct(
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.concat(F.lit("event "), F.col("event_id").cast("string"),
                 F.when(F.col("event_type") == "error", F.lit(" failed for user ")).otherwise(F.lit(" ok for user ")),
                 F.col("user_id").cast("string")).alias("message"),
        F.col("ts").cast("timestamp").alias("timestamp"))).alias("value"))
    path = scratch_path(spark, "log")
    lines.write.text(path)
    return (audit.log_errors(audit.read_log(spark, path))
            .select("level", "message", F.col("timestamp").cast("timestamp_ntz").alias("timestamp")))


def _scan_query(name: str, table: str) -> None:
    @query(name, oracle=with_ledger(f"SELECT * FROM {table}", table))
    def scan(spark, sf_dir):
        """Write a ledger table as a Parquet snapshot and scan it back with the declared
        schema (no inference)."""
        root = scratch_path(spark, "ledger")
        tables.write_snapshot(getattr(L(spark, sf_dir), table), root, table)
        return tables.load_table(spark, root, table)


for _table in LEDGER_TABLES:
    _scan_query("ledger_scan" if _table == "transactions" else f"ledger_scan_{_table}", _table)


@query("table_counts", oracle=with_ledger("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in LEDGER_TABLES), *LEDGER_TABLES))
def q_table_counts(spark, sf_dir):
    """Row count of every ledger table (the after-restore check)."""
    return tables.table_counts(_all_tables(L(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Streaming (S8, ST1-ST4)
# ---------------------------------------------------------------------------
from tallyframe.streaming import quota as quota_stream  # noqa: E402
from tallyframe.streaming import webhook  # noqa: E402

_WEBHOOK_SQL = """
SELECT CAST(user_id AS BIGINT) AS user_id, 'receive' AS type, 'Stripe' AS gateway,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'card' END AS method,
       CAST(CAST(CAST(round(value * 100) AS BIGINT) AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(20,8)) AS amount,
       CAST(CAST(CAST(round(value * 100) AS BIGINT) AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(20,2)) AS amount_usd,
       'Order ' || CAST(event_id AS VARCHAR) AS description,
       CASE event_type WHEN 'purchase' THEN 'settled' ELSE 'failed' END AS status,
       'pi_' || CAST(event_id AS VARCHAR) AS tx_hash, ts AS event_time
FROM events WHERE event_type IN ('purchase', 'error')"""


def _ingest(spark, sf_dir, deliveries: int, dedup: bool):
    root = scratch_path(spark, "webhook")
    events = landed.processor_events(L(spark, sf_dir))
    for _ in range(deliveries):            # each delivery lands its own files
        webhook.land_events(events, f"{root}/landing")
    rows = webhook.route_events(webhook.read_events(spark, f"{root}/landing"))
    if dedup:
        rows = webhook.dedupe(rows)
    webhook.run_to_parquet(rows, f"{root}/sink", f"{root}/checkpoint")
    return (spark.read.parquet(f"{root}/sink")
            .withColumn("event_time", F.col("event_time").cast("timestamp_ntz")))


@query("webhook_ingest", oracle=_WEBHOOK_SQL)
def q_webhook_ingest(spark, sf_dir):
    """S8 + ST1 (X10, X21): land every event as a processor webhook delivery, stream
    the landing folder (availableNow) and append routed ledger rows to Parquet."""
    return _ingest(spark, sf_dir, deliveries=1, dedup=False)


@query("webhook_dedup", oracle=_WEBHOOK_SQL)
def q_webhook_dedup(spark, sf_dir):
    """ST4 (Q10): every event delivered twice; the stream drops redeliveries by
    tx_hash, however late, so each event yields one ledger row."""
    return _ingest(spark, sf_dir, deliveries=2, dedup=True)


@query("webhook_unhandled", oracle="""
SELECT 'customer.' || event_type AS type, count(*) AS n_events FROM events
WHERE event_type NOT IN ('purchase', 'error') GROUP BY event_type""")
def q_webhook_unhandled(spark, sf_dir):
    """ST2: unhandled event types counted by a complete-mode streaming aggregate."""
    root = scratch_path(spark, "unhandled")
    webhook.land_events(landed.processor_events(L(spark, sf_dir)), f"{root}/landing")
    counts = webhook.unhandled_counts(webhook.read_events(spark, f"{root}/landing"))
    webhook.run_complete_to_parquet(counts, f"{root}/sink", f"{root}/checkpoint")
    return webhook.read_current(spark, f"{root}/sink")


QUOTA_LIMIT = 1   # the driver's request log is sparse per key and window; see README


@query("quota_breaches", oracle=f"""
SELECT ip, window_start, window_end, n_requests FROM (
  SELECT '10.' || CAST(user_id % 256 AS VARCHAR) || '.0.1' AS ip,
         time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
         time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end,
         count(*) AS n_requests
  FROM events GROUP BY ALL) w
WHERE n_requests > {QUOTA_LIMIT}""")
def q_quota_breaches(spark, sf_dir):
    """ST3 (Q27): stream the landed request log; per client IP and epoch-aligned
    15-minute window, windows with more than QUOTA_LIMIT requests. Late requests count and
    open windows are included: a complete-mode aggregate replaces the report per batch."""
    root = scratch_path(spark, "quota")
    quota_stream.land_requests(landed.request_log(L(spark, sf_dir)), f"{root}/landing")
    breaches = quota_stream.quota_breaches(quota_stream.read_requests(spark, f"{root}/landing"),
                                           max_requests=QUOTA_LIMIT)
    webhook.run_complete_to_parquet(breaches, f"{root}/sink", f"{root}/checkpoint")
    return (webhook.read_current(spark, f"{root}/sink")
            .select("ip", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n_requests"))


# ---------------------------------------------------------------------------
# Session life cycle, first-request windows, several sinks (D2, D9, F14, J10, ST1-ST4, S8)
# ---------------------------------------------------------------------------
from tallyframe.operators import sessions  # noqa: E402
from tallyframe.streaming import keyed, sinks  # noqa: E402

_SESSION_CTES = ("""session_events AS (
  SELECT event_id, CAST(CASE WHEN user_id % 20 = 7 THEN user_id + 100000000 ELSE user_id END AS BIGINT) AS user_id,
         CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' ELSE 'refresh' END AS kind,
         CASE WHEN event_type IN ('signup', 'error') OR event_id % 9 = 0 THEN NULL
              ELSE 'st_' || CAST(CASE WHEN event_id % 5 = 0 THEN lag(event_id, 2) OVER w ELSE lag(event_id) OVER w END AS VARCHAR)
         END AS token, 'st_' || CAST(event_id AS VARCHAR) AS new_token, ts AS happened,
         row_number() OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""", """cycle AS (
  SELECT CAST(NULL AS BIGINT) AS event_id, user_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS TIMESTAMP) AS happened,
         CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS TIMESTAMP) AS until
  FROM (SELECT DISTINCT user_id FROM session_events) u
  UNION ALL
  SELECT event_id, user_id, kind, happened, n, error,
         CASE WHEN error IS NULL AND kind <> 'logout' THEN new_token ELSE held END,
         CASE WHEN error IS NULL AND kind <> 'logout' THEN happened + INTERVAL 7 DAY ELSE until END
  FROM (SELECT e.*, c.held, c.until,
               CASE WHEN e.kind = 'login' THEN CASE WHEN e.user_id NOT IN (SELECT id FROM users) THEN 'Invalid credentials.' END
                    WHEN e.kind = 'refresh' AND coalesce(e.token, '') = '' THEN 'Refresh token required.'
                    WHEN e.kind = 'refresh' AND NOT coalesce(e.token = c.held AND c.until > e.happened, FALSE)
                      THEN 'Invalid or expired refresh token.' END AS error
        FROM cycle c JOIN session_events e ON e.user_id = c.user_id AND e.n = c.n + 1) x)""")

_OUTCOMES_SQL = recursive(with_ledger("""
SELECT event_id, user_id, kind, happened AS at, error IS NULL AS accepted, error,
       CASE WHEN error IS NULL AND kind <> 'logout' THEN held END AS session_token,
       CASE WHEN error IS NULL AND kind <> 'logout' THEN until END AS expires_at
FROM cycle WHERE n > 0""", "users", extra_ctes=_SESSION_CTES))


@query("session_outcomes", oracle=_OUTCOMES_SQL)
def q_session_outcomes(spark, sf_dir):
    """D2 + D9 + F14 + J10 + X20: every sign-in event decided in order: a login replaces the session, a
    refresh rotates it if it presents its unexpired token, all others are refused."""
    led = L(spark, sf_dir)
    return sessions.session_outcomes(landed.session_events(led), led.users)


@query("sessions_after", oracle=recursive(with_ledger("""
SELECT user_id, held AS token, until AS expires_at, until - INTERVAL 7 DAY AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM cycle) x
WHERE back = 1 AND held IS NOT NULL""", "users", extra_ctes=_SESSION_CTES)))
def q_sessions_after(spark, sf_dir):
    """D2 + D9: the session that each user holds after all sign-in events."""
    led = L(spark, sf_dir)
    return sessions.sessions_after(sessions.session_outcomes(landed.session_events(led), led.users))


LANDINGS = 4


def _landed_in_turn(spark, rows, at: str, root: str, run) -> None:
    """Lands ``rows`` in ``LANDINGS`` equal periods of ``at``, one after another, and runs the stream after each: it stops
    and goes on from its checkpoint in between. The rows are built once, and kept by the period they land in."""
    first, last = rows.agg(F.min(at), F.max(at)).first()
    turn = F.lit(LANDINGS - 1)
    for k in reversed(range(1, LANDINGS)):
        turn = F.when(F.col(at) < F.lit(first + (last - first) * k / LANDINGS), k - 1).otherwise(turn)
    rows.where(F.col(at).isNotNull()).withColumn("_turn", turn).write.partitionBy("_turn").parquet(f"{root}/rows")
    for k in range(LANDINGS):
        spark.read.parquet(f"{root}/rows").where(F.col("_turn") == k).select(*rows.columns).write.mode("append").parquet(
            f"{root}/landing")
        run()


@query("session_stream", oracle=_OUTCOMES_SQL)
def q_session_stream(spark, sf_dir):
    """D2 + D9 + F14 + J10 as a stream: the same outcomes from keyed state (``transformWithState``), over four
    landings with a restart between them."""
    led, root = L(spark, sf_dir), scratch_path(spark, "sessions")
    events = landed.session_events(led)
    with keyed.rocksdb(spark, idle_batches=False):
        _landed_in_turn(spark, events, "at", root, lambda: webhook.run_to_parquet(keyed.session_stream(
            spark.readStream.schema(events.schema).parquet(f"{root}/landing"), led.users), f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out")


@query("quota_first_request", oracle=f"""
WITH RECURSIVE requests AS (SELECT {_IP_SQL} AS ip, ts FROM events),
following AS (SELECT a.ip, a.ts, b.ts AS next FROM (SELECT DISTINCT ip, ts FROM requests) a
              ASOF LEFT JOIN (SELECT DISTINCT ip, ts FROM requests) b ON a.ip = b.ip AND b.ts >= a.ts + INTERVAL 15 MINUTE),
opened AS (
  SELECT f.ip, f.ts, f.next FROM following f JOIN (SELECT ip, min(ts) AS ts FROM requests GROUP BY ip) m USING (ip, ts)
  UNION ALL
  SELECT f.ip, f.ts, f.next FROM opened o JOIN following f ON f.ip = o.ip AND f.ts = o.next)
SELECT o.ip, o.ts AS window_start, o.ts + INTERVAL 15 MINUTE AS window_end, count(*) AS n_requests
FROM opened o JOIN requests r ON r.ip = o.ip AND r.ts >= o.ts AND r.ts < o.ts + INTERVAL 15 MINUTE
WHERE o.next IS NOT NULL OR o.ts + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
GROUP BY o.ip, o.ts HAVING count(*) > {QUOTA_LIMIT}""")
def q_quota_first_request(spark, sf_dir):
    """ST3 as the limiter counted: windows of 15 minutes that start at an address's first request, from
    keyed state with event-time timers, over four landings with a restart between them; closed windows
    with more than QUOTA_LIMIT requests."""
    root = scratch_path(spark, "windows")
    requests = landed.request_log(L(spark, sf_dir)).select("event_id", "ip", "ts")
    with keyed.rocksdb(spark):
        _landed_in_turn(spark, requests, "ts", root, lambda: webhook.run_to_parquet(keyed.first_request_windows(
            spark.readStream.schema(requests.schema).parquet(f"{root}/landing"), QUOTA_LIMIT), f"{root}/out",
            f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out")


_SINKS_SQL = f"""
SELECT status AS sink, tx_hash AS object_id, user_id, method, amount_usd, event_time, CAST(NULL AS VARCHAR) AS outcome, CAST(1 AS BIGINT) AS n
FROM ({_WEBHOOK_SQL}) s
UNION ALL
SELECT 'unhandled', 'pi_' || CAST(event_id AS VARCHAR), NULL, NULL, NULL, ts, NULL, 1
FROM events, range(0, 2) twice(k) WHERE event_type NOT IN ('purchase', 'error')
UNION ALL
SELECT 'deliveries', 'pi_' || CAST(event_id AS VARCHAR), NULL, NULL, NULL, NULL, o.outcome, sum(o.n)::BIGINT
FROM events, (VALUES ('stored', 1), ('repeated', 1)) o(outcome, n) WHERE event_type IN ('purchase', 'error') GROUP BY ALL
UNION ALL
SELECT 'deliveries', 'pi_' || CAST(event_id AS VARCHAR), NULL, NULL, NULL, NULL, 'unhandled', 2
FROM events WHERE event_type NOT IN ('purchase', 'error')"""


@query("webhook_sinks", oracle=_SINKS_SQL)
def q_webhook_sinks(spark, sf_dir):
    """S8 + ST1 + ST2 + ST4 + S9: one stream into four sinks, every event delivered twice in different
    micro-batches: settled and failed rows once, unhandled events, and an audit of all deliveries."""
    root = scratch_path(spark, "sinks")
    events = landed.processor_events(L(spark, sf_dir))
    late = F.abs(F.xxhash64("data.object.id")) % LANDINGS
    for k in range(LANDINGS + 1):              # each event lands in turn k and again in turn k + 1
        events.where((late == k) | (late == k - 1)).write.mode("append").parquet(f"{root}/landing")
        sinks.run_sinks(spark.readStream.schema(webhook.EVENT_FILE_SCHEMA).parquet(f"{root}/landing"), f"{root}/out",
                        f"{root}/checkpoint")

    none = lambda t: F.lit(None).cast(t)
    paid = [sinks.read_sink(spark, f"{root}/out", s).select(
        F.lit(s).alias("sink"), F.col("tx_hash").alias("object_id"), "user_id", "method", "amount_usd",
        F.col("event_time").cast("timestamp_ntz").alias("event_time"), none("string").alias("outcome"),
        F.lit(1).cast("bigint").alias("n")) for s in ("settled", "failed")]
    ignored = sinks.read_sink(spark, f"{root}/out", "unhandled").select(
        F.lit("unhandled").alias("sink"), "object_id", none("bigint").alias("user_id"), none("string").alias("method"),
        none("decimal(20,2)").alias("amount_usd"), F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        none("string").alias("outcome"), F.lit(1).cast("bigint").alias("n"))
    audited = sinks.read_sink(spark, f"{root}/out", "deliveries").groupBy("object_id", "outcome").agg(
        F.sum("n_deliveries").alias("n")).select(
        F.lit("deliveries").alias("sink"), "object_id", none("bigint").alias("user_id"), none("string").alias("method"),
        none("decimal(20,2)").alias("amount_usd"), none("timestamp_ntz").alias("event_time"), "outcome", "n")
    return paid[0].unionByName(paid[1]).unionByName(ignored).unionByName(audited)


# ---------------------------------------------------------------------------
# Committed snapshots
# ---------------------------------------------------------------------------
from tallyframe.sources.snapshots import Snapshots  # noqa: E402


@query("snapshot_commits", oracle=with_ledger(f"""
SELECT 0 AS version, id, user_id, name, percentage, updated_at FROM allocation_rules
UNION ALL SELECT 1, id, user_id, name, percentage, updated_at FROM updated
UNION ALL SELECT 2, id, user_id, name, percentage, updated_at FROM updated r WHERE NOT EXISTS (
  SELECT 1 FROM events e WHERE e.event_id % 3 = 0 AND CAST(e.user_id * 10 + (e.event_id % 6) + 1 AS BIGINT) = r.id
                           AND CAST(e.user_id AS BIGINT) = r.user_id)""", "allocation_rules", extra_ctes=(_RULE_CHANGES_SQL, f"""updated AS (
  SELECT r.id, r.user_id, r.name, CAST(CASE WHEN c.id IS NOT NULL THEN c.percentage ELSE r.percentage END AS DECIMAL(5,2)) AS percentage,
         CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE r.updated_at END AS updated_at
  FROM allocation_rules r
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, user_id ORDER BY ts DESC, event_id DESC) AS rn
                            FROM rule_changes WHERE percentage BETWEEN 0 AND 100) x WHERE rn = 1) c
    ON c.id = r.id AND c.user_id = r.user_id)""")))
def q_snapshot_commits(spark, sf_dir):
    """D4 + D5 + D8 committed: the rule table as version 0, with the owner-checked updates as version 1, and without
    the deleted rules as version 2, each commit rewriting the buckets it touches; all three read back."""
    led = L(spark, sf_dir)
    snap = Snapshots(spark, scratch_path(spark, "rules"))
    snap.create(led.allocation_rules)
    edits = _rule_changes(led)
    snap.change(edits.select("id"), lambda part: changes.apply_updates(
        part, edits, ["percentage"], ["ts", "event_id"], AS_OF, valid=_PCT_VALID())[0])
    deletes = _rule_deletes(led).where("request_id % 3 = 0")
    snap.change(deletes.select("id"), lambda part: changes.apply_deletes(part, deletes)[0])
    return reduce(DataFrame.unionByName, [
        snap.read(v).select(F.lit(v).alias("version"), "id", "user_id", "name", "percentage", "updated_at") for v in range(3)])


# ---------------------------------------------------------------------------
# Deep pages and the substring index
# ---------------------------------------------------------------------------
from tallyframe.sources.textindex import TextIndex  # noqa: E402

DEEP_OFFSET = 12_000


@query("tx_deep_page", oracle=with_ledger(
    f"SELECT {TX_COLS_SQL} FROM transactions ORDER BY created_at DESC, id DESC LIMIT 500 OFFSET {DEEP_OFFSET}", "transactions"))
def q_tx_deep_page(spark, sf_dir):
    """O3: a global page far behind the newest transactions, found by row counts of range partitions."""
    return listings.tx_page(L(spark, sf_dir).transactions, limit=500, offset=DEEP_OFFSET)


SEARCH_TERMS = ["Customer#000000011", "ORDER 77", "acct_13", "5", "no such text"]


@query("tx_index_search", oracle=with_ledger("\nUNION ALL\n".join(
    f"SELECT '{t}' AS term, {TX_COLS_SQL} FROM transactions WHERE lower(from_address) LIKE '%{t.lower().replace('_', '!_')}%' ESCAPE '!' "
    f"OR lower(description) LIKE '%{t.lower().replace('_', '!_')}%' ESCAPE '!' OR CAST(id AS VARCHAR) LIKE '%{t.lower().replace('_', '!_')}%' ESCAPE '!'"
    for t in SEARCH_TERMS), "transactions"))
def q_tx_index_search(spark, sf_dir):
    """the transactions that hold each of several terms, by the substring index: blocks from intersected
    three-letter postings, rows verified."""
    index = TextIndex(spark, scratch_path(spark, "text-index")).build(L(spark, sf_dir).transactions, blocks=32)
    return reduce(DataFrame.unionByName, [index.search(t).select(F.lit(t).alias("term"), *listings.TX_COLUMNS) for t in SEARCH_TERMS])


# ---------------------------------------------------------------------------
# Details as VARIANT, rejected lines
# ---------------------------------------------------------------------------
@query("audit_variant", oracle=with_ledger("""
SELECT id, user_id, TRY_CAST(json_extract_string(d, '$.k') AS BIGINT) AS k, json_extract_string(d, '$.nested.tag') AS tag, NULL AS reason
FROM (SELECT id, user_id, CASE WHEN id % 7 = 0 THEN '{"nested":{"tag":"t' || CAST(id AS VARCHAR) || '"}}'
             WHEN id % 41 = 0 THEN NULL ELSE details END AS d FROM audit_logs WHERE id % 31 <> 5) e
UNION ALL
SELECT id, user_id, NULL, NULL, 'details are no JSON' FROM audit_logs WHERE id % 31 = 5""", "audit_logs"))
def q_audit_variant(spark, sf_dir):
    """S10 + X19: audit details of several shapes parsed once into VARIANT, stored, and read by path; cut-off
    details are rejects, and none vanishes."""
    led = L(spark, sf_dir)
    rows = led.audit_logs.select("id", "user_id", F.expr(
        "CASE WHEN id % 31 = 5 THEN left(details, 4) || CAST(id AS STRING) "
        "WHEN id % 7 = 0 THEN '{\"nested\":{\"tag\":\"t' || CAST(id AS STRING) || '\"}}' WHEN id % 41 = 0 THEN NULL ELSE details END").alias("details"))
    parsed, rejects = audit.ingest_details(rows)
    path = scratch_path(spark, "variant")
    parsed.write.parquet(path)
    stored = spark.read.parquet(path).select(
        "id", "user_id", audit.detail("$.k", "bigint").alias("k"), audit.detail("$.nested.tag", "string").alias("tag"),
        F.lit(None).cast("string").alias("reason"))
    return stored.unionByName(rejects.select("id", "user_id", F.lit(None).cast("bigint").alias("k"),
                                             F.lit(None).cast("string").alias("tag"), "reason"))


@query("log_rejects", oracle="""
SELECT CASE WHEN event_id % 23 = 2 THEN 'no level' ELSE 'malformed' END AS reason, count(*) AS n_lines
FROM events WHERE event_id % 23 = 2 OR event_id % 17 = 0 OR event_id % 19 = 1 GROUP BY ALL""")
def q_log_rejects(spark, sf_dir):
    """A log with cut-off lines, plain text and lines without a level: what the error view can't use is
    counted by reason."""
    led = L(spark, sf_dir)
    line = F.to_json(F.struct(F.when(F.expr("event_id % 23 <> 2"), "error").alias("level"),
                              F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
                              F.col("ts").cast("timestamp").alias("timestamp")))
    lines = led.driver("events").select(
        F.when(F.expr("event_id % 23 = 2"), line).when(F.expr("event_id % 17 = 0"), F.substring(line, 1, 25))
        .when(F.expr("event_id % 19 = 1"), F.lit("Error: connection reset")).otherwise(line).alias("value"))
    path = scratch_path(spark, "log")
    lines.write.text(path)
    return audit.log_rejects(spark, path).groupBy("reason").agg(F.count("*").alias("n_lines"))


# ---------------------------------------------------------------------------
# Owner-clustered storage
# ---------------------------------------------------------------------------
from tallyframe.sources import clustered  # noqa: E402

CLUSTER_HOT_ROWS = 200


@query("alloc_run_clustered", oracle=REGISTRY["alloc_run"].oracle)
def q_alloc_run_clustered(spark, sf_dir):
    """S1 + J9 + R4: runs and rules written as tables bucketed by owner (hot owners dealt over slots), then
    allocated bucket by bucket without an exchange."""
    led = L(spark, sf_dir)
    store = clustered.Clustered(spark, buckets=16, hot_rows=CLUSTER_HOT_ROWS)
    runs = store.fact(_runs(led).select("run_id", "user_id", "amount"), "runs", "run_id")
    rules = store.side(led.allocation_rules.select("id", "user_id", "name", "percentage", "is_auto"), "rules")
    return clustered.alloc_run(runs, rules)


# ---------------------------------------------------------------------------
# Key checks through stored Bloom filters
# ---------------------------------------------------------------------------
from tallyframe.sources.keyfilter import KeyFilter  # noqa: E402


@query("existing_keys_filtered", oracle=REGISTRY["existing_keys"].oracle)
def q_existing_keys_filtered(spark, sf_dir):
    """V4 + J1: ``existing_keys`` against the stored wallet addresses: requests are probed by Bloom filter, only the
    buckets of those that remain are read, and each is verified."""
    led = L(spark, sf_dir)
    store = KeyFilter(spark, scratch_path(spark, "addresses"), buckets=32).build(led.crypto_wallets, "address")
    return store.existing(_wallet_adds(led), "address")
