"""Listings, transaction search, paging and statements.

Every listing works for all owners at once; ``user_id=None`` means no owner filter.
Per-owner pages use ``row_number() <= n`` over the owner, which Spark plans with a
partial ``WindowGroupLimit`` ahead of the shuffle: each map task ships at most ``n``
rows per owner, so a hot owner is cut down before it reaches one task. Pages too deep
for that (``GROUP_LIMIT``) take positions from ``ordered_positions``, which splits hot
owners. Listings are sorted before their display texts are made, so that the sort moves
the stored columns only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import money as M
from tallyframe.functions import text as X
from tallyframe.operators.joins import checked_broadcast
from tallyframe.operators.windows import ordered_positions
from tallyframe.schemas import PAGE_LIMIT, PAGE_OFFSET
from tallyframe.session import materialize


#: Rows up to which Spark plans a group limit (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
#: Rows up to the end of a global page that a top-k may gather.
DEEP_PAGE = 10_000


def newest_first() -> list[Column]:
    """O1 with the Q9 tie-break on id."""
    return [F.col("created_at").desc(), F.col("id").desc()]


def oldest_first() -> list[Column]:
    """O2 with the id tie-break."""
    return [F.col("created_at").asc(), F.col("id").asc()]


def _owner(df: DataFrame, user_id) -> DataFrame:
    return df if user_id is None else df.where(F.col("user_id") == F.lit(user_id))


def list_wallets(wallets: DataFrame, user_id=None) -> DataFrame:
    """F1 + X3 + X7 + X17: wallet cards, newest first per owner."""
    return (_owner(wallets, user_id).orderBy(F.col("user_id"), *newest_first())
            .select("id", "user_id", "name", "address", "symbol", "network", "balance",
                    "balance_usd", "is_verified", "created_at",
                    X.short_address("address").alias("short_address"),
                    M.fixed("balance", 4).alias("balance_text"),
                    M.usd_text("balance_usd").alias("balance_usd_text"),
                    X.symbol_color("symbol").alias("color")))


def list_banks(accounts: DataFrame, user_id=None) -> DataFrame:
    """F2 + X15 + X5: bank cards; routing number, item id and access token stay out."""
    return (_owner(accounts, user_id).orderBy(F.col("user_id"), *newest_first())
            .select("id", "user_id", "name", "bank_name", "account_type", "last4", "balance",
                    "currency", "status", "created_at",
                    X.masked_account("last4").alias("masked"),
                    X.status_bucket("status").alias("status_color"),
                    M.usd_text("balance").alias("balance_text")))


def list_gateways(gateways: DataFrame, user_id=None) -> DataFrame:
    """F3 + X16 + X17: gateway cards; API key and webhook secret stay out."""
    return (_owner(gateways, user_id).orderBy(F.col("user_id"), *newest_first())
            .select("id", "user_id", "name", "fee", "fixed_fee", "is_enabled", "monthly_volume",
                    "transaction_count", "created_at",
                    X.fee_label("fee", "fixed_fee").alias("fee_label"),
                    X.gateway_color("name").alias("color"),
                    F.left(F.col("name"), F.lit(1)).alias("initial"),
                    M.usd_text("monthly_volume").alias("volume_text")))


def list_rules(rules: DataFrame, user_id=None) -> DataFrame:
    """F4 + O2: rules oldest first, with their position and the card meta text.

    Positions come from ``ordered_positions`` (range-partitioned, boundary-corrected),
    so an owner with very many rules is not gathered into one task.
    """
    meta = F.concat(F.when(F.col("is_locked"), F.lit("Locked")).otherwise(F.lit("Adjustable")),
                    F.lit(" · "),
                    F.when(F.col("is_auto"), F.lit("Auto-run")).otherwise(F.lit("Manual only")))
    base = _owner(rules, user_id).select("id", "user_id", "name", "percentage", "color", "is_locked",
                                         "is_auto", "created_at")
    return (ordered_positions(base, "user_id", ["created_at", "id"])
            .select("id", "user_id", "name", "percentage", "color", "is_locked", "is_auto",
                    "created_at", "position", meta.alias("meta"))
            .orderBy("user_id", "position"))


def user_directory(users: DataFrame) -> DataFrame:
    """F5 + F9 + F17 + X12 + X14 + X18: user listing without the password hash, e-mail
    normalised, display name, initials and role label; newest first."""
    return users.orderBy(*newest_first()).select(
        "id", X.normalize_email("email").alias("email"),
        F.trim("first_name").alias("first_name"), F.trim("last_name").alias("last_name"),
        "role", "status", "stripe_customer_id", "last_login", "created_at", "updated_at",
        X.display_name("first_name", "last_name", "email").alias("display_name"),
        X.initials("first_name", "last_name").alias("initials"),
        X.capitalize("role").alias("role_label"))


def find_users(users: DataFrame, emails: DataFrame) -> DataFrame:
    """users whose normalised e-mail is in ``emails(email)`` (also normalised)."""
    keys = emails.select(X.normalize_email("email").alias("email_key")).distinct()
    return user_directory(users.join(keys, X.normalize_email("email") == F.col("email_key"), "left_semi"))


def users_by_id(users: DataFrame, requests: DataFrame) -> DataFrame:
    """F9 + F17: the profile (5 columns) and the customer id of the user that each of
    ``requests(request_id, user_id)`` asks for; one row per request, with a reason where
    there is no such user (a NULL id included)."""
    u = users.select("id", "email", "first_name", "last_name", "role", "stripe_customer_id")
    return (requests.select("request_id", "user_id").join(u, F.col("user_id") == F.col("id"), "left")
            .select("request_id", *u.columns, F.when(F.col("id").isNull(), "User not found.").alias("error")))


# ---------------------------------------------------------------------------
# Transaction search
# ---------------------------------------------------------------------------
def gateway_list(gateway: str | None) -> list[str]:
    """split on commas, trim, drop blanks (Q8: a list of only commas is no filter)."""
    if not gateway:
        return []
    return [g.strip() for g in gateway.split(",") if g.strip()]


def page_args(limit=PAGE_LIMIT, offset=PAGE_OFFSET) -> tuple[int, int]:
    """O3: leading integers, as JS ``parseInt`` reads them; unparsable, zero or negative limit
    -> 50, unparsable or negative offset -> 0."""
    def parse(v):
        lead = re.match(r"\s*([+-]?\d+)", str(v))
        return int(lead[1]) if lead else 0
    n, o = parse(limit), parse(offset) or PAGE_OFFSET
    return n if n > 0 else PAGE_LIMIT, max(o, 0)


def tx_filter(txs: DataFrame, user_id=None, type: str | None = None,
              gateway: str | None = None) -> DataFrame:
    """F6/F16/F7 predicates; ``type`` of None, '' or 'all' adds no predicate."""
    df = _owner(txs, user_id)
    if type and type != "all":
        df = df.where(F.col("type") == F.lit(type))
    gws = gateway_list(gateway)
    if len(gws) == 1:
        df = df.where(F.col("gateway") == F.lit(gws[0]))
    elif gws:
        df = df.where(F.col("gateway").isin(gws))
    return df


TX_COLUMNS = ["id", "user_id", "type", "gateway", "method", "amount", "amount_usd",
              "from_address", "to_address", "description", "status", "tx_hash", "fee",
              "created_at"]


def per_owner_page(df: DataFrame, limit: int, offset: int, order: list[Column]) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of each owner in ``order`` (W6, O3 per owner)."""
    w = Window.partitionBy("user_id").orderBy(*order)
    placed = (df.withColumn("position", F.row_number().over(w)) if offset + limit <= GROUP_LIMIT
              else ordered_positions(df, "user_id", order))
    return (placed.where(F.col("position") <= offset + limit).where(F.col("position") > offset)
            .withColumn("position", F.col("position").cast("bigint")))


def tx_search(txs: DataFrame, user_id=None, type: str | None = None, gateway: str | None = None,
              limit=PAGE_LIMIT, offset=PAGE_OFFSET) -> DataFrame:
    """newest-first page of each owner's transactions after the optional filters."""
    n, o = page_args(limit, offset)
    return per_owner_page(tx_filter(txs, user_id, type, gateway).select(*TX_COLUMNS),
                          n, o, newest_first())


def tx_page(txs: DataFrame, limit=PAGE_LIMIT, offset=PAGE_OFFSET) -> DataFrame:
    """O3 without an owner: one global newest-first page. Plans as a top-k
    (TakeOrderedAndProject), never a full sort; pages that end behind ``DEEP_PAGE`` rows go by
    ``deep_page``."""
    n, o = page_args(limit, offset)
    if o + n > DEEP_PAGE:
        return deep_page(txs.select(*TX_COLUMNS), n, o)
    return txs.select(*TX_COLUMNS).orderBy(*newest_first()).offset(o).limit(n)


def deep_page(txs: DataFrame, n: int, offset: int, partitions: int | None = None) -> DataFrame:
    """A page far behind the start, without gathering what is ahead of it: the keys (time, id) are
    range-partitioned once, the rows per partition (one number each, at the driver) tell which partitions
    the page lies in, and only those are sorted. No task holds more than a partition and ``n`` rows.
    The page's rows are fetched by their unique ids."""
    n_parts = partitions or int(txs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(txs.select("created_at", "id").repartitionByRange(n_parts, *newest_first())
                         .withColumn("_pid", F.spark_partition_id()))
    ahead, needed, skip = 0, [], 0
    for pid, size in sorted(ranged.groupBy("_pid").count().collect()):
        if ahead < offset + n and ahead + size > offset:
            skip = skip if needed else offset - ahead
            needed.append(pid)
        ahead += size
    page = ranged.where(F.col("_pid").isin(needed)).orderBy(*newest_first()).offset(skip).limit(n).select("id")
    return txs.join(checked_broadcast(page), "id", "left_semi").orderBy(*newest_first())


def recent_tx(txs: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` newest transactions of every owner."""
    return per_owner_page(txs.select(*TX_COLUMNS), n, 0, newest_first())


def tx_by_id(txs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F8 + A11: point lookups ``requests(id, user_id)``; returns (found rows with all
    columns, not-found requests). Another owner's id is not found."""
    keys = requests.select("id", "user_id")
    found = txs.join(keys, ["id", "user_id"], "left_semi")
    missing = keys.join(txs.select("id", "user_id"), ["id", "user_id"], "left_anti")
    return found, missing


def tx_text_search(txs: DataFrame, term: str | None, user_id=None) -> DataFrame:
    """case-insensitive substring match OR-ed over from_address, description and
    the id as text (Q7); searches all rows, not just one page (Q6)."""
    df = _owner(txs, user_id).select(*TX_COLUMNS)
    if not term:
        return df
    t = F.lit(term.lower())

    def has(c: Column) -> Column:
        return F.coalesce(F.lower(c).contains(t), F.lit(False))
    return df.where(has(F.col("from_address")) | has(F.col("description"))
                    | has(F.col("id").cast("string")))


def tx_statement(txs: DataFrame, user_id=None, type: str | None = None,
                 gateway: str | None = None) -> DataFrame:
    """Statement lines with display texts (X1-X6, X13), newest first per owner.

    Sent amounts are shown as ``-`` + absolute value whatever their stored sign (Q18).
    The output is sorted by (owner, newest first); Spark range-partitions on the full
    sort key, so a hot owner spreads over many tasks.
    """
    df = tx_filter(txs, user_id, type, gateway).orderBy(F.col("user_id"), *newest_first())
    return df.select(
        "id", "user_id", "type", "gateway", "method", "amount_usd", "status", "created_at",
        M.usd_text_signed("amount_usd", "type").alias("amount_text"),
        X.fallback_text("description", "from_address").alias("description_text"),
        X.fallback_text("from_address", "description").alias("bank_description_text"),
        F.coalesce(F.col("method"), F.lit(X.DASH)).alias("method_text"),
        F.coalesce(F.col("gateway"), F.lit(X.DASH)).alias("gateway_text"),
        X.status_bucket("status").alias("status_color"),
        X.type_label("type").alias("type_label"),
        X.type_bucket("type").alias("type_color"),
        X.time_text("created_at").alias("time_text"),
        X.datetime_text("created_at").alias("datetime_text"),
        X.long_date_text("created_at").alias("date_text"),
        X.iso_text("created_at").alias("iso_text"))
