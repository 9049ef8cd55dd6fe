"""Change application over snapshots.

Parquet has no row-level updates, so each operator takes a target snapshot and a
change set and returns DataFrames: the new snapshot, the affected rows (what
``RETURNING`` gave) and the rejected requests (``rows.length === 0`` in the
reference). The caller writes the new snapshot to a new path, never over its input.

Scale notes
-----------
* "Latest/first row per key" (W3) is ``max``/``min`` of a struct ordered by the
  ordering columns: a partial aggregate, so a hot key is combined map-side and never
  gathered into one task.
* Joins are on the table's key (id, item id, address, e-mail): near-unique keys, so
  sort-merge joins stay balanced. Rows with a NULL key never take part in a key join
  (NULLs never match); they bypass it and are unioned back, so a large NULL group
  cannot pile up in the one partition NULLs hash to.
* Joins on ``user_id`` (cascade, set-null) meet the owner skew; AQE's skew-join rule
  splits the hot owner's partitions of the child side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.schemas import DEFAULTS, LEDGER_SCHEMAS, ROLES, SESSION_DAYS
from tallyframe.operators.joins import checked_broadcast
from tallyframe.operators.windows import ordered_positions


def _ts(as_of) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def pick_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool = True,
                 count_as: str | None = None, extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key, the one with the greatest (``last``) or smallest ``order``.

    Ties on ``order`` are broken by the remaining columns, so the pick is deterministic.
    With ``count_as``, the number of rows of the key is added from the same aggregate, and so are
    the named aggregates ``extra``.
    """
    payload = [c for c in df.columns if c not in keys]
    ordered = F.struct(F.struct(*[F.col(c) for c in order]).alias("o"), F.struct(*payload).alias("row"))
    aggs = [(F.max(ordered) if last else F.min(ordered)).alias("_m")]
    if count_as:
        aggs.append(F.count("*").alias(count_as))
    grouped = df.groupBy(*keys).agg(*aggs, *extra)
    return grouped.select(*keys, "_m.row.*", *[c for c in grouped.columns if c not in keys and c != "_m"])


# ---------------------------------------------------------------------------
# Key existence and inserts
# ---------------------------------------------------------------------------
def existing_keys(requests: DataFrame, target: DataFrame, key: str, target_key: str | None = None) -> DataFrame:
    """Requests whose key already exists in the target."""
    tk = target.select(F.col(target_key or key).alias(key)).where(F.col(key).isNotNull())
    return requests.join(tk, key, "left_semi")


def insert_absent(target: DataFrame, inserts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """J2 + D3 (``ON CONFLICT DO NOTHING``): the insert rows whose key is new; among
    several inserts of one key the first by ``order`` wins. Rows with a NULL key
    never conflict and are always inserted."""
    keyed = inserts.where(F.col(key).isNotNull())
    first = pick_per_key(keyed, [key], order, last=False).select(*inserts.columns)
    fresh = first.join(target.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return fresh.unionByName(inserts.where(F.col(key).isNull()))


def fill_defaults(df: DataFrame, table: str) -> DataFrame:
    """Column defaults of the ledger table for missing values."""
    schema = {f.name: f.dataType for f in LEDGER_SCHEMAS[table].fields}
    cols = []
    for c in df.columns:
        if c in DEFAULTS.get(table, {}):
            cols.append(F.coalesce(F.col(c), F.lit(DEFAULTS[table][c]).cast(schema[c])).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def resolve_owner(seed: DataFrame, users: DataFrame, email_col: str = "owner_email") -> DataFrame:
    """Attach ``user_id`` to seed rows by the owner's normalised e-mail (a unique
    key, so no LIMIT is needed); rows of unknown owners are dropped, as the
    ``INSERT ... SELECT`` inserted nothing for them."""
    u = users.select(F.col("id").alias("user_id"), F.lower(F.trim("email")).alias("_email"))
    return (seed.withColumn("_email", F.lower(F.trim(email_col)))
            .join(u, "_email").drop("_email"))


def create_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Admin user creation over a batch ``requests(request_id, email, first_name,
    last_name, role)``: e-mail normalised, names trimmed (X12); e-mail and both names
    required, blank counting as missing (V3); role in the allowed set, default
    ``user``; an e-mail that already exists, or that an earlier valid request of the
    batch takes, is refused (J1); a request refused for another reason takes nothing. Accepted rows are the new users with status ``active``
    (D3, D11); refused rows carry the reason. Further columns of the requests (as the actor) are kept.
    """
    further = [c for c in requests.columns if c not in ("request_id", "email", "first_name", "last_name", "role")]
    r = requests.select(
        *further,
        "request_id", F.lower(F.trim("email")).alias("email"),
        F.trim("first_name").alias("first_name"), F.trim("last_name").alias("last_name"),
        F.coalesce(F.col("role"), F.lit(DEFAULTS["users"]["role"])).alias("role"))
    missing = (F.coalesce(F.col("email"), F.lit("")) == "") | (F.coalesce(F.col("first_name"), F.lit("")) == "") \
        | (F.coalesce(F.col("last_name"), F.lit("")) == "")
    known = users.select(F.lower(F.trim("email")).alias("email")).where(F.col("email").isNotNull()).distinct() \
        .withColumn("_exists", F.lit(True))
    first = pick_per_key(r.where(~missing & F.col("role").isin(ROLES)).select("email", "request_id"), ["email"], ["request_id"], last=False) \
        .withColumnRenamed("request_id", "_first_request")
    j = r.join(known, "email", "left").join(first, "email", "left")
    error = (F.when(missing, "Email, password, first name, and last name are required.")
             .when(~F.col("role").isin(ROLES), "Invalid role.")
             .when(F.coalesce(F.col("_exists"), F.lit(False)) | (F.col("request_id") != F.col("_first_request")),
                   "A user with this email already exists."))
    return j.select("request_id", "email", "first_name", "last_name", "role",
                    F.when(error.isNull(), F.lit(DEFAULTS["users"]["status"])).alias("status"),
                    error.isNull().alias("accepted"), error.alias("error"), *further)


# ---------------------------------------------------------------------------
# Upsert (D1, D2)
# ---------------------------------------------------------------------------
def upsert(target: DataFrame, changes: DataFrame, key: str, update_cols: list[str],
           order: list[str], as_of, id_col: str = "id") -> DataFrame:
    """``INSERT ... ON CONFLICT (key) DO UPDATE SET update_cols``.

    The last change per key wins (Q13); changes with a NULL key are always inserted
    (Q14). Matched target rows take ``update_cols`` from the change and keep every
    other column; ``updated_at`` is touched (D8). Unmatched changes are inserted with
    the table's defaults. Returns the new snapshot with a ``change`` column
    (updated / inserted / unchanged) and ``n_changes``, the number of change rows that
    targeted the row's key (more than 1 means several were collapsed into the last).

    A table's sequence gives every attempted insert a number, so an inserted row without an
    ``id_col`` of its own gets the greatest id plus the place, by ``order`` (a total order), of
    its key's first change among all changes; changes that update leave gaps. Places are
    numbered by ``ordered_positions``, in many tasks when the changes are many.
    """
    cols = target.columns
    given = id_col in changes.columns
    if not given:
        top = target.agg(F.max(id_col)).first()[0] or 0
        attempts = ordered_positions(changes.withColumn("_all", F.lit(0)), "_all", order, position=id_col)
        changes = attempts.drop("_all").withColumn(id_col, F.col(id_col) + F.lit(top))
    c_last = pick_per_key(changes.where(F.col(key).isNotNull()), [key], order, last=True, count_as="n_changes",
                          extra=() if given else (F.min(id_col).alias("_first_id"),))
    if not given:
        c_last = c_last.drop(id_col).withColumnRenamed("_first_id", id_col)
    # explicit presence marker: an earlier insert may have left a NULL id
    t_key = target.where(F.col(key).isNotNull()).withColumn("_in_target", F.lit(True))
    c = c_last.select(*[F.col(x).alias(f"_c_{x}") for x in c_last.columns])
    j = t_key.join(c, t_key[key] == c[f"_c_{key}"], "full")
    present = F.col("_in_target").isNotNull()
    matched = present & F.col(f"_c_{key}").isNotNull()
    inserted = ~present & F.col(f"_c_{key}").isNotNull()

    def pick(x: str) -> Column:
        cx = f"_c_{x}"
        has_c = cx in c.columns
        if x == key:
            return F.coalesce(F.col(x), F.col(cx)).alias(x)
        if x in update_cols and has_c:
            return F.when(matched | inserted, F.col(cx)).otherwise(F.col(x)).alias(x)
        if x in ("created_at", "updated_at"):
            keep = F.col(x) if x == "created_at" else F.when(matched, _ts(as_of)).otherwise(F.col(x))
            return F.when(inserted, _ts(as_of)).otherwise(keep).alias(x)
        if has_c:
            return F.when(inserted, F.col(cx)).otherwise(F.col(x)).alias(x)
        return F.col(x).alias(x)

    change = F.when(matched, "updated").when(inserted, "inserted").otherwise("unchanged")
    merged = j.select(*[pick(x) for x in cols], change.alias("change"),
                      F.coalesce(F.col("_c_n_changes"), F.lit(0)).alias("n_changes"))
    new_null = changes.where(F.col(key).isNull())
    null_cols = []
    for x in cols:
        if x in ("created_at", "updated_at"):
            null_cols.append(_ts(as_of).alias(x))
        else:
            v = F.col(x) if x in new_null.columns else F.lit(None)
            null_cols.append(v.cast(target.schema[x].dataType).alias(x))
    null_rows = new_null.select(*null_cols, F.lit("inserted").alias("change"), F.lit(1).cast("bigint").alias("n_changes"))
    untouched = (target.where(F.col(key).isNull()).withColumn("change", F.lit("unchanged"))
                 .withColumn("n_changes", F.lit(0).cast("bigint")))
    return merged.unionByName(null_rows).unionByName(untouched)


def latest_session(sessions: DataFrame) -> DataFrame:
    """D2 (``ON CONFLICT (user_id) DO UPDATE``, Q15): one session per user, the latest
    by (created_at, id)."""
    return pick_per_key(sessions.where(F.col("user_id").isNotNull()), ["user_id"], ["created_at", "id"])


def rotate_sessions(sessions: DataFrame, rotations: DataFrame) -> DataFrame:
    """``rotations(user_id, token, at)`` give a user's session a new token and an
    expiry ``at + 7 days``; the last rotation per user applies; users without a
    session are untouched (an UPDATE creates nothing)."""
    r = pick_per_key(rotations, ["user_id"], ["at", "token"]).select(
        "user_id", F.col("token").alias("_new_token"),
        (F.col("at") + F.expr(f"INTERVAL {SESSION_DAYS} DAYS")).alias("_new_exp"))
    j = sessions.join(r, "user_id", "left")
    hit = F.col("_new_token").isNotNull()
    return j.select(*[F.when(hit, F.col("_new_token")).otherwise(F.col("token")).alias("token") if x == "token"
                      else F.when(hit, F.col("_new_exp")).otherwise(F.col("expires_at")).alias("expires_at")
                      if x == "expires_at" else F.col(x) for x in sessions.columns],
                    hit.alias("rotated"))


def live_sessions(sessions: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """F14 + J10 + X20: sessions still valid at ``as_of`` (expiry strictly later)
    whose user exists, with the user's public fields."""
    live = sessions.where(F.col("expires_at") > _ts(as_of))
    u = users.select(F.col("id").alias("user_id"), F.lower(F.trim("email")).alias("email"),
                     "first_name", "last_name", "role")
    return live.join(u, "user_id")


def session_check(sessions: DataFrame, users: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """``requests(request_id, user_id, token)`` pass if that user holds a session with that
    token whose expiry is strictly after ``as_of``, and the user exists. Accepted requests
    carry the user's public fields, refused ones the reason. A NULL user or token never
    matches; every request gives one row."""
    held = (sessions.where(F.col("expires_at") > _ts(as_of)).select("user_id", "token").distinct()
            .withColumn("_held", F.lit(True)))
    u = users.select(F.col("id").alias("user_id"), F.lower(F.trim("email")).alias("email"),
                     "first_name", "last_name", "role", F.lit(True).alias("_known"))
    j = requests.select("request_id", "user_id", "token").join(held, ["user_id", "token"], "left").join(u, "user_id", "left")
    error = (F.when(F.col("_held").isNull(), "Invalid or expired refresh token.")
             .when(F.col("_known").isNull(), "User not found."))
    fields = [F.when(error.isNull(), F.col(c)).alias(c) for c in ("email", "first_name", "last_name", "role")]
    return j.select("request_id", "user_id", *fields, error.isNull().alias("accepted"), error.alias("error"))


# ---------------------------------------------------------------------------
# Owner-checked updates and deletes
# ---------------------------------------------------------------------------
def apply_updates(target: DataFrame, changes: DataFrame, set_cols: list[str], order: list[str],
                  as_of, keys: tuple[str, ...] = ("id", "user_id"),
                  valid: Column | None = None, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """D4 + D8: ``UPDATE t SET set_cols WHERE id = ? AND user_id = ?`` for every change.

    Changes failing ``valid`` (e.g. a percentage outside 0..100) are refused before
    any update. The last valid change per row wins. Returns ``(snapshot, rejects)``:
    the full new snapshot with ``updated_at`` touched, a ``changed`` flag and the columns ``carry``
    of the change that applied (as an actor's id), and the refused changes with a ``reason`` (invalid value, or not found / not owned, A11).
    """
    keys = list(keys)
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    invalid = changes.where(~ok).withColumn("reason", F.lit("invalid value"))
    changes = changes.where(ok)
    last = pick_per_key(changes, keys, order).select(
        *keys, *[F.col(c).alias(f"_n_{c}") for c in (*set_cols, *carry)], F.lit(True).alias("_hit"))
    j = target.join(last, keys, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for x in target.columns:
        if x in set_cols:
            out.append(F.when(hit, F.col(f"_n_{x}")).otherwise(F.col(x)).cast(target.schema[x].dataType).alias(x))
        elif x == "updated_at":
            out.append(F.when(hit, _ts(as_of)).otherwise(F.col(x)).alias(x))
        else:
            out.append(F.col(x))
    snapshot = j.select(*out, hit.alias("changed"), *[F.col(f"_n_{c}").alias(c) for c in carry])
    missing = (changes.join(target.select(*keys), keys, "left_anti")
               .withColumn("reason", F.lit("not found or not owned")))
    return snapshot, missing.unionByName(invalid)


def apply_deletes(target: DataFrame, requests: DataFrame,
                  keys: tuple[str, ...] = ("id", "user_id")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``DELETE ... WHERE id = ? AND user_id = ? RETURNING *``.

    Returns ``(survivors, deleted_rows, rejects)``; survivors + deleted = target.
    """
    keys = list(keys)
    k = requests.select(*keys).distinct()
    return (target.join(k, keys, "left_anti"), target.join(k, keys, "left_semi"),
            requests.join(target.select(*keys), keys, "left_anti"))


# ---------------------------------------------------------------------------
# User removal (D6, D7) and customer ids
# ---------------------------------------------------------------------------
def cascade_delete(children: dict[str, DataFrame], removed_users: DataFrame) -> dict[str, DataFrame]:
    """``ON DELETE CASCADE``: each child table without the removed users' rows. The removed
    ids are materialised once and broadcast behind a size check."""
    ids = checked_broadcast(removed_users.select(F.col("id").alias("user_id")).distinct())
    return {t: df.join(ids, "user_id", "left_anti") for t, df in children.items()}


def cascade_summary(children: dict[str, DataFrame], removed_users: DataFrame) -> DataFrame:
    """D6 report: rows before, removed and kept per child table, in one pass each.

    The removed-user set is materialised once (a reliable checkpoint, broadcast when
    its measured size allows) and read by every child table's join, instead of being
    recomputed per table."""
    marker = checked_broadcast(
        removed_users.select(F.col("id").alias("user_id"), F.lit(True).alias("_gone")).distinct())
    parts = []
    for t, df in children.items():
        j = df.select("user_id").join(marker, "user_id", "left")
        parts.append(j.agg(F.count("*").alias("n_before"),
                           F.count_if(F.coalesce(F.col("_gone"), F.lit(False))).alias("n_removed"))
                     .select(F.lit(t).alias("table_name"), "n_before", "n_removed",
                             (F.col("n_before") - F.col("n_removed")).alias("n_kept")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_set_null(audit: DataFrame, removed_users: DataFrame) -> DataFrame:
    """``ON DELETE SET NULL``: audit rows of removed users keep their row with a
    NULL actor. The removed-user marker is broadcast behind a size check."""
    marker = checked_broadcast(
        removed_users.select(F.col("id").alias("user_id"), F.lit(True).alias("_gone")).distinct())
    j = audit.join(marker, "user_id", "left")
    gone = F.coalesce(F.col("_gone"), F.lit(False))
    return j.select(*[F.when(gone, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("user_id")
                      if c == "user_id" else F.col(c) for c in audit.columns], gone.alias("actor_removed"))


def fill_customer_id(users: DataFrame, proposals: DataFrame, order: list[str]) -> DataFrame:
    """Set the processor customer id of users that have none, from
    ``proposals(user_id, customer_id, ...)`` (first proposal per user); an existing id
    is kept (Q23)."""
    first = pick_per_key(proposals.select("user_id", "customer_id", *order), ["user_id"], order, last=False)
    j = users.select("id", "stripe_customer_id").join(
        first.select(F.col("user_id").alias("id"), "customer_id"), "id", "left")
    filled = F.col("stripe_customer_id").isNull() & F.col("customer_id").isNotNull()
    return j.select("id", F.coalesce("stripe_customer_id", "customer_id").alias("stripe_customer_id"),
                    filled.alias("filled"))
