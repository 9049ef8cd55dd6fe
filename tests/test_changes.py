import datetime as dt
from decimal import Decimal as D

from tallyframe.operators import changes
from tallyframe.sources import seeds

from .conftest import rows
from .fixtures import frame, seed_b, ts

AS_OF = "2024-02-01 00:00:00"


def _accounts(spark):
    return frame(spark, "bank_accounts", [
        dict(id=1, user_id=1, name="old1", bank_name="B", account_type="checking", last4="0001", balance=D("1"),
             plaid_item_id="item-A", created_at=ts(0), updated_at=ts(0)),
        dict(id=2, user_id=1, name="old2", plaid_item_id="item-B", created_at=ts(1), updated_at=ts(1)),
        dict(id=3, user_id=1, name="nokey", plaid_item_id=None, created_at=ts(2), updated_at=ts(2))])


def _changes(spark):
    return spark.createDataFrame([
        (7, "item-A", "first", "Chase", "checking", "1111", D("10.00"), "USD", "verified", 1, 0),
        (7, "item-A", "second", "Chase", "savings", "2222", D("20.00"), "USD", "verified", 1, 1),  # last wins
        (7, "item-C", "new", "Wise", "digital", "3333", D("0.00"), "EUR", "verified", 2, 0),
        (7, None, "nullkey1", "Wise", "digital", "4444", D("1.00"), "USD", "verified", 3, 0),
        (7, None, "nullkey2", "Wise", "digital", "5555", D("2.00"), "USD", "verified", 3, 1)],
        "user_id long, plaid_item_id string, name string, bank_name string, account_type string, last4 string, "
        "balance decimal(20,2), currency string, status string, link_id long, pos int")


COLS = ["name", "bank_name", "account_type", "last4", "balance", "currency", "status"]


def test_upsert_semantics(spark):
    out = changes.upsert(_accounts(spark), _changes(spark), "plaid_item_id", COLS, ["link_id", "pos"], AS_OF)
    got = {(r.plaid_item_id, r.name): r for r in out.collect()}
    a = got[("item-A", "second")]
    assert (a.id, a.user_id, a.last4, a.balance, a.change) == (1, 1, "2222", D("20.00"), "updated")
    assert a.n_changes == 2                               # two accounts collapsed into the last (Q13)
    assert a.created_at == ts(0) and a.updated_at == dt.datetime(2024, 2, 1)
    assert got[("item-B", "old2")].change == "unchanged"
    c = got[("item-C", "new")]
    # the sequence numbers every attempt, so the third change takes 3 + 3 (the greatest id is 3)
    assert (c.id, c.user_id, c.change, c.currency) == (6, 7, "inserted", "EUR")
    assert [got[(None, k)].id for k in ("nullkey1", "nullkey2")] == [7, 8]
    assert got[(None, "nokey")].change == "unchanged"
    assert {n for (k, n) in got if k is None} == {"nokey", "nullkey1", "nullkey2"}   # NULL keys never merge
    assert out.count() == 6


def test_upsert_twice_is_once(spark):
    once = changes.upsert(_accounts(spark), _changes(spark), "plaid_item_id", COLS, ["link_id", "pos"], AS_OF)
    keyed = _changes(spark).where("plaid_item_id IS NOT NULL")
    twice = changes.upsert(once.drop("change", "n_changes"), keyed, "plaid_item_id", COLS, ["link_id", "pos"], AS_OF)
    strip = [c for c in once.columns if c not in ("change", "n_changes")]
    assert rows(once.where("plaid_item_id IS NOT NULL"), *strip) == rows(twice.where("plaid_item_id IS NOT NULL"), *strip)


def test_updates_owner_checked_and_touch(spark):
    *_, rules = seed_b(spark)
    ch = spark.createDataFrame([(1, 1, D("20.00"), 1), (1, 1, D("21.00"), 2), (2, 9, D("5.00"), 3),
                                (99, 1, D("5.00"), 4)],
                               "id long, user_id long, percentage decimal(5,2), seq long")
    snap, rej = changes.apply_updates(rules, ch, ["percentage"], ["seq"], AS_OF)
    got = {r.id: r for r in snap.collect()}
    assert got[1].percentage == D("21.00") and got[1].changed and got[1].updated_at == dt.datetime(2024, 2, 1)
    assert got[2].percentage == D("30.00") and not got[2].changed
    assert rows(rej, "id", "user_id") == [(2, 9), (99, 1)]


def test_deletes_partition_the_target(spark):
    w, *_ = seed_b(spark)
    req = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (3, 1)], "id long, user_id long")
    survivors, deleted, rej = changes.apply_deletes(w, req)
    assert survivors.count() + deleted.count() == w.count()
    assert rows(deleted, "id") == [(1,), (3,)]
    assert rows(rej, "id", "user_id") == [(2, 2)]


def test_cascade_and_set_null(spark):
    w = frame(spark, "crypto_wallets", [dict(id=i, user_id=i % 3) for i in range(9)])
    removed = frame(spark, "users", [dict(id=1)])
    kept = changes.cascade_delete({"w": w}, removed)["w"]
    assert {r.user_id for r in kept.collect()} == {0, 2}
    s = changes.cascade_summary({"w": w}, removed).collect()[0]
    assert (s.n_before, s.n_removed, s.n_kept) == (9, 3, 6)
    audit = frame(spark, "audit_logs", [dict(id=1, user_id=1, action="login"), dict(id=2, user_id=2, action="x")])
    got = {r.id: (r.user_id, r.actor_removed) for r in changes.audit_set_null(audit, removed).collect()}
    assert got == {1: (None, True), 2: (2, False)}


def test_insert_absent_and_defaults(spark):
    w, *_ = seed_b(spark)
    ins = spark.createDataFrame(
        [(1, "0x742d35Cc6634C0532925a3b844Bc454e4438f44e"), (2, "new-addr-1"), (3, "new-addr-1"), (4, None)],
        "request_id long, address string")
    new = changes.insert_absent(w, ins, "address", ["request_id"])
    assert rows(new, "request_id") == [(2,), (4,)]
    assert rows(changes.existing_keys(ins, w, "address"), "request_id") == [(1,)]
    filled = changes.fill_defaults(
        frame(spark, "crypto_wallets", [dict(id=1, balance=None, is_verified=None)]), "crypto_wallets").collect()[0]
    assert (filled.balance, filled.balance_usd, filled.is_verified) == (D("0E-8"), D("0.00"), False)


def test_sessions_latest_rotate_live(spark):
    s = frame(spark, "refresh_tokens", [
        dict(id=1, user_id=1, token="t1", created_at=ts(0), expires_at=ts(0) + dt.timedelta(days=7)),
        dict(id=2, user_id=1, token="t2", created_at=ts(5), expires_at=ts(5) + dt.timedelta(days=7)),
        dict(id=3, user_id=2, token="t3", created_at=ts(0), expires_at=ts(60))])
    latest = changes.latest_session(s)
    assert rows(latest, "user_id", "token") == [(1, "t2"), (2, "t3")]
    rot = spark.createDataFrame([(1, "r1", ts(10)), (3, "r3", ts(10))], "user_id long, token string, at timestamp_ntz")
    got = {r.user_id: (r.token, r.expires_at, r.rotated) for r in changes.rotate_sessions(latest, rot).collect()}
    assert got[1] == ("r1", ts(10) + dt.timedelta(days=7), True) and got[2][2] is False
    users = frame(spark, "users", [dict(id=1, email="A@B.C"), dict(id=2, email="x")])
    live = changes.live_sessions(latest, users, ts(60).strftime("%Y-%m-%d %H:%M:%S"))
    assert rows(live, "user_id", "email") == [(1, "a@b.c")]   # user 2 expires exactly at as_of


def test_session_check_needs_user_and_token(spark):
    s = frame(spark, "refresh_tokens", [
        dict(id=1, user_id=1, token="t1", expires_at=ts(70)), dict(id=2, user_id=1, token="t1", expires_at=ts(80)),
        dict(id=3, user_id=2, token="t2", expires_at=ts(60)), dict(id=4, user_id=9, token="t9", expires_at=ts(70))])
    users = frame(spark, "users", [dict(id=1, email=" A@B.C"), dict(id=2, email="x")])
    asked = spark.createDataFrame([(1, 1, "t1"), (2, 1, "t2"), (3, 2, "t2"), (4, 9, "t9"), (5, None, "t1"), (6, 1, None)],
                                  "request_id long, user_id long, token string")
    got = changes.session_check(s, users, asked, ts(60).strftime("%Y-%m-%d %H:%M:%S"))
    bad = "Invalid or expired refresh token."
    assert rows(got, "request_id", "email", "error") == [
        (1, "a@b.c", None), (2, None, bad), (3, None, bad), (4, None, "User not found."), (5, None, bad), (6, None, bad)]


def test_customer_id_and_owner_resolution(spark):
    users = frame(spark, "users", [dict(id=1, email=" A@x.io ", stripe_customer_id="cus_keep"),
                                   dict(id=2, email="b@x.io")])
    prop = spark.createDataFrame([(1, "cus_new", 1), (2, "cus_2b", 2), (2, "cus_2a", 1)],
                                 "user_id long, customer_id string, seq long")
    got = dict((r.id, (r.stripe_customer_id, r.filled)) for r in changes.fill_customer_id(users, prop, ["seq"]).collect())
    assert got == {1: ("cus_keep", False), 2: ("cus_2a", True)}
    seed = spark.createDataFrame([("w1", "a@X.io"), ("w2", "nobody@x.io")], "name string, owner_email string")
    assert rows(changes.resolve_owner(seed, users), "name", "user_id") == [("w1", 1)]


def test_seed_rows(spark):
    users = frame(spark, "users", [dict(id=1), dict(id=2)])
    lit = seeds.seed_for_users(users, [{"name": "a", "pct": 1}, {"name": "b", "pct": 2}])
    assert rows(lit, "user_id", "name") == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    counts = spark.createDataFrame([(1, 25)], "user_id long, count long")
    series = seeds.series_rows(users.selectExpr("id AS user_id"), counts, guard=20)
    got = series.collect()
    assert {r.user_id for r in got} == {2} and len(got) == 13
    assert sorted(r.amount_usd for r in got if r.type == "alloc") == [D(x) for x in ("10.00", "20.00", "30.00", "40.00", "50.00")]


def test_update_variants_gateway_flag_and_user_status(spark):
    _, _, g, _ = seed_b(spark)
    flips = spark.createDataFrame([(4, 1, True, 1), (1, 2, False, 2)],
                                  "id long, user_id long, is_enabled boolean, seq long")
    snap, rej = changes.apply_updates(g, flips, ["is_enabled"], ["seq"], AS_OF)
    got = {r.id: r.is_enabled for r in snap.collect()}
    assert got[4] is True and got[1] is True          # another owner's flip is rejected
    assert rows(rej, "id", "user_id") == [(1, 2)]
    users = frame(spark, "users", [dict(id=1, status="active"), dict(id=2, status="active")])
    st = spark.createDataFrame([(2, "suspended", 1)], "id long, status string, seq long")
    snap, rej = changes.apply_updates(users, st, ["status"], ["seq"], AS_OF, keys=("id",))   # admin: no owner check
    assert dict(rows(snap, "id", "status")) == {1: "active", 2: "suspended"} and rej.count() == 0


def test_audit_sink_and_snapshot_round_trip(spark, tmp_dir):
    from tallyframe.sources import audit, tables
    w, *_ = seed_b(spark)
    rows_ = audit.action_audit(w.withColumn("at", w.created_at), "add_wallet", "crypto_wallets",
                               ["name", "address"], "id", "at")
    audit.append_audit(rows_, f"{tmp_dir}/audit")
    audit.append_audit(rows_, f"{tmp_dir}/audit")                      # append, not overwrite
    back = spark.read.parquet(f"{tmp_dir}/audit")
    assert back.count() == 12 and "dt" in back.columns
    assert {r.details for r in back.collect()} >= {'{"name":"Primary Bitcoin","address":"bc1qxy2kgdygjrsqtzq2n0yrf2493p83kkfjhx0wlh"}'}
    tables.write_snapshot(w, tmp_dir, "crypto_wallets")
    again = tables.load_table(spark, tmp_dir, "crypto_wallets")
    assert [(f.name, f.dataType) for f in again.schema] == [(f.name, f.dataType) for f in w.schema]
    assert again.count() == 6
    counts = dict(rows(tables.table_counts({"w": w, "w2": again})))
    assert counts == {"w": 6, "w2": 6}


def test_snapshot_ledger_gives_same_results(spark, tmp_dir):
    from tallyframe.operators import portfolio
    from tallyframe.sources.bindings import Ledger
    from tallyframe.sources.tables import SnapshotLedger, write_ledger

    from .conftest import SF001
    bound = Ledger(spark, SF001)
    write_ledger(bound, f"{tmp_dir}/ledger")
    snap = SnapshotLedger(spark, f"{tmp_dir}/ledger")
    a = portfolio.portfolio_kpis(bound.crypto_wallets, bound.bank_accounts, bound.payment_gateways)
    b = portfolio.portfolio_kpis(snap.crypto_wallets, snap.bank_accounts, snap.payment_gateways)
    assert rows(a) == rows(b) and len(rows(a)) == 25


def test_out_of_range_updates_are_refused(spark):
    from pyspark.sql import functions as F
    *_, rules = seed_b(spark)
    ch = spark.createDataFrame([(1, 1, D("101.00"), 1), (2, 1, None, 2), (3, 1, D("0.00"), 3)],
                               "id long, user_id long, percentage decimal(5,2), seq long")
    snap, rej = changes.apply_updates(rules, ch, ["percentage"], ["seq"], AS_OF,
                                      valid=F.col("percentage").between(0, 100))
    got = {r.id: r.percentage for r in snap.collect()}
    assert got[1] == D("15.00") and got[2] == D("30.00") and got[3] == D("0.00")
    assert rows(rej, "id", "reason") == [(1, "invalid value"), (2, "invalid value")]


def test_create_users_rules(spark):
    users = frame(spark, "users", [dict(id=1, email=" Taken@X.io ")])
    req = spark.createDataFrame([
        (1, "taken@x.io", "A", "B", None),          # exists (normalised)
        (2, " New@X.io ", " Ann ", "Lee", None),    # ok, default role
        (3, "new@x.io", "C", "D", "admin"),         # same e-mail as an earlier request
        (4, "other@x.io", "E", "  ", "user"),       # blank last name
        (5, "third@x.io", "F", "G", "owner")],      # role not allowed
        "request_id long, email string, first_name string, last_name string, role string")
    got = {r.request_id: r for r in changes.create_users(users, req).collect()}
    assert got[2].accepted and (got[2].email, got[2].first_name, got[2].role, got[2].status) == ("new@x.io", "Ann", "user", "active")
    assert got[1].error == got[3].error == "A user with this email already exists."
    assert got[4].error.startswith("Email, password") and got[5].error == "Invalid role."
    assert not any(got[i].accepted for i in (1, 3, 4, 5)) and got[5].status is None
