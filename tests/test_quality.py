from decimal import Decimal as D

from tallyframe.operators import quality

from .conftest import rows
from .fixtures import frame


def test_domains_nulls_and_required(spark):
    users = frame(spark, "users", [
        dict(id=1, email="a@b.c", password_hash="h", first_name="A", last_name="B", role="admin", status="active"),
        dict(id=2, email="   ", password_hash="h", first_name="A", last_name="B", role="owner", status=None),
        dict(id=3, email="c@d.e", password_hash=None, first_name=" ", last_name="B", role=None, status="gone")])
    txs = frame(spark, "transactions", [
        dict(id=1, type="receive", amount=D(1), amount_usd=D(1), status="processing"),   # Q16
        dict(id=2, type="refund", amount=None, amount_usd=D(1), status=None)])
    rules = frame(spark, "allocation_rules", [dict(id=1, name="r", percentage=D("100.01")),
                                              dict(id=2, name="r", percentage=D("0.00"))])
    got = rows(quality.check_violations({"users": users, "transactions": txs, "allocation_rules": rules}),
               "table_name", "row_id", "column_name", "violation")
    assert got == sorted([
        ("users", 2, "email", "required"), ("users", 2, "role", "domain"),
        ("users", 3, "password_hash", "required"), ("users", 3, "first_name", "required"),
        ("users", 3, "status", "domain"),
        ("transactions", 1, "status", "domain"),
        ("transactions", 2, "type", "domain"), ("transactions", 2, "amount", "required"),
        ("allocation_rules", 1, "percentage", "range")])


def test_valid_plus_violating_is_input(spark):
    users = frame(spark, "users", [dict(id=i, email=f"u{i}", password_hash="h", first_name="a",
                                        last_name="b", role=["admin", "x", None][i % 3]) for i in range(30)])
    bad = quality.check_violations({"users": users}).select("row_id").distinct()
    valid = users.join(bad.withColumnRenamed("row_id", "id"), "id", "left_anti")
    assert valid.count() + bad.count() == users.count()


def test_wallet_lengths_all_failures(spark):
    w = frame(spark, "crypto_wallets", [
        dict(id=1, name="  ", address="short", symbol="B", network="x"),
        dict(id=2, name="ok", address="0x1234567890", symbol="ETH", network="Ethereum"),
        dict(id=3, name="n" * 101, address=None, symbol="ABCDEFGHIJK", network="ok")])
    got = rows(quality.wallet_validation(w), "row_id", "column_name")
    assert got == sorted([(1, "name"), (1, "address"), (1, "symbol"), (1, "network"),
                          (3, "name"), (3, "address"), (3, "symbol")])


def test_unique_nulls_do_not_collide(spark):
    a = frame(spark, "bank_accounts", [dict(id=1, plaid_item_id="i1"), dict(id=2, plaid_item_id="i1"),
                                       dict(id=3, plaid_item_id=None), dict(id=4, plaid_item_id=None)])
    got = rows(quality.unique_violations({"bank_accounts": a}), "key_value", "n_rows")
    assert got == [("i1", 2)]


def test_orphans(spark):
    users = frame(spark, "users", [dict(id=1)])
    w = frame(spark, "crypto_wallets", [dict(id=1, user_id=1), dict(id=2, user_id=2), dict(id=3, user_id=None)])
    got = rows(quality.orphan_rows(users, {"crypto_wallets": w}), "row_id", "user_id")
    assert got == [(2, 2)]


def test_lengths_and_decimal_overflow(spark):
    a = frame(spark, "bank_accounts", [dict(id=1, last4="12345", currency="USD"), dict(id=2, last4="1234")])
    got = rows(quality.length_violations({"bank_accounts": a}), "row_id", "column_name", "violation")
    assert got == [(1, "last4", "longer than 4")]
    raw = spark.createDataFrame([(1, 99999999.99), (2, 1e20), (3, None)], "k long, v double")
    got = rows(quality.decimal_overflow(raw, "k", {"v": "decimal(20,2)"}), "row_id")
    assert got == [(2,)]
