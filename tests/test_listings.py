from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from tallyframe.functions import money as M
from tallyframe.functions import text as X
from tallyframe.operators import listings

from .fixtures import frame, seed_b, ts


def _txs(spark):
    return frame(spark, "transactions", [
        dict(id=1, user_id=1, type="receive", gateway="Stripe", amount_usd=D("100.00"), created_at=ts(0),
             description="Initial funding via Stripe"),
        dict(id=2, user_id=1, type="send", gateway="Wise", amount_usd=D("-50.00"), created_at=ts(5),
             from_address="acct_bank_1", description=None),
        dict(id=3, user_id=1, type="send", gateway="Bank", amount_usd=D("4200.00"), created_at=ts(5),
             description="Stripe → Chase 4821"),
        dict(id=4, user_id=1, type="fee", gateway=None, amount_usd=D("0.125"), created_at=ts(7)),
        dict(id=12, user_id=2, type="alloc", gateway="Internal", amount_usd=D("10.00"), created_at=ts(1),
             description="Auto allocation 1"),
    ])


def test_gateway_list_parsing():
    assert listings.gateway_list("") == []
    assert listings.gateway_list(",") == []
    assert listings.gateway_list(" Stripe , ") == ["Stripe"]
    assert listings.gateway_list("Stripe,Wise") == ["Stripe", "Wise"]
    assert listings.gateway_list(None) == []


@pytest.mark.parametrize("limit,offset,expected", [
    (0, 0, (50, 0)), ("abc", "x", (50, 0)), (None, None, (50, 0)), ("20", "10", (20, 10)), (6, 0, (6, 0)),
    ("10abc", "3.7", (10, 3)), ("-5", "-1", (50, 0))])
def test_page_args(limit, offset, expected):
    assert listings.page_args(limit, offset) == expected


def test_search_filters_and_tie_break(spark):
    txs = _txs(spark)
    ids = [r.id for r in listings.tx_search(txs, user_id=1).orderBy("position").collect()]
    assert ids == [4, 3, 2, 1]              # equal created_at 3 vs 2 broken by id desc
    assert {r.id for r in listings.tx_search(txs, type="send").collect()} == {2, 3}
    assert {r.id for r in listings.tx_search(txs, type="all").collect()} == {1, 2, 3, 4, 12}
    assert {r.id for r in listings.tx_search(txs, gateway=" Stripe , ").collect()} == {1}
    assert {r.id for r in listings.tx_search(txs, gateway="Stripe,Wise").collect()} == {1, 2}
    assert {r.id for r in listings.tx_search(txs, gateway=",").collect()} == {1, 2, 3, 4, 12}
    page = listings.tx_search(txs, user_id=1, limit=2, offset=1).orderBy("position").collect()
    assert [r.id for r in page] == [3, 2]


def test_deep_page_equals_the_group_limited_one(spark):
    txs = _txs(spark)
    want = [tuple(r) for r in listings.tx_search(txs).orderBy("user_id", "position").collect()]
    deep = listings.tx_search(txs, limit=listings.GROUP_LIMIT + 1)
    assert [tuple(r) for r in deep.orderBy("user_id", "position").collect()] == want
    assert deep.schema == listings.tx_search(txs).schema


def test_recent_and_global_page(spark):
    txs = _txs(spark)
    recent = {(r.user_id, r.id) for r in listings.recent_tx(txs, 2).collect()}
    assert recent == {(1, 4), (1, 3), (2, 12)}
    assert [r.id for r in listings.tx_page(txs, limit="0", offset="1").collect()] == [3, 2, 12, 1]


def test_text_search(spark):
    txs = _txs(spark)
    assert {r.id for r in listings.tx_text_search(txs, "STRIPE").collect()} == {1, 3}
    assert {r.id for r in listings.tx_text_search(txs, "bank_1").collect()} == {2}
    assert {r.id for r in listings.tx_text_search(txs, "12").collect()} == {12}     # numeric id as text
    assert listings.tx_text_search(txs, None).count() == 5


def test_point_lookup_owner_checked(spark):
    txs = _txs(spark)
    req = spark.createDataFrame([(1, 1), (1, 2), (99, 1)], "id long, user_id long")
    found, missing = listings.tx_by_id(txs, req)
    assert [r.id for r in found.collect()] == [1]
    assert sorted((r.id, r.user_id) for r in missing.collect()) == [(1, 2), (99, 1)]


def test_statement_texts(spark):
    st = {r.id: r for r in listings.tx_statement(_txs(spark)).collect()}
    assert st[1].amount_text == "+$100.00"
    assert st[2].amount_text == "-$50.00"         # stored negative, sign from type (Q18)
    assert st[3].amount_text == "-$4,200.00"
    assert st[4].amount_text == "+$0.13"          # half-up, not half-even
    assert st[2].description_text == "acct_bank_1" and st[4].description_text == "—"
    assert st[1].type_label == "RECEIVE" and st[4].type_color == "gray"
    assert st[1].date_text == "Mon, Jan 1, 2024" and st[1].time_text == "12:00:00"


def test_wallet_cards(spark):
    w, a, g, r = seed_b(spark)
    cards = {c.symbol: c for c in listings.list_wallets(w).collect()}
    assert cards["BTC"].short_address == "bc1qxy2k…hx0wlh"
    assert cards["ETH"].balance_text == "18.7400"
    assert cards["SOL"].color == "var(--sol)"
    banks = {b.last4: b for b in listings.list_banks(a).collect()}
    assert banks["4821"].masked == "••••4821" and banks["2290"].status_color == "amber"
    gws = {x.name: x for x in listings.list_gateways(g).collect()}
    assert gws["Stripe"].fee_label == "2.90% + $0.30"
    assert gws["Wise"].fee_label == "0.41%"
    assert gws["Cash App"].color == "#3D8EF0" and gws["Stripe"].initial == "S"
    rules = [x.meta for x in listings.list_rules(r).orderBy("position").collect()]
    assert rules[0] == "Adjustable · Auto-run" and rules[4] == "Adjustable · Manual only"


def test_short_address_edges(spark):
    df = spark.createDataFrame([("a" * 16,), ("b" * 17,)], "s string")
    got = [r[0] for r in df.select(X.short_address("s")).collect()]
    assert got == ["a" * 16, "bbbbbbbb…bbbbbb"]


def test_user_directory_texts(spark):
    users = frame(spark, "users", [
        dict(id=1, email="  Admin@Example.COM ", first_name=" Jane ", last_name="Doe", role="admin",
             created_at=ts()),
        dict(id=2, email="x@y.z", first_name="", last_name="", role="user", created_at=ts(1))])
    d = {r.id: r for r in listings.user_directory(users).collect()}
    assert d[1].email == "admin@example.com" and d[1].display_name == "Jane Doe"
    assert d[1].initials == "JD" and d[1].role_label == "Admin"
    assert d[2].display_name == "x@y.z"
    assert "password_hash" not in listings.user_directory(users).columns


def test_users_by_id(spark):
    users = frame(spark, "users", [dict(id=1, email="a@b.c", role="user", stripe_customer_id="cus_1")])
    asked = spark.createDataFrame([(7, 1), (8, 2), (9, None), (10, 1)], "request_id long, user_id long")
    got = sorted(tuple(r) for r in listings.users_by_id(users, asked).select(
        "request_id", F.coalesce("stripe_customer_id", F.lit("")), F.coalesce("error", F.lit(""))).collect())
    assert got == [(7, "cus_1", ""), (8, "", "User not found."), (9, "", "User not found."), (10, "cus_1", "")]


def test_money_helpers(spark):
    df = spark.createDataFrame([(D("0.125"), D("1234567.125"), 12345)],
                               "a decimal(20,3), b decimal(20,3), c long")
    r = df.select(M.usd_text("a"), M.usd_text("b"), M.usd_text(M.from_cents("c")), M.to_cents("b"),
                  X.int_or_zero(df.c.cast("string")), X.clamp(df.c, 0, 100)).collect()[0]
    assert tuple(r) == ("$0.13", "$1,234,567.13", "$123.45", 123456713, 12345, 100)
