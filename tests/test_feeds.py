import json
from decimal import Decimal as D

from tallyframe.operators import valuation
from tallyframe.sources import feeds

from .fixtures import frame, seed_b, ts


def _eth(spark, hexes):
    rows = [(f"a{i}", "Ethereum", json.dumps({"result": h})) for i, h in enumerate(hexes)]
    return feeds.chain_balances(spark.createDataFrame(rows, "address string, network string, body string"))


def test_wei_edges(spark):
    big = hex(2 ** 64 + 12345 * 10 ** 10)             # above 2^64
    d31 = "0x" + "f" * 31
    d32 = "0x" + "f" * 32
    got = {r.address: (r.live_balance, r.status) for r in
           _eth(spark, ["0x0", big, "0xde0b6b3a7640000", d31, d32, "zz", None]).collect()}
    assert got["a0"] == (D("0E-8"), "ok")
    expected = D((2 ** 64 + 12345 * 10 ** 10 + 5 * 10 ** 9) // 10 ** 10) / D(10 ** 8)   # half-up at 1e-8
    assert got["a1"] == (expected, "ok") and expected == D("18.44686752")
    assert got["a2"] == (D("1.00000000"), "ok")       # 1e18 wei
    assert got["a3"] == (None, "overflow")            # 31 digits converts but exceeds DECIMAL(20,8)
    assert got["a4"] == (None, "bad_hex")             # 32 digits rejected before arithmetic
    assert got["a5"] == (None, "bad_hex")
    assert got["a6"] == (None, "failed")


def test_wei_rounding_half_up(spark):
    got = {r.address: r.live_balance for r in _eth(spark, [hex(15 * 10 ** 9), hex(14 * 10 ** 9)]).collect()}
    assert got == {"a0": D("0.00000002"), "a1": D("0.00000001")}


def test_sol_and_networks(spark):
    rows = [("s1", "Solana", json.dumps({"result": {"value": 1_500_000_000}})),
            ("s2", "SOLANA", json.dumps({"error": {"code": -1}})),
            ("b1", "BSC", json.dumps({"result": "0x1"})),
            ("e1", "ETHEREUM", json.dumps({"result": "0x1"}))]
    got = {r.address: (r.live_balance, r.status) for r in feeds.chain_balances(
        spark.createDataFrame(rows, "address string, network string, body string")).collect()}
    assert got["s1"] == (D("1.50000000"), "ok")
    assert got["s2"] == (None, "failed")
    assert got["b1"] == (None, "unsupported")
    assert got["e1"] == (D("0E-8"), "ok")


def test_refresh_keeps_stored_on_failure(spark):
    w = frame(spark, "crypto_wallets", [
        dict(id=1, user_id=1, address="e1", network="Ethereum", balance=D("5")),
        dict(id=2, user_id=1, address="e2", network="ETHEREUM", balance=D("6")),
        dict(id=3, user_id=1, address="b1", network="BSC", balance=D("7"))])
    live = spark.createDataFrame(
        [("e1", "Ethereum", D("1.5"), "ok"), ("e2", "ETHEREUM", None, "failed"), ("b1", "BSC", D("9"), "ok")],
        "address string, network string, live_balance decimal(20,8), status string")
    got = {r.id: (r.balance, r.balance_source) for r in valuation.wallet_refresh(w, live).collect()}
    assert got == {1: (D("1.5"), "live"), 2: (D("6"), "stored"), 3: (D("7"), "stored")}


def test_refresh_takes_the_newest_successful_reply(spark):
    w = frame(spark, "crypto_wallets", [dict(id=1, user_id=1, address="s1", network="Solana", balance=D("5"))])
    reply = lambda n: json.dumps({"result": {"value": n}})
    replies = spark.createDataFrame([
        ("s1", "SOLANA", ts(1), reply(3000000000)), ("s1", "solana", ts(2), reply(2000000000)),
        ("s1", "solana", ts(3), json.dumps({"error": 1}))], "address string, network string, fetched_at timestamp_ntz, body string")
    live = feeds.chain_balances(replies)
    assert [(r.id, r.balance, r.balance_source) for r in valuation.wallet_refresh(w, live).collect()] == [(1, D("2"), "live")]
    timeless = valuation.wallet_refresh(w, live.drop("fetched_at")).collect()
    assert [(r.id, r.balance) for r in timeless] == [(1, D("3"))]


def test_price_feed_latest_per_coin(spark):
    replies = spark.createDataFrame([
        (1, ts(0), json.dumps({"bitcoin": {"usd": 100.0, "usd_24h_change": 1.0},
                               "tether": {"usd": 1.0, "usd_24h_change": 0.0}})),
        (2, ts(5), json.dumps({"bitcoin": {"usd": 110.0, "usd_24h_change": 2.0}})),
        (3, ts(9), json.dumps({"error": "rate limited"})),
        (4, ts(9), json.dumps({"dogecoin": {"usd": 0.1, "usd_24h_change": 0.0}}))],
        "reply_id long, fetched_at timestamp_ntz, body string")
    got = {r.coin_id: (r.usd, r.usd_24h_change) for r in feeds.price_feed(replies).collect()}
    assert got == {"bitcoin": (110.0, 2.0), "tether": (1.0, 0.0)}


def test_price_feed_ties_and_missing_times(spark):
    def reply(i, at, usd):
        return (i, at, json.dumps({"bitcoin": {"usd": usd, "usd_24h_change": 0.0}}))
    schema = "reply_id long, fetched_at timestamp_ntz, body string"
    tied = spark.createDataFrame([reply(-3, ts(1), 1.0), reply(7, ts(1), 2.0), reply(9, ts(0), 3.0),
                                  reply(99, None, 4.0), reply(1, ts(1), 5.0)], schema)
    assert [r.usd for r in feeds.price_feed(tied).collect()] == [2.0]
    assert [r.usd for r in feeds.price_feed(spark.createDataFrame([reply(1, None, 4.0)], schema)).collect()] == [4.0]
    plan = feeds.price_feed(tied)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_valuation_symbol_map_and_missing_price(spark):
    w, *_ = seed_b(spark)
    prices = spark.createDataFrame([("bitcoin", 60000.0, 1.5)], "coin_id string, usd double, usd_24h_change double")
    got = {r.symbol: r for r in valuation.wallet_valuation(w, prices).collect()}
    assert got["BTC"].coin_id == "bitcoin" and got["BTC"].usd_value == D("148872.00")
    assert got["BTC"].change_24h == 1.5 and got["BTC"].balance_text == "2.481200"
    assert got["ETH"].usd_value == D("0.00") and got["ETH"].change_24h is None


def test_bank_feed_fallbacks(spark):
    body = {"item_id": "item-1", "institution": "Chase", "accounts": [
        {"name": "A", "type": "checking", "mask": "1111", "balances": {"available": None, "iso_currency_code": None}},
        {"name": "B", "type": "savings", "mask": "2222", "balances": {"available": 12.5, "iso_currency_code": "EUR"}},
        {"name": "C", "type": "savings", "mask": "3333", "balances": {"available": 0, "iso_currency_code": ""}}]}
    replies = spark.createDataFrame([(1, 1, json.dumps(body))], "link_id long, user_id long, body string")
    got = [(r.pos, r.name, r.balance, r.currency) for r in feeds.bank_feed(replies).orderBy("pos").collect()]
    assert got == [(0, "A", D("0.00"), "USD"), (1, "B", D("12.50"), "EUR"), (2, "C", D("0.00"), "USD")]
    per = valuation.linked_per_institution(feeds.bank_feed(replies)).collect()
    assert [(r.institution, r.n_accounts) for r in per] == [("Chase", 3)]
