from decimal import Decimal as D

from tallyframe.operators import pairs, portfolio

from .conftest import rows
from .fixtures import frame, seed_b, ts


def test_seed_b_kpis_golden(spark):
    w, a, g, _ = seed_b(spark)
    k = portfolio.portfolio_kpis(w, a, g).collect()
    assert len(k) == 1
    r = k[0]
    assert r.crypto_usd == D("305415.41")
    assert r.bank_usd == D("446350.00")
    assert r.gateway_volume_usd == D("339600.00")
    assert r.total_usd == D("1091365.41")
    assert (r.n_assets, r.n_accounts, r.n_enabled_gateways) == (6, 4, 4)


def test_kpi_text(spark):
    w, a, g, _ = seed_b(spark)
    t = portfolio.portfolio_kpi_text(portfolio.portfolio_kpis(w, a, g)).collect()[0]
    assert t.total_text == "$1,091,365.41"
    assert t.gateway_text == "$339,600.00/mo"
    assert t.assets_text == "6 digital assets"


def test_full_outer_owners_and_nulls(spark):
    # owner 1: wallets only (one null balance); owner 2: accounts only; owner 3: gateways only,
    # disabled and null volume; nothing else.
    w = frame(spark, "crypto_wallets", [dict(id=1, user_id=1, balance_usd=D("10.00")),
                                        dict(id=2, user_id=1, balance_usd=None)])
    a = frame(spark, "bank_accounts", [dict(id=1, user_id=2, balance=None)])
    g = frame(spark, "payment_gateways", [dict(id=1, user_id=3, is_enabled=False, monthly_volume=D("5.00")),
                                          dict(id=2, user_id=3, is_enabled=True, monthly_volume=None)])
    got = {r.user_id: r for r in portfolio.portfolio_kpis(w, a, g).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].crypto_usd == D("10.00") and got[1].n_assets == 2 and got[1].bank_usd == 0
    assert got[2].bank_usd == 0 and got[2].n_accounts == 1
    assert got[3].gateway_volume_usd == 0 and got[3].n_enabled_gateways == 1


def test_bars_seed_b_order_and_percent(spark):
    w, a, g, _ = seed_b(spark)
    bars = {r.bar_pos: r for r in portfolio.portfolio_bars(w, a, g).collect()}
    # newest-first accounts: Mercury (3rd created), Wise, BoA, Chase -> positions 1st,4th,2nd,3rd
    assert bars[1].label == "Crypto" and bars[6].label == "GW Volume"
    assert bars[2].label == "Mercury Business"      # rank 1
    assert bars[3].label == "Chase Business Checking"  # rank 4
    assert bars[4].label == "Wise Multi-Currency"   # rank 2
    assert bars[5].label == "Bank of America Savings"  # rank 3
    assert max(r.pct for r in bars.values()) == 100
    assert all(0 <= r.pct <= 100 for r in bars.values())
    assert bars[6].pct == 100 and bars[1].pct == 90      # 305415.41 / 339600 -> 89.93


def test_bars_all_zero_floor(spark):
    w = frame(spark, "crypto_wallets", [dict(id=1, user_id=1, balance_usd=D("0.00"))])
    a = frame(spark, "bank_accounts", [dict(id=1, user_id=1, name="x", balance=D("0.00"), created_at=ts())])
    g = frame(spark, "payment_gateways", [dict(id=1, user_id=1, is_enabled=True, monthly_volume=D("0.00"))])
    got = portfolio.portfolio_bars(w, a, g).collect()
    assert {r.pct for r in got} == {0} and len(got) == 6
    assert sorted(r.label for r in got if r.account_id is None and r.label not in ("Crypto", "GW Volume")) == ["—"] * 3
    g2 = frame(spark, "payment_gateways", [dict(id=1, user_id=1, is_enabled=True, monthly_volume=D("0.50"))])
    got2 = {r.label: r.pct for r in portfolio.portfolio_bars(w, a, g2).collect()}
    assert got2["GW Volume"] == 50     # max floored at 1


def test_percent_rounds_half_up_like_js(spark):
    g = frame(spark, "payment_gateways", [dict(id=1, user_id=1, name="a", monthly_volume=D("1.00")),
                                          dict(id=2, user_id=1, name="b", monthly_volume=D("8.00")),
                                          dict(id=3, user_id=1, name="c", monthly_volume=D("0.00"))])
    got = {r.gateway_id: r.pct for r in portfolio.gateway_volume_bars(g).collect()}
    assert got == {1: 13, 2: 100}      # 12.5 -> 13; zero volume is not charted


def test_gateway_colors(spark):
    g = frame(spark, "payment_gateways", [dict(id=1, user_id=1, name="Stripe", monthly_volume=D("1")),
                                          dict(id=2, user_id=1, name="Other", monthly_volume=D("1"))])
    got = {r.name: r.color for r in portfolio.gateway_volume_bars(g).collect()}
    assert got == {"Stripe": "#635BFF", "Other": "#3D8EF0"}


def test_transfer_pairs_counts_without_pairs(spark):
    _, a, _, _ = seed_b(spark)
    got = {r.id: (r.n_targets, r.targets_balance) for r in pairs.transfer_pairs(a).collect()}
    assert got[1] == (3, D("446350.00") - D("284750.00"))
    assert all(n == 3 for n, _ in got.values())


def test_swap_pairs_statuses(spark):
    w, _, _, _ = seed_b(spark)
    other = frame(spark, "crypto_wallets", [dict(id=99, user_id=2, symbol="BTC")])
    wallets = w.unionByName(other)
    req = spark.createDataFrame(
        [(1, 1, 1, 2), (2, 1, 1, 1), (3, 1, 1, 99), (4, 2, 1, 2), (5, 1, 50, 2), (6, 1, 1, 51)],
        "request_id long, user_id long, from_wallet_id long, to_wallet_id long")
    got = dict(rows(pairs.swap_pairs(wallets, req), "request_id", "status"))
    assert got == {1: "ok", 2: "same_wallet", 3: "cross_owner", 4: "not_owner",
                   5: "unknown_from", 6: "unknown_to"}


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10 ** 9), min_size=1, max_size=8))
def test_bar_percent_property(spark, cents):
    g = frame(spark, "payment_gateways", [dict(id=i, user_id=1, name=f"g{i}", monthly_volume=D(c) / 100)
                                          for i, c in enumerate(cents)])
    pct = [r.pct for r in portfolio.gateway_volume_bars(g).collect()]
    assert all(0 <= p <= 100 for p in pct)
    if max(cents) >= 100:                      # maximum at least 1 -> someone is at 100
        assert 100 in pct
