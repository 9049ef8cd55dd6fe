from decimal import Decimal as D

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.operators import allocation

from .conftest import rows
from .fixtures import frame, seed_a_rules, seed_b, ts


def _runs(spark, items):
    return spark.createDataFrame(
        [(rid, uid, D(a), ts(i)) for i, (rid, uid, a) in enumerate(items)],
        "run_id long, user_id long, amount decimal(20,2), created_at timestamp_ntz")


def test_seed_a_run_golden(spark):
    rules = seed_a_rules(spark, user_id=2)
    alloc, rej = allocation.alloc_run(_runs(spark, [(1, 2, "50000.00")]), rules)
    shares = sorted((r.rule_name, r.share) for r in alloc.collect())
    assert shares == sorted([("Operations", D("20000")), ("Reserve", D("10000")), ("Investment", D("10000")),
                             ("Taxes", D("5000")), ("Profit", D("5000"))])
    assert rej.count() == 0


def test_seed_b_run_rejected_with_total(spark):
    *_, rules = seed_b(spark)
    alloc, rej = allocation.alloc_run(_runs(spark, [(1, 1, "1000.00")]), rules)
    assert alloc.count() == 0
    r = rej.collect()[0]
    assert r.rule_total_pct == D("80.00")
    assert r.error == "Total percentage must be 100%. Current total: 80.00%"
    totals = allocation.rule_totals(rules).collect()[0]
    assert totals.total_pct == D("100.00") and totals.is_on_target


def test_gate_edges(spark):
    def rules_for(uid, pcts, auto=True):
        return [dict(id=uid * 10 + i, user_id=uid, name=f"r{i}", percentage=D(p), is_auto=auto,
                     created_at=ts(i)) for i, p in enumerate(pcts)]
    data = (rules_for(1, ["99.99"]) + rules_for(2, ["100.00"]) + rules_for(3, ["50.00", "50.01"])
            + rules_for(5, ["100.00"], auto=False))
    rules = frame(spark, "allocation_rules", data)
    runs = _runs(spark, [(1, 1, "10.00"), (2, 2, "10.00"), (3, 3, "10.00"), (4, 4, "10.00"), (5, 5, "10.00")])
    alloc, rej = allocation.alloc_run(runs, rules)
    assert {r.run_id for r in alloc.collect()} == {2}
    got = dict(rows(rej, "run_id", "rule_total_pct"))
    assert got == {1: D("99.99"), 3: D("100.01"), 4: D("0.00"), 5: D("0.00")}


def test_split_of_100_01_is_exact(spark):
    rules = frame(spark, "allocation_rules", [
        dict(id=i, user_id=1, name=f"r{i}", percentage=D(p), is_auto=True, created_at=ts(i))
        for i, p in enumerate(["33.33", "33.33", "33.34"])])
    alloc, _ = allocation.alloc_run(_runs(spark, [(1, 1, "100.01")]), rules)
    shares = [r.share for r in alloc.collect()]
    assert sorted(shares) == [D("33.333333"), D("33.333333"), D("33.343334")]
    assert sum(shares) == D("100.01")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10000), min_size=1, max_size=6),
       st.integers(min_value=0, max_value=10 ** 12))
def test_shares_conserve_amount(spark, weights, cents):
    # percentages with two decimals summing to exactly 100
    total = sum(weights) or 1
    bps = [w * 10000 // total for w in weights]
    bps[-1] += 10000 - sum(bps)
    rules = frame(spark, "allocation_rules", [
        dict(id=i, user_id=1, name=f"r{i}", percentage=D(b) / 100, is_auto=True, created_at=ts(i))
        for i, b in enumerate(bps)])
    amount = D(cents) / 100
    alloc, rej = allocation.alloc_run(_runs(spark, [(1, 1, str(amount))]), rules)
    assert rej.count() == 0
    assert sum(r.share for r in alloc.collect()) == amount


def test_cap_check(spark):
    *_, rules = seed_b(spark)      # existing total 100
    cand = spark.createDataFrame(
        [(1, 1, "new", "5", False), (2, 1, "locked", "5", True), (3, 7, "first", "abc", False),
         (4, 7, "big", "250", False)],
        "request_id long, user_id long, name string, pct_text string, is_locked boolean")
    got = {r.request_id: (r.percentage, r.accepted) for r in allocation.rule_cap_check(rules, cand).collect()}
    assert got[1] == (D("5.00"), False)
    assert got[2] == (D("5.00"), True)
    assert got[3] == (D("0.00"), True)      # unparsable -> 0; owner without rules -> total 0
    assert got[4] == (D("100.00"), True)    # clamped to 100


def test_offsets_colors_preview(spark):
    *_, rules = seed_b(spark)
    offs = [r.offset_pct for r in allocation.rule_offsets(rules).orderBy("id").collect()]
    assert offs == [D(x) for x in ["0", "15", "45", "70", "80", "92"]]
    cols = [r.palette_color for r in allocation.rule_colors(rules).orderBy("position").collect()]
    assert cols[0] == "#3D8EF0" and cols[5] == "#F5C518"
    amounts = spark.createDataFrame([(1, D("28400.00"))], "user_id long, amount decimal(20,2)")
    prev = {r.rule_name: r.share for r in allocation.alloc_preview(amounts, rules).collect()}
    assert prev["Partner Payouts"] == D("8520.000000")
    assert sum(prev.values()) == D("28400.00")


def test_latest_amount(spark):
    runs = _runs(spark, [(1, 1, "10.00"), (2, 1, "20.00"), (3, 2, "5.00")])
    assert dict(rows(allocation.latest_amount(runs))) == {1: D("20.00"), 2: D("5.00")}
