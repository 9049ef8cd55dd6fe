"""Owner-clustered tables: joins without an exchange, hot owners in slots, equal results."""

from decimal import Decimal

import pytest

from tallyframe.operators import allocation
from tallyframe.sources.clustered import Clustered, alloc_run

from .conftest import rows


def data(spark):
    runs = [(k, 1 if k % 3 else (k % 7 or None), Decimal(k * 10)) for k in range(200)]     # owner 1: two thirds and more
    rules = [(10 * u + p, u, f"r{p}", Decimal(x), True) for u in (1, 2, 3, 9) for p, x in enumerate((60, 30, 10 if u != 3 else 9))]
    rules.append((99, 2, "by hand", Decimal(50), False))
    return (spark.createDataFrame(runs, "run_id long, user_id long, amount decimal(20,2)"),
            spark.createDataFrame(rules, "id long, user_id long, name string, percentage decimal(5,2), is_auto boolean"))


@pytest.mark.parametrize("hot_rows", [20, 1_000_000])
def test_same_allocations_without_an_exchange(spark, hot_rows):
    runs, rules = data(spark)
    store = Clustered(spark, buckets=8, hot_rows=hot_rows)
    stored, side = store.fact(runs, "runs", "run_id"), store.side(rules, "rules")
    assert stored.count() == 200
    slots = stored.where("user_id = 1").select("slot").distinct().count()
    assert slots > 4 if hot_rows == 20 else slots == 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = alloc_run(stored, side)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert rows(got) == rows(allocation.alloc_run(runs, rules.withColumn("created_at", rules.id))[0].select(got.columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
