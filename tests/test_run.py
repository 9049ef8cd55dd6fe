from decimal import Decimal as D

from tallyframe import run
from tallyframe.functions.text import percent_of

from .conftest import SF001


def test_run_lists_and_writes_snapshots(spark, tmp_dir, capsys):
    assert run.main(["--list"]) == 0
    listed = capsys.readouterr().out
    assert "portfolio_kpis" in listed and "quota_breaches" in listed
    assert run.main(["--sf-dir", SF001, "--out", f"{tmp_dir}/out", "portfolio_kpis", "rule_totals"]) == 0
    assert spark.read.parquet(f"{tmp_dir}/out/portfolio_kpis").count() == 25
    assert spark.read.parquet(f"{tmp_dir}/out/rule_totals").count() > 0


def test_percent_rounds_like_js_for_negatives(spark):
    df = spark.createDataFrame([(D("-2.5"), D("100")), (D("-2.6"), D("100")), (D("2.5"), D("100")), (D("0"), D("1"))],
                               "v decimal(20,2), m decimal(20,2)")
    got = [r[0] for r in df.select(percent_of("v", "m")).collect()]      # ratio = v * 100 / m = v
    # Math.round: -2.5 -> -2, -2.6 -> -3, 2.5 -> 3
    assert got == [-2, -3, 3, 0]


def test_percent_is_exact_just_below_a_tie(spark):
    df = spark.sql("SELECT CAST(494999996 AS DECIMAL(18,2)) v, CAST(1000000000 AS DECIMAL(18,2)) m "
                   "UNION ALL SELECT 495, 1000 UNION ALL SELECT -495, 1000 UNION ALL SELECT 1000, 1000")
    assert sorted(r[0] for r in df.select(percent_of("v", "m")).collect()) == [-49, 49, 50, 100]


def test_leading_integers(spark):
    from tallyframe.functions.text import int_or_zero

    df = spark.createDataFrame([("12.7",), ("12abc",), (" -3x",), ("x1",), (None,), ("99999999999",), ("-" + "9" * 40,)], "c string")
    assert [r[0] for r in df.select(int_or_zero("c")).collect()] == [12, 12, -3, 0, 0, (1 << 31) - 1, -(1 << 31)]
