"""Audit details as VARIANT and the log's rejected lines: nothing vanishes."""

import json

from pyspark.sql import functions as F

from tallyframe.sources import audit

from .conftest import rows


def test_details_of_any_shape(spark):
    texts = ['{"amount":12.5,"allocations":[{"ruleId":7,"ruleName":"ü"}]}', '{"id":"x"}', "[1, 2]", "null", "7", None, "",
             '{"cut":', "no json", '{"id":1}{"id":2}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, details string")
    parsed, rejects = audit.ingest_details(df)
    got = {r.id: tuple(r)[1:] for r in parsed.select(
        "id", audit.detail("$.amount", "decimal(20,2)").cast("string"), audit.detail("$.allocations[0].ruleName", "string"),
        audit.detail("$.id", "bigint"), audit.detail("$[1]", "int")).collect()}
    assert got[0] == ("12.50", "ü", None, None) and got[1][2] is None and got[2][3] == 2 and got[5] == (None,) * 4
    assert {r.id: r.details for r in rejects.collect()} == {k: texts[k] for k in (6, 7, 8, 9)}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert dict(parsed.dtypes)["details_v"] == "variant"


def test_every_log_line_is_used_or_rejected(spark, tmp_dir):
    good = [json.dumps({"level": lv, "message": "m", "timestamp": "2024-01-01T00:00:00.123Z"}) for lv in ("error", "info", "error")]
    bad = [good[0][:20], "Error: reset", "[1]x", '{"message":"no level"}', "{}"]
    spark.createDataFrame([(x,) for x in good + bad], "value string").coalesce(2).write.text(f"{tmp_dir}/log")
    used = audit.read_log(spark, f"{tmp_dir}/log")
    rejects = audit.log_rejects(spark, f"{tmp_dir}/log")
    assert used.count() == 3 and audit.log_errors(used).count() == 2
    assert rows(rejects.groupBy("reason").agg(F.count("*"))) == [("malformed", 3), ("no level", 2)]
    assert sorted(r.line for r in rejects.collect() if r.line) == sorted(bad[:3])
