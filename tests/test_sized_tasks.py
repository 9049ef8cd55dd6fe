"""Tasks of the audit job are cut by the rows of its tables, whatever the session's partition count."""

from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.plans import queries

from .conftest import SF001

SET = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]


def test_settings_hold_inside_only(spark):
    before = [spark.conf.get(k) for k in SET]
    few = int(before[0])
    with session.sized_tasks(spark, (few + 3) * session.TASK_ROWS - 1):
        assert [int(spark.conf.get(k)) for k in SET] == [few + 3, session.TASK_BYTES, session.TASK_BYTES]
    with session.sized_tasks(spark, 1):
        assert spark.conf.get(SET[0]) == before[0]
    assert [spark.conf.get(k) for k in SET] == before


def test_audit_job_has_more_tasks_on_more_rows(spark, monkeypatch):
    seen, append = [], queries.audit.append_audit

    def noted(rows, *args, **kwargs):
        seen.append(int(spark.conf.get(SET[0])))
        return append(rows, *args, **kwargs)

    monkeypatch.setattr(queries.audit, "append_audit", noted)
    few = int(spark.conf.get(SET[0]))
    want = queries.q_audit_append(spark, SF001)
    monkeypatch.setattr(session, "TASK_ROWS", 200)
    got = queries.q_audit_append(spark, SF001)
    assert seen[0] == few and seen[1] > 2 * few
    total = [F.count("*"), F.sum(F.xxhash64(*want.columns).cast("decimal(38,0)"))]
    assert got.agg(*total).first() == want.agg(*total).first()
