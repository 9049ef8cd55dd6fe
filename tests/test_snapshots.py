"""Committed snapshots: old versions stay readable, untouched folders stay, conflicts are found."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import changes
from tallyframe.sources.snapshots import Conflict, Snapshots

from .conftest import rows

AS_OF = "2024-02-01 00:00:00"


def table(spark):
    return spark.range(200).selectExpr("id", "id % 5 as user_id", "cast(id as decimal(20,2)) as balance",
                                       "timestamp_ntz'2024-01-01 00:00:00' as updated_at")


def test_changes_rewrite_only_their_buckets(spark, tmp_dir):
    snap = Snapshots(spark, f"{tmp_dir}/t", buckets=16)
    assert snap.version() == -1 and snap.create(table(spark)) == 0
    old = snap.read()
    before = snap.manifest()["folders"]
    edits = spark.createDataFrame([(7, 2, 1099), (7, 1, 98), (500, 0, 97)], "id long, user_id long, balance int")
    update = lambda part: changes.apply_updates(part, edits.withColumn("seq", F.lit(1)), ["balance"], ["seq"], AS_OF)[0].drop("changed")
    assert snap.change(edits, update) == 1
    after = snap.manifest()["folders"]
    touched = {str(r[0]) for r in edits.select(snap.bucket()).collect()}
    assert {b for b in before if before[b] != after.get(b)} == touched
    assert snap.read().count() == 200 and snap.read().where("balance = 1099").collect()[0].id == 7
    assert old.where("balance = 1099").count() == 0 and rows(old) == rows(table(spark))      # still the old version
    assert rows(snap.read(0)) == rows(table(spark))


def test_deletes_inserts_and_empty_buckets(spark, tmp_dir):
    snap = Snapshots(spark, f"{tmp_dir}/t", buckets=4)
    snap.create(table(spark).where("id < 4"))
    gone = spark.range(4)
    assert snap.change(gone, lambda part: part.join(gone, "id", "left_anti")) == 1
    assert snap.read().count() == 0 and snap.read().columns == table(spark).columns
    new = table(spark).where("id >= 190").unionByName(table(spark).limit(1).withColumn("id", F.lit(None).cast("long")))
    assert snap.change(new, lambda part: part.unionByName(new)) == 2
    assert sorted(str(r.id) for r in snap.read().collect()) == sorted([*map(str, range(190, 200)), "None"])
    assert snap.change(new.limit(0), lambda part: part.limit(0)) == 2                  # no keys: nothing happens
    assert snap.read().count() == 11


def test_writers_conflict(spark, tmp_dir):
    a, b = (Snapshots(spark, f"{tmp_dir}/t", buckets=4) for _ in range(2))
    a.create(table(spark))
    key = spark.createDataFrame([(3,)], "id long")

    def slow(part):                          # while b works, a commits
        a.change(key, lambda p: p.where("id != 3"))
        return part

    with pytest.raises(Conflict):
        b.change(key, slow)
    assert b.version() == 1 and b.read().count() == 199
    assert b.change(key, lambda p: p) == 2


def test_a_writer_that_dies_leaves_no_version(spark, tmp_dir, monkeypatch):
    snap = Snapshots(spark, f"{tmp_dir}/t", buckets=4)
    snap.create(table(spark))
    monkeypatch.setattr(snap.files, "create", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        snap.change(spark.range(200), lambda p: p.limit(0))
    again = Snapshots(spark, f"{tmp_dir}/t", buckets=4)
    assert again.version() == 0 and again.read().count() == 200


def test_rows_must_stay_in_their_buckets(spark, tmp_dir):
    snap = Snapshots(spark, f"{tmp_dir}/t", buckets=16)
    snap.create(table(spark))
    with pytest.raises(ValueError, match="no given key"):
        snap.change(spark.range(1), lambda p: p.unionByName(table(spark)))
    assert snap.version() == 0
