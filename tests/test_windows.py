import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators.windows import ordered_positions

from .conftest import rows


def test_matches_plain_window_with_a_hot_key(spark):
    rnd = random.Random(7)
    data = [(0 if i % 3 == 0 else rnd.randint(1, 40), rnd.randint(0, 50), i, rnd.randint(0, 100)) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, t long, id long, v long")   # key 0 holds a third of the rows
    got = ordered_positions(df, "k", ["t", "id"], value="v", hot_rows=200, partitions=12)   # key 0 is hot
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("k", "t", "id", "v", F.row_number().over(w).alias("position"),
                     F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                     .alias("running_before"))
    cols = ["k", "t", "id", "v", "position", "running_before"]
    assert rows(got, *cols) == rows(want, *cols)
    # the hot key really is spread: its rows land in several range partitions
    spread = (df.repartitionByRange(12, "k", "t", "id").where("k = 0")
              .select(F.spark_partition_id().alias("p")).distinct().count())
    assert spread > 1


def test_positions_only_both_paths(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 1, 3)], "k long, t long, id long")
    want = [(1, 1), (2, 2), (3, 1)]
    assert rows(ordered_positions(df, "k", ["t", "id"]), "id", "position") == want
    assert rows(ordered_positions(df, "k", ["t", "id"], hot_rows=0, partitions=2), "id", "position") == want


def test_hot_null_key_is_split(spark):
    data = [(None if i % 2 else i % 5, i % 7, i) for i in range(400)]
    df = spark.createDataFrame(data, "k long, t long, id long")
    got = ordered_positions(df, "k", ["t", "id"], value="id", hot_rows=100, partitions=9)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("k", "id", F.row_number().over(w).alias("position"), F.coalesce(F.sum("id").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("running_before"))
    cols = ["id", "position", "running_before"]
    assert rows(got, *cols) == rows(want, *cols)


def test_descending_order(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)], "k long, id long")
    want = [(i, 50 - i) for i in range(50)]
    for hot in (10, 1000):
        assert rows(ordered_positions(df, "k", [F.col("id").desc()], hot_rows=hot, partitions=4), "id", "position") == want
