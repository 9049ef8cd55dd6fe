"""Bloom-filtered key checks equal the plain join and read less."""

from tallyframe.operators import changes
from tallyframe.sources.keyfilter import KeyFilter

from .conftest import rows


def test_filtered_check_equals_the_join(spark, tmp_dir):
    table = spark.range(3000).selectExpr("case when id % 50 <> 0 then 'k' || id end as address")
    requests = spark.range(400).selectExpr("id as request_id", "case when id % 40 = 7 then 'k' || (id * 9) when id % 40 <> 3 "
                                           "then 'new' || id end as address")
    store = KeyFilter(spark, f"{tmp_dir}/keys", buckets=64).build(table, "address")
    assert store.keys().count() == 2940
    got = store.existing(requests, "address")
    assert rows(got) == rows(changes.existing_keys(requests, table, "address"), "request_id", "address") and got.count() > 5
    passed = store.may_exist(requests, "address").count()
    assert got.count() <= passed < 40                       # of 390 keys, about 1 in 100 new ones passes
    few = requests.where("request_id % 40 = 7 and request_id < 100")
    store.existing(few, "address").collect()
    read = store.may_exist(few, "address").select("bucket").distinct().count()
    assert read <= 3                                        # buckets of 64 that are read


def test_many_chunks_and_no_keys(spark, tmp_dir):
    big = KeyFilter(spark, f"{tmp_dir}/big", buckets=2).build(spark.range(30_000).selectExpr("id as key"), "key")
    asked = spark.range(25_000, 45_000).selectExpr("id as key", "id as n")
    assert big.existing(asked, "key").count() == 5_000
    assert 5_000 <= big.may_exist(asked, "key").count() < 5_600
    none = KeyFilter(spark, f"{tmp_dir}/none", buckets=2).build(spark.range(5).selectExpr("cast(null as string) as key"), "key")
    assert none.existing(asked, "key").count() == 0
