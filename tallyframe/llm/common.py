"""Helpers shared by the operators: written intermediates and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import materialize, scratch_path

#: Rows of a narrow keyed side (ids and small numbers) that may be broadcast.
BROADCAST_ROWS = 500_000


#: Rows of one key that a shuffle join may always have in one task.
HOT_ROWS = 1_000

#: Makes Spark remove a write's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, pruned by column when
    read again, and not lost with an executor. The shuffle files behind it go at once."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from ``written`` that nothing reads any more. Where there
    is no JVM to ask (Spark Connect) they stay until the shared folder is cleared."""
    spark = df.sparkSession
    if getattr(spark, "_jsc", None) is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written ``df`` with a broadcast hint if its measured count is within ``rows``;
    otherwise unhinted, for a shuffle join whose skew AQE splits."""
    return F.broadcast(df) if df.count() <= rows else df


def join_split(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join of ``left`` with the columns of ``right`` but ``rows``; ``right`` has one row per key, and
    says in ``rows`` how many of ``left`` have it. Both are read several times: pass written tables.

    Keys with more than a ten-thousandth of all rows of ``left`` (``HOT_ROWS`` at least) are no more than
    10,000 and are broadcast; all others join by a shuffle at every size, in which no key weighs more than that."""
    bound = max(HOT_ROWS, left.count() // 10_000)
    hot = F.broadcast(right.where(F.col(rows) > bound).drop(rows))
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(
        right.where(F.col(rows) <= bound).drop(rows).hint("merge"), keys)
    return left.join(hot, keys).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges``: root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge set
    stays the same; every step is a partial minimum and a join, each round is checkpointed,
    and nothing but two numbers per round reaches the driver. Self-loops are ignored; null
    ends are dropped. No edges: an empty result."""
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u is not null and v is not null and u != v").distinct())
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = materialize(small.select("e.u", "e.v").where("u != v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
