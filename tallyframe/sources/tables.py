"""Ledger table snapshots on Parquet.

Tables are read with their declared schema (no inference), and every change
operator's result is written as a new snapshot to a new path, never over the input
it was computed from. Writes go to the shared folder named by the session.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schemas import LEDGER_SCHEMAS


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read ledger table ``name`` under ``root`` with its declared schema."""
    return spark.read.schema(LEDGER_SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def write_snapshot(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as snapshot ``name`` under ``root`` (a new path per snapshot)."""
    path = f"{root.rstrip('/')}/{name}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """S1 (live database): a ledger table read over JDBC in ``num_partitions`` parallel
    range scans of ``partition_column``; the schema is then forced to the declared one."""
    df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                         numPartitions=num_partitions, properties=properties or {})
    schema = LEDGER_SCHEMAS[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table (the restore check), one row per table."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
             for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_ledger(ledger, root: str, names: list[str] | None = None) -> str:
    """Write every ledger table of ``ledger`` (anything with one attribute per table,
    e.g. the bound ``Ledger``) as typed snapshots under ``root``."""
    for name in names or list(LEDGER_SCHEMAS):
        write_snapshot(getattr(ledger, name), root, name)
    return root


class SnapshotLedger:
    """Ledger tables read from snapshots written by ``write_ledger`` (or by any job
    that writes the declared schemas); same attributes as the bound ``Ledger``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name in LEDGER_SCHEMAS:
            return load_table(self.spark, self.root, name)
        raise AttributeError(name)
