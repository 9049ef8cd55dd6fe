"""Audit sink and source, application log source.

Audit rows carry their details as JSON text (``to_json`` of a struct), as the ledger
stored JSONB; ``audit_details`` turns the run records back into typed rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.schemas import LOG_LINE, RUN_DETAILS

AUDIT_COLUMNS = ["user_id", "action", "resource", "details", "ip_address", "created_at", "ref_id"]


def _audit(df: DataFrame, action: str, resource: str, details: F.Column | None, ref: str,
           at: str | None) -> DataFrame:
    """Audit rows; the client address comes from a column ``ip_address``, where ``df`` has one."""
    text = F.to_json(details, {"ignoreNullFields": "false"}) if details is not None else F.lit(None).cast("string")
    ip = F.col("ip_address") if "ip_address" in df.columns else F.lit(None)
    return df.select(F.col("user_id").cast("bigint").alias("user_id"), F.lit(action).alias("action"),
                     F.lit(resource).alias("resource"), text.alias("details"),
                     ip.cast("string").alias("ip_address"),
                     (F.col(at) if at else F.lit(None)).cast("timestamp_ntz").alias("created_at"),
                     F.col(ref).cast("bigint").alias("ref_id"))


def run_audit(records: DataFrame, source: str = "all") -> DataFrame:
    """S9 for ``run_allocation``: one audit row per accepted run (``allocation.run_records``) whose
    details hold ``{amount, source, allocations: [{ruleId, ruleName, amount, percentage}]}``."""
    details = F.struct(F.col("amount").cast("decimal(20,2)").alias("amount"), F.lit(source).alias("source"),
                       F.col("allocations"))
    return _audit(records, "run_allocation", "allocation", details, "run_id", "created_at")


def action_audit(df: DataFrame, action: str, resource: str, detail_cols: list[str] | None,
                 ref: str, at: str | None = None) -> DataFrame:
    """S9 for the other actions: details are the named columns as a JSON object
    (no details when ``detail_cols`` is None, as for a login)."""
    details = F.struct(*[F.col(c) for c in detail_cols]) if detail_cols else None
    return _audit(df, action, resource, details, ref, at)


def audit_union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def append_audit(audit: DataFrame, path: str, period: str = "day") -> None:
    """S9 sink: append audit rows to a Parquet table partitioned by ``dt``, the day (or the first day of
    the ``period``) of the row. Rows are range-partitioned on the period, then on reference and
    action, so a task writes a few neighbouring periods and a full one is split."""
    dated = audit.withColumn("dt", F.to_date(F.date_trunc(period, "created_at")))
    (dated.repartitionByRange("dt", "ref_id", "action").write.mode("append").partitionBy("dt").parquet(path))


def audit_details(audit: DataFrame) -> DataFrame:
    """S10 + X19: run records back to one typed row per allocation."""
    runs = audit.where(F.col("action") == "run_allocation").select(
        "ref_id", "user_id", "created_at", F.from_json("details", RUN_DETAILS).alias("d"))
    return (runs.select(F.col("ref_id").alias("run_id"), "user_id", "created_at",
                        F.col("d.amount").alias("amount"), F.col("d.source").alias("source"),
                        F.explode("d.allocations").alias("a"))
            .select("run_id", "user_id", "created_at", "amount", "source",
                    F.col("a.ruleId").alias("rule_id"), F.col("a.ruleName").alias("rule_name"),
                    F.col("a.amount").alias("share"), F.col("a.percentage").alias("percentage")))


def ingest_details(audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S10 + X19: the JSON details of any action parsed once, at ingest, into a VARIANT column ``details_v``, whose
    fields are read later by path (``detail``) without parsing the text again or naming a schema. Returns
    ``(rows, rejects)``: details that are no JSON make a row of the rejects, with the text as it came."""
    # As the one element of a list, so that text behind the value is an error too.
    parsed = audit.withColumn("_list", F.try_parse_json(F.concat(F.lit("["), "details", F.lit("]"))))
    parsed = parsed.withColumn("details_v", F.when(F.try_variant_get("_list", "$[1]", "variant").isNull(),
                                                   F.try_variant_get("_list", "$[0]", "variant"))).drop("_list")
    bad = F.col("details").isNotNull() & F.col("details_v").isNull()
    return (parsed.where(~bad).drop("details"),
            parsed.where(bad).drop("details_v").withColumn("reason", F.lit("details are no JSON")))


def detail(path: str, type_: str) -> F.Column:
    """A field of the parsed details (``$.a.b[0]``) as ``type_``; null where there is none or it is of another kind."""
    return F.try_variant_get("details_v", path, type_)


def log_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The log lines that ``read_log`` can't use, each with a ``reason``: malformed (no JSON object, or cut off), or
    no level. With the used lines they make up the file."""
    fields = T.StructType([*LOG_LINE.fields, T.StructField("line", T.StringType())])
    lines = spark.read.schema(fields).option("columnNameOfCorruptRecord", "line").json(path)
    reason = F.when(F.col("line").isNotNull(), "malformed").when(F.col("level").isNull(), "no level")
    return lines.withColumn("reason", reason).where("reason is not null")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Structured JSON-lines application log with its declared schema. Lines that are malformed or
    have no level are left to ``log_rejects``."""
    return spark.read.schema(LOG_LINE).json(path).where("level is not null")


def log_errors(log: DataFrame) -> DataFrame:
    """The error-only view of the log (the error file of the logger)."""
    return log.where(F.col("level") == "error")
