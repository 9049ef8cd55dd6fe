"""Registered queries of the numbered operators: thin bindings to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.chat import digests, format_conversations, read_back
from tallyframe.llm.common import table
from tallyframe.llm.decontaminate import contained_items
from tallyframe.llm.html_extract import extract_main_text
from tallyframe.llm.infill import fill_in_middle, restored
from tallyframe.llm.jaccard import near_duplicate_groups
from tallyframe.llm.licenses import scan_licenses
from tallyframe.llm.line_dedup import dedup_lines
from tallyframe.llm.mixing import mix
from tallyframe.llm.oracles import ORACLES  # noqa: F401
from tallyframe.llm.packing import pack_tokens
from tallyframe.llm.periodic_runs import periodic_runs, with_planted_periods
from tallyframe.llm.quality_rules import quality_rules
from tallyframe.llm.substring_dedup import dedup_substrings
from tallyframe.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line-first verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 4-word shingles and a Jaccard similarity of 0.85."""
    out = near_duplicate_groups(table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("group").alias("component_id"))


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with containment of 0.8 or more."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op6_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2,048 token ids."""
    return pack_tokens(table(spark, sf_dir, "documents"))


@_query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen for a mix of domains, languages and sources, one row per epoch.
    Domains: the crawl (src0) and the curated sources."""
    domain = F.when(F.col("source") == "src0", "crawl").otherwise("curated")
    weights = {("crawl",): 0.25, ("curated",): 0.75, ("curated", "en"): 2.0, ("crawl", "en"): 2.0}
    return mix(table(spark, sf_dir, "documents"), weights, domain=domain).drop("row").withColumnRenamed("id", "doc_id")


@_query
def op1_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


@_query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written, normalised and read back by the sidecar index."""
    return round_trip(spark, table(spark, sf_dir, "pages"))


@_query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted form; conversation -1 consists
    of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digests(read_back(format_conversations(turns.unionByName(extra))))


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence words, places and labels of every document, and its evaluated licence expressions."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                        "score", F.array_join("expressions", " ; ").alias("expressions"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that repeat an earlier run of 50 words or more, for every document."""
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", "removed", F.length("clean_text").alias("n_chars_left"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, one text in ten with a planted period."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")), "id")
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = found.withColumn("best", best).withColumn("length", -F.col("best.l"))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "length", "best.period",
        F.floor(1000 * F.col("length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle form, and the digest of the text rebuilt from it."""
    d = fill_in_middle(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n", "form", F.col("start").alias("prefix_chars"),
                    (F.col("end") - F.col("start")).alias("middle_chars"),
                    F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                    F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


@_query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 35 words that occur more than once."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
