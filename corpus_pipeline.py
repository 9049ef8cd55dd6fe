"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes every stage's result as Parquet into the shared
folder and gives it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import sized, table, written
from tallyframe.llm.decontaminate import contained_items
from tallyframe.llm.jaccard import near_duplicate_groups
from tallyframe.llm.mixing import mix
from tallyframe.llm.packing import pack_tokens
from tallyframe.llm.quality_rules import clean

#: Target weights of the mix: the crawl (src0) against the curated sources, and within both
#: the languages. Sources of one language share alike.
WEIGHTS = {("crawl",): 0.35, ("curated",): 0.65,
           ("crawl", "en"): 0.6, ("crawl", "de"): 0.15, ("crawl", "fr"): 0.15, ("crawl", "es"): 0.1,
           ("curated", "en"): 0.6, ("curated", "de"): 0.15, ("curated", "fr"): 0.15, ("curated", "es"): 0.1}

#: Names a row by its doc_id and a hash of its text, within a stage.
KEY = "_row_key"


def domain_of() -> F.Column:
    return F.when(F.col("source") == "src0", "crawl").otherwise("curated")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failed lines (``n_chars`` follows) and the documents that the rules reject."""
    return clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of five-word Jaccard similarity 0.8 or more, and
    of rows equal in doc_id and text one. Texts that share a doc_id are judged one by one. Rows
    without a doc_id stay."""
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("hash")))
    rows = docs.withColumn(KEY, key)
    groups = written(near_duplicate_groups(rows, KEY, width=5, percent=80).where("id is not null"), "pipeline-groups")
    losers = groups.where(F.col("id") != F.col("group")).select(F.col("id").alias(KEY)).distinct()
    kept = rows.join(sized(losers), KEY, "left_anti")
    again = written(groups.groupBy(F.col("id").alias(KEY)).agg(F.count("*").alias("k")).where("k > 1")
                    .select(KEY), "pipeline-repeats")
    if again.isEmpty():
        return kept.select(docs.columns)
    again = sized(again)
    once = kept.join(again, KEY, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, KEY, "left_anti").unionByName(once).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the rows, also those without a doc_id, whose text contains a benchmark item."""
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.xxhash64("text").alias("hash"))
    rows = docs.withColumn(KEY, key)
    found = written(contained_items(rows, table(spark, sf_dir, "benchmark"), KEY).select(F.col("doc_id").alias(KEY))
                    .distinct(), "pipeline-contained")
    return rows.join(sized(found), KEY, "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to ``WEIGHTS`` within all tokens there are; a document taken for
    several epochs comes as several rows."""
    return mix(docs, WEIGHTS, domain=domain_of()).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every row."""
    return pack_tokens(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mixing),
          ("token-ID / binary output", tokens)]

#: Tokenizing can't be put in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-stage{k}")
    return docs
