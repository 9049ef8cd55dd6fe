"""Operator 10: line dedup with a suffix array over line-ID sequences.

Texts are sequences of line ids (64-bit hashes of the lines that have a word). Suffixes are
ranked by *distributed prefix doubling*: rank 0 is the line id; the rank of round ``k + 1``
orders pairs (rank_k(i), rank_k(i + 2^k)). Ranks needn't be dense, so a range-partitioned
sort of the distinct pairs numbers them in one pass, without any task or the driver seeing
all of them. Suffixes of equal rank after round ``k`` form an LCP interval: they share
their first ``2^k`` lines. Lines that occur once break every run, and take no part.

A run that repeats may do so at another place than its parts, so it isn't enough to follow one
earlier copy. But a run of ``min_words`` words with *any* earlier copy is the union of its
*windows*: from each line on, the fewest lines with ``min_words`` words, and up to each line, the
fewest lines with as many (a line that the first can't reach, as less than that is left behind
it, ends a window of the second kind). Each has an earlier copy, being part of the run. And a
window has the same extent wherever its lines stand, so it's found by its name alone: the two
ranks of the blocks of ``2^a <= m`` lines at the start and end of its ``m`` lines. Windows of one
name are an LCP interval; its first member (by document id and line) is the original, and the
lines of all others are deleted. Every deleted line has an earlier copy that stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import sized, written

MIN_WORDS = 50
WS = "[^ \\t-\\r]"
AT = ["doc", "i"]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, text, lines) with ``doc`` naming (id, text): repeated rows are one document."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.select("id", F.xxhash64(F.col("id").cast("string"), F.col("id").isNull(), "text").alias("doc"), "text",
                    F.filter(F.split("text", "\n"), lambda x: x.rlike(WS)).alias("lines"))


def _shifted(ranks: DataFrame, by: int, name: str) -> DataFrame:
    return ranks.select("doc", (F.col("i") - by).alias("i"), F.col("rank").alias(name))


def _double(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks of blocks of 2^(k+1) lines from those of 2^k lines."""
    pairs = written(ranks.join(_shifted(ranks, 1 << k, "next"), AT, "left").select(
        *AT, F.col("rank").alias("a"), F.coalesce("next", F.lit(-1).cast("long")).alias("b")), "lines-pairs")
    n = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = (pairs.select("a", "b").distinct().repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b")
             .withColumn("rank", F.monotonically_increasing_id()))
    return written(pairs.join(sized(written(names, "lines-names")), ["a", "b"]).select(*AT, "rank"), "lines-ranks")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(id, doc, i, length, id_of, doc_of, i_of): at line ``i`` of ``doc`` starts a window of
    ``length`` lines that is a later copy of the lines from ``i_of`` of ``doc_of``, its first place.
    The windows of a document cover all its runs of ``min_words`` words that have an earlier copy.
    Lines count from 0, those without a word left out."""
    d = _lines(docs, id_col, text_col).select("id", "doc", F.posexplode("lines").alias("i", "line"))
    lines = written(d.select("id", "doc", F.col("i").cast("long").alias("i"), F.xxhash64("line").alias("rank"),
                             F.regexp_count("line", F.lit(f"{WS}+")).cast("long").alias("w")), "lines-all")
    often = written(lines.groupBy("rank").agg(F.count("*").alias("k")).where("k > 1").select("rank"), "lines-often")
    lines = lines.join(sized(often), "rank").dropDuplicates(AT)

    # Islands of neighbouring repeated lines; ``s`` counts words before a line, ``t`` up to its end.
    doc = Window.partitionBy("doc").orderBy("i")
    lines = lines.withColumn("island", F.col("i") - F.row_number().over(doc))
    island = Window.partitionBy("doc", "island")
    lines = lines.withColumn("t", F.sum("w").over(island.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("s", F.col("t") - F.col("w"))
    lines = lines.withColumn("last", F.max("i").over(island)).withColumn("total", F.sum("w").over(island))
    reach = F.min("i").over(island.orderBy("s").rangeBetween(min_words, Window.unboundedFollowing))
    lines = lines.withColumn("m", F.coalesce(reach, F.when(
        F.col("total") - F.col("s") >= min_words, F.col("last") + 1)) - F.col("i"))
    # The window up to a line starts behind line ``ahead`` and ``skipped`` words; if it has enough
    # words without that line, it isn't one of the windows ``m`` as well.
    upto = island.orderBy("t").rangeBetween(Window.unboundedPreceding, -min_words)
    lines = lines.withColumn("ahead", F.coalesce(F.max("i").over(upto), F.min("i").over(island) - 1))
    lines = lines.withColumn("skipped", F.coalesce(F.max("t").over(upto), F.lit(0)))
    lines = lines.withColumn("back", F.when(F.col("s") - F.col("skipped") >= min_words, F.col("i") - F.col("ahead")))
    lines = written(lines.select("id", "doc", "i", "rank", "m", "back"), "lines-repeated")
    ranks = [lines.select(*AT, "rank")]
    longest = lines.agg(F.max(F.greatest("m", "back"))).first()[0] or 0
    while (1 << len(ranks)) <= longest:
        ranks.append(_double(ranks[-1], len(ranks) - 1))

    # Names of the windows.
    windows = lines.where("m is not null or back is not null").select("id", "doc", F.explode(F.array(
        F.struct("i", "m"), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("m")))).alias("at"))
    windows = windows.select("id", "doc", "at.i", "at.m").where("m is not null")
    named, level = None, F.floor(F.log2("m")).cast("int")
    for a, r in enumerate(ranks):
        here = windows.where(level == a).withColumn("j", F.col("i") + F.col("m") - (1 << a))
        here = here.join(r.withColumnRenamed("rank", "x"), AT).join(
            r.select("doc", F.col("i").alias("j"), F.col("rank").alias("y")), ["doc", "j"])
        here = here.select("id", "doc", "i", "m", "x", "y")
        named = here if named is None else named.unionByName(here)
    named = written(named, "lines-windows")
    first = (named.groupBy("m", "x", "y").agg(F.min(F.struct("id", "doc", "i")).alias("of"), F.count("*").alias("k"))
             .where("k > 1").select("m", "x", "y", F.col("of.id").alias("id_of"), F.col("of.doc").alias("doc_of"),
                                    F.col("of.i").alias("i_of")))
    return named.join(sized(written(first, "lines-first")), ["m", "x", "y"]).where(
        "not (doc = doc_of and i = i_of)").select("id", "doc", "i", F.col("m").alias("length"), "id_of", "doc_of", "i_of")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_lines, n_removed, removed, clean_text): one row per row of ``docs``; ``removed`` are the
    sorted numbers of the deleted lines among the ``n_lines`` that have a word.

    A text that loses lines is joined anew from the others that have a word; all other texts
    stay as they are. Null texts are empty. Rows equal in id and text are one document and
    get the same result; null ids come first in the order. An empty table gives no rows."""
    runs = written(repeated_runs(docs, id_col, text_col, min_words).select(
        "doc", "i", (F.col("i") + F.col("length")).alias("end")), "lines-runs")
    # By end, windows start in order too: none lies inside another and ends before it. So each
    # adds just the lines behind the end of the one before.
    done = F.lag("end").over(Window.partitionBy("doc").orderBy("end", "i"))
    fresh = runs.withColumn("i", F.greatest("i", done)).where("i < end")
    gone = (fresh.select("doc", F.explode(F.sequence(F.col("i"), F.col("end") - 1)).alias("i"))
            .groupBy("doc").agg(F.sort_array(F.collect_list(F.col("i").cast("int"))).alias("removed")))
    d = _lines(docs, id_col, text_col).join(sized(written(gone, "lines-removed")), "doc", "left")
    d = d.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    left = F.expr("transform(array_except(sequence(0, size(lines) - 1), removed), n -> get(lines, n))")   # both hashed once
    return d.select("id", F.size("lines").alias("n_lines"), F.size("removed").alias("n_removed"), "removed",
                    F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("clean_text"))
