"""Operator 8: benchmark decontamination by containment search, in Spark SQL functions only.

A short test item is found inside a document of any length by *containment*: the share of
the item's distinct five-word shingles that the document has. Items are partitioned by
size; an item of ``m`` shingles keeps a bottom MinHash sketch of ``m - ceil(c * m) + 1``
shingles, the smallest under one hash order. A document that contains the share ``c`` of
the item misses at most ``m - ceil(c * m)`` of its shingles, hence has one of the sketch:
the search loses nothing, and its cost per document does not depend on the item's length.
An item under five words is one shingle of its own length; documents are also cut into
shingles of the lengths, one to four, that such items have.
Candidates are then verified by exact containment of all shingles.

The documents' shingles are generated and probed inside one code-generated stage; only
pairs with a hit are shuffled, after partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import sized, written
from tallyframe.llm.quality_rules import words_of

WIDTH = 5
MIN_PERCENT = 80


def _shingles(df: DataFrame, width: int) -> DataFrame:
    """Rows of ``df`` (with ``text``) exploded to ``gram``: the hash of each ``width`` words;
    a shorter text is one shingle, a text without words none."""
    at = ", ".join(f"get(words, i + {k})" for k in range(width))
    keep = [c for c in df.columns if c != "text"]
    return (df.select(*keep, words_of(F.lower("text")).alias("words")).where("size(words) > 0")
            .select(*keep, "words", F.explode(F.expr(f"sequence(0, greatest(size(words) - {width}, 0))")).alias("i"))
            .select(*keep, F.expr(f"xxhash64({at})").alias("gram")))


def _short_widths(items: DataFrame, width: int) -> list[int]:
    """The lengths below ``width`` words of the items, at most ``width - 1`` numbers: such an item is one
    shingle, which documents must be cut into as well."""
    n = F.size(words_of(F.lower("text")))
    return sorted(r[0] for r in items.select(n.alias("n")).where(F.col("n").between(1, width - 1)).distinct().collect())


def _all_shingles(df: DataFrame, widths: list[int]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_shingles(df, w) for w in widths])


def _enough(found: Column, size: Column, percent: int) -> Column:
    return 100 * found >= percent * size


def item_sketches(items: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(item_id, m, gram) of all items, and of their sketches. ``m`` partitions the items by
    size: it alone sets how many of an item's smallest hashes are kept."""
    grams = (_shingles(items, width).where("item_id is not null").distinct())
    grams = grams.groupBy("item_id").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    grams = written(grams.select("item_id", F.size("grams").alias("m"), "grams"), "decon-items")
    full = grams.select("item_id", "m", F.explode("grams").alias("gram"))
    needed = F.expr(f"m - cast((m * {percent} + 99) div 100 as int) + 1")
    sketch = grams.select("item_id", "m", F.explode(F.slice("grams", F.lit(1), needed)).alias("gram"))
    return full, sketch


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text", width: int = WIDTH,
                    percent: int = MIN_PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_common, containment): every pair with
    ``100 * n_common >= percent * n_item_shingles``.

    Texts are lower-cased. Null or wordless texts contain and match nothing; an item shorter than
    ``width`` words is found wherever its words stand one after another. Rows without an id are not
    reported; rows that share an id count as one document (or item), and repeated rows
    change nothing. Empty tables give an empty result. Other columns are not read."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    i = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    full, sketch = item_sketches(i, width, percent)
    widths = [width, *_short_widths(i, width)]
    # A bare gram list for the probe, so that shared passages do not multiply the documents' rows.
    probe = sized(written(sketch.select("gram").distinct(), "decon-sketch"))
    hits = _all_shingles(d, widths).join(probe, "gram").distinct()
    pairs = written(hits.join(sized(sketch.select("item_id", "gram")), "gram").select("doc_id", "item_id").distinct(),
                    "decon-candidates")
    suspects = d.join(sized(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    # Only shingles of some item are worth a shuffle; the pair must be a candidate.
    known = sized(written(full.select("gram").distinct(), "decon-grams"))
    have = _all_shingles(suspects, widths).join(known, "gram").distinct()
    common = (have.join(sized(full), "gram").join(sized(pairs), ["doc_id", "item_id"], "left_semi")
              .groupBy("doc_id", "item_id", "m").agg(F.count("*").alias("n_common")))
    return common.where(_enough(F.col("n_common"), F.col("m"), percent)).select(
        "doc_id", "item_id", F.col("m").cast("long").alias("n_item_shingles"), "n_common",
        (F.col("n_common") / F.col("m")).alias("containment"))
