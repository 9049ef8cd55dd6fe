"""Operator 9: mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree domain / language / source. A token budget is handed down
from the root by water-filling: children share their parent's budget in proportion to their
weights, and a child that can't use its share (its capacity is its tokens times
``max_epochs``) passes the rest to its siblings. Only what all siblings together can't use
counts as shortage of the parent, because a parent's capacity is the sum of its children's;
so shortages go to siblings before ancestors.

A leaf with budget B and supply S takes ``floor(B / S)`` whole epochs and a token-prefix of
the next one: the documents of that epoch's seeded order (md5 of seed, epoch and id) up to
the last that fits. The prefix is cut without sorting a leaf: token sums per order bucket
(``BUCKETS`` a leaf) find the bucket of the cut, and only that bucket is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import sized, written

LEVELS = ["domain", "language", "source"]
#: Order buckets of a leaf: the first three hexadecimal digits of the order key.
BUCKETS = 4096
Weights = dict[tuple[str, ...], float]


def _weight(weights: Weights, depth: int) -> Column:
    """The weight of a node at ``depth`` (1 to 3); 1 where none is given."""
    known = {k: v for k, v in weights.items() if len(k) == depth}
    if not known:
        return F.lit(1.0)
    pairs = [x for k, v in known.items() for x in (F.lit("\u0001".join(k)), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[F.concat_ws("\u0001", *LEVELS[:depth])], F.lit(1.0))


def _water_fill(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """``children`` (parent, key, cap, w, budget of the parent) with ``budget`` replaced by each
    child's own. Sorted by capacity per weight, a child is filled if it can't use the level
    that the remaining budget gives to the remaining weights; the first that can sets the
    level of all later ones."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("cap") / F.col("w")), key)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = children.withColumn("level", (F.col("budget") - before) / left)
    c = c.withColumn("filled", F.col("cap") <= F.col("level") * F.col("w"))
    c = c.withColumn("common", F.max(F.when(~F.col("filled"), F.col("level"))).over(group))
    return c.withColumn("budget", F.when(F.col("filled"), F.col("cap")).otherwise(
        F.greatest(F.col("common") * F.col("w"), F.lit(0.0)))).drop("level", "filled", "common")


def leaf_budgets(supply: DataFrame, weights: Weights, budget: float | None, max_epochs: int) -> DataFrame:
    """(domain, language, source, supply, budget): ``supply`` has the leaves' tokens."""
    leaves = supply
    for depth in (1, 2, 3):
        leaves = leaves.withColumn(f"w{depth}", _weight(weights, depth))
    usable = (F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0)
    leaves = leaves.withColumn("cap", F.col("supply") * F.lit(float(max_epochs))).where(usable & (F.col("supply") > 0))
    for depth, key in enumerate(LEVELS, 1):
        nodes = leaves.groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap"), F.first(f"w{depth}").alias("w"),
                                                    F.sum("supply").alias("supply"))
        if depth == 1:      # the domains are one group below the root; by default it has all tokens
            everything = F.sum("supply").over(Window.partitionBy(F.lit(0))).cast("double")
            nodes = nodes.withColumn("budget", everything if budget is None else F.lit(float(budget)))
        else:
            nodes = nodes.join(filled, LEVELS[:depth - 1])  # noqa: F821  the level above
        filled = _water_fill(nodes, LEVELS[:depth - 1], key).select(*LEVELS[:depth], "budget")
    return leaves.select(*LEVELS, "supply").join(filled, LEVELS)


def mix(docs: DataFrame, weights: Weights | None = None, budget: float | None = None, max_epochs: int = 4,
        seed: int = 42, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(row, id, domain, language, source, n_tokens, epoch): ``row`` is the whole input row as a
    struct; a row of ``docs`` appears once for every epoch that takes it.

    ``budget`` in tokens (words between ASCII white space), by default all that there are;
    ``weights`` maps paths such as ``("web", "en")`` to weights, 1 where absent; weight 0
    leaves a subtree out. Null domains, languages and sources count as empty names, null texts
    as no tokens; a leaf without any tokens takes nothing. Ties of equal ids go by a hash of the
    text; repeated rows are taken one by one. An empty table gives an empty result."""
    def name(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    text = F.col(text_col)
    d = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"),
        name(F.lit("all") if domain is None else domain).alias("domain"), name(F.col(lang_col)).alias("language"),
        name(F.col(source_col)).alias("source"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"),
        F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long").alias("n_tokens"))
    narrow = written(d.select(*LEVELS, "id", "tie", "n_tokens"), "mix-narrow")
    supply = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    leaves = leaf_budgets(supply, weights or {}, budget, max_epochs)
    whole = F.least(F.floor((F.col("budget") + 1e-6) / F.col("supply")), F.lit(max_epochs))
    leaves = leaves.withColumn("whole", whole).withColumn(
        "rest", F.floor(F.col("budget") + 1e-6) - F.col("whole") * F.col("supply"))
    leaves = sized(written(leaves.select(*LEVELS, "whole", "rest"), "mix-leaves"))

    key = F.md5(F.concat_ws(":", F.lit(seed), "whole", F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    placed = narrow.join(leaves, LEVELS).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    sums = placed.groupBy(*LEVELS, "bucket", "whole", "rest").agg(F.sum("n_tokens").alias("tokens"))
    by_bucket = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("tokens").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    # The cut lies in the first bucket whose end exceeds the rest; without one all is taken.
    cut = written(sums.where("upto > rest").groupBy(*LEVELS).agg(
        F.min("bucket").alias("bucket"), F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens"))
                                                       .alias("room"))).alias("c"))
        .select(*LEVELS, "bucket", F.col("c.room").alias("room")), "mix-cuts")
    running = Window.partitionBy(*LEVELS).orderBy("key", "tie").rangeBetween(Window.unboundedPreceding, 0)
    inside = placed.join(sized(cut), [*LEVELS, "bucket"]).select(
        *LEVELS, "key", "tie", "room", F.sum("n_tokens").over(running).alias("upto"))
    first_out = inside.where("upto > room").groupBy(*LEVELS).agg(F.min(F.struct("key", "tie")).alias("first_out"))
    plan = sized(written(leaves.join(first_out, LEVELS, "left"), "mix-plan"))

    taken = d.join(plan, LEVELS).withColumn("copies", F.col("whole") + F.when(
        F.col("rest") > 0, F.coalesce(F.struct(key.alias("key"), "tie") < F.col("first_out"), F.lit(True))
        .cast("long")).otherwise(F.lit(0)))
    return taken.where("copies > 0").select(
        "row", "id", *LEVELS, "n_tokens", F.explode(F.expr("sequence(0, cast(copies as int) - 1)")).alias("epoch"))
