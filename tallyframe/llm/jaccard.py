"""Operator 4: n-gram Jaccard join by vertical partitioning.

The global order of all shingles is the order of their 64-bit hashes (``grams``). It is
cut into fragments; what two sets share is counted fragment by fragment, and the partial
overlaps are summed per pair. Three exact filters come before the counting, so that work
grows with the links and not with the pairs that share some passage:

1. *Equal fragments.* A linked pair differs in at most ``k`` shingles, so of ``k + 1 +
   spare`` fragments more than ``spare`` are equal (``grams.Fragments``). Each distinct set
   publishes one hash per fragment; sets that share none with another set have no links.
   A widely shared line or passage does not make fragments equal.
2. *Rarity.* Among the candidates left, shingles found in one set only can't be shared. A
   set with too many of them for the threshold has no links, however many near copies
   share the rest.
3. *Prefix and position.* Ordered by (frequency, hash), linked sets share one of their
   first ``n - ceil(threshold * n) + 1`` shingles; sizes and positions bound the overlap.

Links are first counted for a star around the most central node of every prefix shingle
(at most one pair per posting): the copy with the fewest changes links with most others. Components of these links are collapsed, and the pairs of
postings that lie in *different* components and pass the bounds follow; pairs within a
component can't change the result. So no group of near copies is ever expanded into all
its pairs.

Sets are the nodes: documents with equal sets share a node and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import components, discard, sized, written
from tallyframe.llm.grams import Fragments, WordHashes, shingles
from tallyframe.session import materialize

#: Fragments of the global order in which overlaps are counted, as a power of two.
FRAGMENT_BITS = 3
#: Nodes whose signatures one task remembers having published.
SEEN = 200_000


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _key(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(grams.tobytes()) if len(grams) else None


def _sign(width: int, percent: int):
    """(id, text) -> (id, n, node, sigs): ``sigs`` is empty where this task has published the
    node's signatures before, so many copies send few of them. Rows without an id publish none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cuts, seen = WordHashes(), Fragments(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, nodes, sigs, fresh = [], [], [], []
                for i, text in zip(part.column(0), part.column(1)):
                    g = shingles(text.as_py(), width, words)
                    key = _key(g)
                    new = key is not None and i.is_valid and key not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                    sizes.append(len(g))
                    nodes.append(key)
                    fresh.append(new)
                    sigs.append(cuts.signatures(g) if new else np.empty(0, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), _lists(sigs)],
                    ["id", "n", "node", "sigs"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sig, short) sorted by both: every ``short`` whose sig another one has too.
    Streams; it remembers the last row only."""
    last_sig = last_short = None
    told = False
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch.column(0).to_numpy(zero_copy_only=False)
        short = batch.column(1).to_numpy(zero_copy_only=False)
        same = np.zeros(len(sig), bool)         # same sig as the row before, another set
        same[1:] = (sig[1:] == sig[:-1]) & (short[1:] != short[:-1])
        out = []
        if last_sig is not None and sig[0] == last_sig and short[0] != last_short:
            same[0] = True
            if not told:
                out.append(np.array([last_short], np.int64))
        hit = same.copy()
        hit[:-1] |= same[1:]
        out.append(np.unique(short[hit]))
        last_sig, last_short, told = sig[-1], short[-1], bool(hit[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["short"])


def _gram_rows(width: int):
    """(id, text) -> (node, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t.as_py(), width, words) for t in batch.column(1).slice(at, 500)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_key(g) for g in sets], pa.binary()), _lists(sets)], ["node", "grams"])

    return run


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: overlaps are counted per fragment of the global
    order and summed per pair."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = (pairs.join(left, "a").join(right, ["b", "fragment"])
               .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("c")))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return total.where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def _possible(percent: int) -> F.Column:
    """Size and position bounds of a pair of postings (na, pa, nb, pb)."""
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - F.lit(1e-6))
    return ((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            & (1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= need))


def _pair(x: str, y: str) -> list[F.Column]:
    first = F.col(f"{x}node") < F.col(f"{y}node")
    return [F.when(first, F.col(f"{p}{c}")).otherwise(F.col(f"{q}{c}")).alias(name)
            for c, p, q, name in (("node", x, y, "a"), ("node", y, x, "b"), ("n", x, y, "na"), ("n", y, x, "nb"))]


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
          percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """``(members, found)``: members (id, n, node) has a row per row of ``docs``; found (a, b)
    has links between nodes that connect exactly the nodes linked by Jaccard similarity.

    Null or wordless texts have n = 0 and no node; rows without an id keep n and node but
    take no part in links. Repeated rows share a node. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = written(rows.mapInArrow(_sign(width, percent), f"id {id_type}, n long, node binary, sigs array<long>"),
                     "jaccard-sets")
    members = written(signed.select("id", "n", "node"), "jaccard-members")

    short = F.xxhash64("node").alias("short")
    sigs = signed.select(F.explode("sigs").alias("sig"), short)
    candidates = written(sigs.repartition("sig").sortWithinPartitions("sig", "short")
                         .mapInArrow(_repeated, "short long").distinct(), "jaccard-candidates")
    discard(signed)         # by far the largest table here
    # From here on a node goes by a number: it is written once, so it stays the same.
    chosen = (members.where("id is not null and node is not null").withColumn("short", F.xxhash64("node"))
              .join(sized(candidates), "short", "left_semi")
              .groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n")))
    chosen = written(chosen.withColumn("number", F.monotonically_increasing_id()), "jaccard-chosen")
    texts = rows.join(sized(chosen.select("id").distinct()), "id", "left_semi")
    sets = (texts.mapInArrow(_gram_rows(width), "key binary, grams array<long>")
            .join(sized(chosen.select(F.col("node").alias("key"), F.col("number").alias("node"), "n")), "key")
            .drop("key"))
    rows_of = members.join(sized(chosen.select("id", "node")), ["id", "node"], "left_semi")
    if not rows_of.groupBy("id", "node").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])        # rows repeated under one id
    grams = written(sets.select("node", "n", F.explode("grams").alias("gram")), "jaccard-grams")

    df = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = written(grams.join(df, "gram"), "jaccard-shared")
    enough = shared.groupBy("node", "n").agg(F.count("*").alias("m")).where(
        100 * F.col("m") >= percent * F.col("n")).select("node", "m")
    order = Window.partitionBy("node").orderBy("df", "gram")
    # The more of its shingles others have, the closer a set is to the middle of its copies.
    centrality = F.sum("df").over(Window.partitionBy("node")) / F.col("n")
    kept = written(shared.join(enough, "node").select("node", "n", "gram", (
        F.col("n") - F.col("m") + F.row_number().over(order) - 1).alias("p"), centrality.alias("c")), "jaccard-kept")
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100 - F.lit(1e-6))
    postings = written(kept.where(F.col("p") <= prefix), "jaccard-postings")
    segments = written(kept.groupBy("node", F.shiftrightunsigned("gram", 64 - FRAGMENT_BITS).alias("fragment"))
                       .agg(F.collect_list("gram").alias("grams")), "jaccard-segments")

    def side(df: DataFrame, s: str, *more: F.Column) -> DataFrame:
        return df.select("gram", *more, *(F.col(c).alias(f"{s}{c}") for c in ("node", "n", "p")))

    ends = _possible(percent)
    bounds = [F.col("xp").alias("pa"), F.col("yp").alias("pb"), F.col("xn").alias("na"), F.col("yn").alias("nb")]

    def fit(pairs: DataFrame) -> DataFrame:
        ok = pairs.select("*", *bounds).where(ends).drop("pa", "pb", "na", "nb")
        return ok.select(*_pair("x", "y")).distinct()

    centre = postings.groupBy("gram").agg(F.max(F.struct("c", "node", "n", "p")).alias("x")).select(
        "gram", F.col("x.node").alias("xnode"), F.col("x.n").alias("xn"), F.col("x.p").alias("xp"))
    stars = materialize(fit(side(postings, "y").join(centre, "gram").where("xnode != ynode")))
    found = materialize(_overlaps(stars, segments, percent))

    root = components(found)
    placed = written(postings.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")),
                     "jaccard-placed")
    several = placed.groupBy("gram").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("gram")
    # One row for each component, size and gram, with its best place, decides what can link.
    best = written(placed.join(several, "gram").groupBy("gram", "root", "n").agg(F.min("p").alias("p")), "jaccard-best")
    # Of two sets the smaller has a common shingle within this shorter prefix.
    early = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent) - F.lit(1e-6))
    x, y = (b.select("gram", F.col("root").alias(f"{s}root"), F.col("n").alias(n), F.col("p").alias(p))
            for b, s, n, p in ((best.where(F.col("p") <= early), "x", "na", "pa"), (best, "y", "nb", "pb")))
    across = x.join(y, (x["gram"] == y["gram"]) & (F.col("xroot") != F.col("yroot"))
                    & (F.col("na") <= F.col("nb")) & ends).select(
        x["gram"], "xroot", "yroot", F.col("na").alias("xn"), "nb", "pb")
    # Each member must pass against the best place of the other side before that is expanded.
    members_x = (across.join(side(placed, "x", F.col("root").alias("xroot")), ["gram", "xroot", "xn"])
                 .select("*", F.col("xn").alias("na"), F.col("xp").alias("pa")).where(ends)
                 .select("gram", "xnode", "xn", "xp", "yroot", F.col("nb").alias("yn")))
    rest = fit(members_x.join(side(placed, "y", F.col("root").alias("yroot")), ["gram", "yroot", "yn"]))
    rest = rest.join(stars.select("a", "b"), ["a", "b"], "left_anti")
    more = _overlaps(rest, segments, percent)
    names = chosen.select(F.col("number"), F.col("node"))
    both = found.unionByName(more)
    for end in ("a", "b"):
        both = both.join(names.withColumnRenamed("node", f"{end}_node"), F.col(end) == F.col("number")).drop("number", end)
    return members, materialize(both.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                          percent: int = 80) -> DataFrame:
    """(id, n, group): one row per row of ``docs``; group is the smallest id reachable by
    links (itself included). A row without words is its own group; one without an id has
    group null. An empty table gives an empty result."""
    members, found = links(docs, id_col, text_col, width, percent)
    named = members.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("first"))
    root = components(found)
    named = written(named.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-nodes")
    # Only components of several nodes need a minimum over nodes.
    joined = named.join(root.select(F.col("root")).distinct(), "root", "left_semi")
    lowest = joined.groupBy("root").agg(F.min("first").alias("lowest"))
    group = named.join(lowest, "root", "left").select(
        F.col("node"), F.coalesce("lowest", "first").alias("group"))
    out = members.join(group, "node", "left")
    return out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("group", "id")).alias("group"))
