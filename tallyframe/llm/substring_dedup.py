"""Operator 13: repeated substrings of words, by seed and extend.

*Seeds.* Of the ``w`` neighbouring groups of ``k`` words in every window of ``min_words = w + k - 1``
words, the one with the smallest hash (the last, if several) is the window's *anchor*. Equal windows
choose equal anchors at equal places, so each repeat of ``min_words`` words has a seed, and only some
two of ``w`` groups are anchors. The documents are joined on them: anchors that occur once are done.

*Extension.* An occurrence of a seed is extended both ways, by the ``i`` words before and the
``min_words - k - i`` words behind it, for every ``i`` whose window chose this anchor. An extension
matches if another occurrence of the seed has the same one. All partners are thus met at once: a
group counts its extensions, instead of listing its pairs. Occurrences with equal surroundings
(copies) count as one context with a number; a seed with one context needs no extension at
all, and for the others one occurrence of each context is extended.

*Maximal repeats.* Matched windows that overlap or touch are one stretch; every word of it has a copy
within ``min_words`` matched words, and no window that sticks out of it has one.

What is joined grows with the corpus, so the joins are merge joins at every size; only the keys
that ``join_split`` takes apart are broadcast.

A window is known by the 64-bit hash of its anchor and another of all its words, taken with
different multipliers: 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, join_split, written
from tallyframe.llm.grams import WordHashes, mixed

MIN_WORDS = 35
SPANS = "array<struct<start:bigint,end:bigint>>"
ALL = -1


class Rolling:
    """Hashes of all groups of ``size`` neighbouring words."""

    def __init__(self, size: int, base: int):
        self.size, self.base = size, np.uint64(base)
        self.inverse = np.uint64(pow(base, -1, 1 << 64))
        self.ups = self.downs = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.ups) < n:
            n = max(n, 2 * len(self.ups))
            for name, base in (("ups", self.base), ("downs", self.inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n = len(words) - self.size + 1
        self._powers(len(words))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.ups[:len(words)], dtype=np.uint64, out=sums[1:])
        return mixed((sums[self.size:] - sums[:n]) * self.downs[:n])


def _last_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its smallest one, the last of equals."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        by = min(reach, width - reach)
        later = values[by:] <= values[:-by]
        at = np.where(later, at[by:], at[:-by])
        values, reach = np.minimum(values[by:], values[:-by]), reach + by
    return at


class Seeds:
    """Windows and anchors of a text."""

    def __init__(self, min_words: int):
        self.min_words = min_words
        self.k = max(min(12, min_words), min_words - 31)
        self.w = min_words - self.k + 1
        self.words = WordHashes()
        self.groups = Rolling(self.k, 0x9E3779B97F4A7C15)
        self.windows = Rolling(min_words, 0xD6E8FEB86659FD93)

    def of(self, text: bytes | None):
        """(anchor hash, first window, number of windows, place of the anchor in the first window,
        window hashes, context hash) by anchor; None without a window."""
        tokens = (text or b"").split()
        if len(tokens) < self.min_words:
            return None
        a = np.fromiter(map(self.words.__getitem__, tokens), np.uint64, len(tokens))
        grams, windows = self.groups(a), self.windows(a)
        anchor = _last_minimum(grams, self.w)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        size = np.diff(np.append(first, len(anchor)))
        place = anchor - np.arange(len(anchor))
        context = np.add.reduceat(mixed(windows ^ mixed(place.astype(np.uint64) + np.uint64(1 << 40))), first)
        return grams[anchor[first]].view(np.int64), first, size, place[first], windows.view(np.int64), context.view(np.int64)


_KEY = "k1 bigint, k2 bigint"
_ANCHOR = "seed bigint, context bigint"


def _anchors(min_words: int):
    schema = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "seed", "context")]
                       + [(c, pa.int32()) for c in ("start", "size")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(min_words)
        for batch in batches:
            for k1, k2, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
                got = seeds.of(text.as_py())
                if got is not None:
                    n = len(got[0])
                    keys = [np.full(n, k.as_py(), np.int64) for k in (k1, k2)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, got[0], got[5])]
                                                     + [pa.array(x, pa.int32()) for x in got[1:3]], schema=schema)

    return run


def _extensions(min_words: int):
    """Extensions of the asked anchors (first window, 1 or 2 for one or more occurrences) of each text."""
    schema = pa.schema([("seed", pa.int64()), ("context", pa.int64()), ("many", pa.int32()), ("j", pa.int32()),
                        ("place", pa.int32()), ("extension", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(min_words)
        for batch in batches:
            for text, asked in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
                anchor, first, size, place, windows, context = seeds.of(text.as_py())
                starts, many = np.array([(x["start"], x["many"]) for x in asked.as_py()], np.int64).T
                at = np.searchsorted(first, starts)
                of = np.repeat(at, size[at])
                j = np.arange(len(of)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[of]), pa.array(context[of]), pa.array(
                    np.repeat(many, size[at]), pa.int32()), pa.array(j, pa.int32()), pa.array(
                    place[of] - j, pa.int32()), pa.array(windows[first[of] + j])], schema=schema)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): two hashes name a row by id and text, so equal rows are named alike."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    return d.withColumn("k1", F.xxhash64(key, "text")).withColumn("k2", F.xxhash64("text", key))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, start, mask): of the windows of ``min_words`` words from ``start`` on that share an anchor,
    bit ``j`` of ``mask`` says that the one from ``start + j`` on also starts elsewhere."""
    keyed = _keyed(docs, id_col, text_col)
    anchors = written(keyed.select("k1", "k2", "text").mapInArrow(
        _anchors(min_words), f"{_KEY}, {_ANCHOR}, start int, size int"), "substring-anchors")
    seeds = written(anchors.groupBy("seed").agg(F.count("*").alias("n"), F.min("context").alias("context"), F.max(
        "context").alias("other")).where("n > 1"), "substring-seeds")
    same = seeds.where("context = other").select("seed", "context", "n", F.lit(ALL).cast("bigint").alias("mask"))

    # One occurrence, and the number of all, of each context of the other seeds.
    mixed_seeds = seeds.where("context != other").select("seed", "n")
    contexts = join_split(anchors.drop("size"), mixed_seeds, ["seed"], "n").groupBy("seed", "context").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "start")))
    contexts = written(contexts, "substring-contexts")
    asked = contexts.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", F.when(
        F.col("n") > 1, 2).otherwise(1).alias("many")))).alias("asked"))
    texts = keyed.select("k1", "k2", "text").join(asked.hint("merge"), ["k1", "k2"])
    extended = written(texts.select("text", "asked").mapInArrow(
        _extensions(min_words), f"{_ANCHOR}, many int, j int, place int, extension bigint"), "substring-extensions")
    alike = ["seed", "place", "extension"]
    matched = written(extended.groupBy(alike).agg(F.sum("many").alias("total"), F.count("*").alias("n")).where("total > 1")
                      .select(*alike, "n"), "substring-matched")
    found = join_split(extended, matched, alike, "n").groupBy("seed", "context").agg(
        F.expr("bit_or(shiftleft(1L, j))").alias("mask"))
    some = found.join(contexts.select("seed", "context", "n").hint("merge"), ["seed", "context"]).select("seed", "context", "n", "mask")
    verdicts = written(same.unionByName(some), "substring-verdicts")
    mask = F.expr(f"if(mask = {ALL}, shiftleft(1L, size) - 1, mask)")
    out = written(join_split(anchors, verdicts, ["seed", "context"], "n").groupBy("k1", "k2", "start").agg(
        F.bit_or(mask).alias("mask")), "substring-windows")
    for done in (anchors, extended):
        discard(done)
    return out


def _cleaned(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([
                ("id", batch.schema.field(0).type), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
            words, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                text = text.as_py()
                tokens, found, stretches = text.split(), found.as_py() or [], []
                if found:
                    first, mask = np.array([(x["start"], x["mask"]) for x in found], np.int64).T
                    at, j = np.nonzero(mask[:, None] >> np.arange(32) & 1)
                    starts = first[at] + j
                    edge = np.zeros(len(tokens) + 1, np.int64)
                    edge[starts] += 1                   # windows start at different words
                    edge[:] -= np.bincount(starts + min_words, minlength=len(edge))
                    gone = np.cumsum(edge) > 0
                    turns = np.flatnonzero(np.diff(gone, prepend=False)).reshape(-1, 2)
                    stretches = [{"start": int(a), "end": int(b)} for a, b in turns]
                    left = [tokens[i] for i in np.flatnonzero(~gone[:-1])]
                else:
                    left = tokens
                words.append(len(tokens))
                removed.append(len(tokens) - len(left))
                spans.append(stretches)
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip((words, removed, spans), list(schema)[1:])),
                 pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) per row of ``docs``: the stretches of words covered by windows of
    ``min_words`` words that also start anywhere else, in this text or another, and the words left, joined by
    one space. All copies are removed, the first one too.

    Words are maximal runs of characters other than ASCII white space, compared as they are. Null texts
    are empty; texts under ``min_words`` words lose nothing. Rows equal in id and text are copies of each
    other and get the same result, null ids included. Other columns are not read; an empty table gives no
    rows. ``min_words`` is at least 2; beyond 43, seeds are longer, so that at most 32 windows share one."""
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    windows = repeated_windows(docs, id_col, text_col, min_words)
    per_text = windows.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "mask")).alias("found"))
    keyed = _keyed(docs, id_col, text_col)
    d = keyed.join(per_text.hint("merge"), ["k1", "k2"], "left").select("id", "text", "found")
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_cleaned(min_words), f"id {kind}, n_words bigint, n_removed bigint, spans {SPANS}, kept string")
