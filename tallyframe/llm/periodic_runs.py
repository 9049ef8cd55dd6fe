"""Operator 11: runs of repeated words, found with a run-length grammar.

A *run* is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) of
``max(6, 4 q)`` words or more that no neighbouring word extends. Documents go through in groups of
``GROUP_WORDS`` words; each group is recompressed into one grammar (``recompression``).

Candidates lie on a *harmonic grid*: for each period, the places ``0, q, 2q, ...`` of every text,
``n/1 + n/2 + ... = O(n log n)`` in all. A run covers four neighbouring grid places at least,
which hold the same word, and so three equal neighbours in a row; of these, the pair whose
number is divisible by three is asked. LCE queries of the grammar in both directions give the
exact ends of the stretch of period ``q`` around the pair. A stretch found with several periods has
the smallest one; by the periodicity lemma the others are its multiples, with the same ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.recompression import extend, grammar

LEAST_WORDS = 6
LEAST_EXPONENT = 4
GROUP_WORDS = 1 << 19
#: Candidate pairs asked at once.
ASKED = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _candidates(s: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place one period on, sequence) of grid pairs to ask, in blocks. The sequences
    are sorted by length, longest first."""
    sizes = np.diff(offsets)
    held, count = [], 0
    for q in range(1, int(sizes.max(initial=0)) // LEAST_EXPONENT + 1):
        docs = int(np.searchsorted(-sizes, -max(LEAST_WORDS, LEAST_EXPONENT * q), side="right"))
        if not docs:
            break
        pairs = (sizes[:docs] - 1) // q
        ends = np.cumsum(pairs)
        doc = np.repeat(np.arange(docs), pairs)
        number = np.arange(ends[-1]) - (ends - pairs)[doc]
        place = offsets[doc] + number * q
        equal = s[place] == s[place + q]
        hit = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:])
        if len(hit):
            ask = np.unique(hit + (-number[hit]) % 3)
            ask = ask[ask < len(place)]
            held.append((place[ask], place[ask] + q, doc[ask]))
            count += len(ask)
            if count >= ASKED:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def runs_of(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers the rows (start, length, period) of its runs, by start,
    then period."""
    order = sorted((k for k, x in enumerate(sequences) if len(x)), key=lambda k: -len(sequences[k]))
    out = [np.empty((0, 3), np.int64)] * len(sequences)
    if not order:
        return out
    s = np.concatenate([sequences[k] for k in order])
    offsets = np.concatenate([[0], np.cumsum([len(sequences[k]) for k in order])])
    levels, found = None, []
    for p, r, doc in _candidates(s, offsets):
        levels = levels or grammar(s, offsets)
        start = extend(levels, p, r, doc, forward=False) - (r - p)
        end = extend(levels, p, r, doc, forward=True)
        keep = end - start >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * (r - p))
        found.append(np.unique(np.stack([doc, start - offsets[doc], end - start, r - p], 1)[keep], axis=0))
    if not found:
        return out
    rows = np.unique(np.concatenate(found), axis=0)     # sorted: of one stretch the smallest period is first
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(order) + 1))
    for d, k in enumerate(order):
        out[k] = rows[cuts[d]:cuts[d + 1], 1:]
    return out


class _Numbers(dict):
    """Word -> its number within a group."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _group(ids: list, texts: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
    numbers = _Numbers()
    found = runs_of([np.fromiter(map(numbers.__getitem__, t), np.int32, len(t)) for t in texts])
    collapsed = []
    for words, runs in zip(texts, found):
        if len(runs):
            keep = np.ones(len(words), bool)
            for start, length, period in runs:
                keep[start + period:start + length] = False
            words = [words[i] for i in np.flatnonzero(keep)]
        collapsed.append(b" ".join(words))
    rows = [[{"start": int(a), "length": int(b), "period": int(c)} for a, b, c in r] for r in found]
    columns = [ids, [len(t) for t in texts], rows]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    ids, texts, held, schema = [], [], 0, None
    for batch in batches:
        schema = schema or pa.schema([("id", batch.schema.field(0).type), ("n_words", pa.int64()),
                                      ("runs", pa.list_(run)), ("collapsed", pa.string())])
        for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            words = (text.as_py() or b"").split()
            ids.append(key.as_py())
            texts.append(words)
            held += len(words) + 1
            if held >= GROUP_WORDS:
                yield _group(ids, texts, schema)
                ids, texts, held = [], [], 0
    if ids:
        yield _group(ids, texts, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) per row of ``docs``: its runs by start, then period, and the
    words that no run contains after its first period, joined by one space.

    Words are maximal runs of characters other than ASCII white space. Null and empty texts have
    no words, no runs and an empty ``collapsed``. Null ids stay null; repeated rows each give a row;
    other columns are not read. An empty table gives no rows. No shuffle: memory is a group of
    ``GROUP_WORDS`` words, or one longer text, and some 20 numbers per word of it."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_task, f"id {d.schema['id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) in which one text in ten ends in a repetition, chosen by the CRC of its id: from word
    ``a`` on, words repeat with period ``p``. All others, and texts without an id, stay."""
    words = F.filter(F.split(F.col("text"), "[ \\t-\\r]+"), lambda w: w != "")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                    F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"))
    g = F.floor(F.col("h") / 10)
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    d = d.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    d = d.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    new = F.expr("transform(words, (w, i) -> if(i < a, w, get(words, cast(a + (i - a) % p as int))))")
    return d.select("id", F.when(F.col("a").isNotNull(), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))
