"""Operator 12: fill-in-middle, with cut places from a compressed set of unit boundaries.

The boundaries of a text's units (the offset 0 and the end of each unit, in code points) are kept
as a Roaring-style set: offsets are divided by their high 16 bits, and each chunk is the
smallest of three containers: a sorted *array* of 16-bit numbers, a *bitmap* of 65,536
bits, or *runs* (start, length) of neighbouring numbers. Cumulative cardinalities stand beside
the containers, so the offset of rank ``k`` is found by a binary search among them, then by a select
inside one container: an index, a search over the popcounts of a bitmap's words, or a search over
the runs' cumulative lengths. Both cuts of a text come from two such selects.

The cuts are made in Arrow batches; the forms are put together and taken apart again by Spark
expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
BITMAP_BYTES = CHUNK // 8
#: The marks ahead of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"


@dataclass
class Container:
    """16-bit numbers, as an array, the words of a bitmap, or starts and sizes of runs."""

    kind: str
    numbers: np.ndarray
    ranks: np.ndarray | None = None     # numbers in all bitmap words or runs before, and in all

    @classmethod
    def of(cls, low: np.ndarray) -> Container:
        starts = np.flatnonzero(np.diff(low.astype(np.int32), prepend=-2) != 1)
        if 2 + 4 * len(starts) < min(2 * len(low), BITMAP_BYTES):
            sizes = np.diff(np.append(starts, len(low)))
            return cls("run", low[starts], np.append(0, np.cumsum(sizes)))
        if 2 * len(low) <= BITMAP_BYTES:
            return cls("array", low)
        bits = np.zeros(CHUNK, bool)
        bits[low] = True
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        return cls("bitmap", words, np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def select(self, k: int) -> int:
        if self.kind == "array":
            return int(self.numbers[k])
        at = int(np.searchsorted(self.ranks, k, side="right")) - 1
        k -= int(self.ranks[at])
        if self.kind == "run":
            return int(self.numbers[at]) + k
        word = int(self.numbers[at])
        for _ in range(k):
            word &= word - 1                            # drops the lowest bit
        return 64 * at + (word & -word).bit_length() - 1


class Boundaries:
    """A compressed set of sorted offsets with ``len`` and ``select``."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.chunks = high[first]
        self.containers = [Container.of(low.astype(np.uint16)) for low in np.split(offsets & (CHUNK - 1), first[1:])]
        self.ranks = np.append(first, len(offsets))

    def __len__(self) -> int:
        return int(self.ranks[-1])

    def select(self, k: int) -> int:
        """The offset that ``k`` smaller ones precede."""
        at = int(np.searchsorted(self.ranks, k, side="right")) - 1
        return (int(self.chunks[at]) << 16) + self.containers[at].select(k - int(self.ranks[at]))


def boundaries(text: str, unit: str = "word") -> Boundaries:
    """Boundaries of the units of ``text``: of a word with the white space ahead of it (the rest is
    white space only), of a line with its break, or of a code point."""
    if unit == "char":
        return Boundaries(np.arange(len(text) + 1))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if unit == "line":
        ends = np.flatnonzero(code == 10) + 1
    elif unit == "word":
        white = (code == 32) | ((code >= 9) & (code <= 13))
        ends = np.flatnonzero(~white & np.append(white[1:], True)) + 1
    else:
        raise ValueError(f"unit {unit!r} is none of word, line, char")
    if len(code) and not (len(ends) and ends[-1] == len(code)):
        ends = np.append(ends, len(code))
    return Boundaries(np.append(0, ends))


def _task(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            rows = []
            for text, one, other in zip(*(columns[c].to_pylist() for c in ("text", "one", "other"))):
                places = boundaries(text, unit)
                n = len(places)
                a, b = sorted((one % n, other % n))
                rows.append((n - 1, places.select(a), places.select(b)))
            new = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [columns["id"], columns["text"], columns["form"], *new], ["id", "text", "form", "n", "start", "end"])

    return run


def _draw(seed: int, key: Column, k: int) -> Column:
    """The ``k``-th number of 32 bits that ``seed`` and an id give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of."""
    part = lambda k: F.get(F.split(output, MARK, -1), F.lit(k))
    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
            .when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50,
                   spm: int = 80, unit: str = "word") -> DataFrame:
    """(id, n, form, start, end, output) per row of ``docs``: ``n`` units, the offsets (code points)
    of the middle, and the text as prefix, suffix and middle behind their marks.

    ``rate`` percent of the texts, by a hash of seed and id, change; of these ``spm`` percent have the
    suffix first (form spm), the others the prefix (psm). Empty texts and those that hold a mark
    themselves stay ``plain``, with null offsets. Null texts are empty; a null id draws like an empty
    one. Rows of one id draw alike; other columns are not read; an empty table gives no rows. The whole
    text is cut, whatever its length; nothing is shuffled."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    key = F.col("id")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    d = d.withColumn("form", F.when((F.col("text") == "") | marked | (_draw(seed, key, 2) % 100 >= rate), "plain")
                     .when(_draw(seed, key, 3) % 100 < spm, "spm").otherwise("psm"))
    d = d.withColumn("one", _draw(seed, key, 0)).withColumn("other", _draw(seed, key, 1))
    kind = d.schema["id"].dataType.simpleString()
    d = d.mapInArrow(_task(unit), f"id {kind}, text string, form string, n bigint, start bigint, end bigint")
    cut = F.col("form") != "plain"
    prefix, middle, suffix = (F.expr(f"substring(text, {a}, {n})") for a, n in (
        ("1", "int(start)"), ("int(start) + 1", "int(end - start)"), ("int(end) + 1", "length(text)")))
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(cut, F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.col("text")))
    return d.select("id", "n", "form", F.when(cut, F.col("start")).alias("start"), F.when(cut, F.col("end")).alias("end"),
                    output.alias("output"))
