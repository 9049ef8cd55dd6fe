"""Operator 6: token ids, packed best-fit-decreasing into fixed-length rows.

Documents are tokenized with a public byte-level BPE vocabulary (the path is a parameter),
closed by an end token and cut into pieces of at most ``length`` tokens, so that nothing is
lost. Pieces are packed group by group (``GROUP_TOKENS`` tokens of one task, so memory is
bounded and no shuffle is needed): longest first, each into the row with the least room
that still holds it. A segment tree over the capacities 0 to ``length`` finds that row.

Every packed row carries the id matrix row, padded with the end token, cumulative segment
lengths, the offsets at which positions restart at 0, and which piece of which document
each segment is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORDS = regex.compile(PATTERN)
LENGTH = 2048
GROUP_TOKENS = 1 << 21
#: Characters tokenized at once; longer texts are cut where a word ends.
CHUNK = 1 << 16

SCHEMA = ("shard int, pack_group int, row int, n_tokens int, ids binary, cu_seqlens array<int>, "
          "position_resets array<int>, doc_ids array<long>, parts array<int>, part_counts array<int>")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cuts where the pattern itself ends a word, behind a letter or digit, or behind other visible ASCII
    ahead of white space, so that the pieces have the ids of the whole text. (Behind white space the pattern
    looks on to what follows.) Only within one word longer than ``size`` characters a cut is forced."""
    at = 0
    while len(text) - at > size:
        cut = None
        for m in _WORDS.finditer(text, at):
            end = m.end()
            if end - at > size:
                break
            last = text[end - 1]
            if last.isalpha() or last.isdecimal() or ("!" <= last <= "~" and text[end:end + 1] in (" ", "\n", "\t", "\r")):
                cut = end
        cut = cut or at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


class CapacityTree:
    """Segment tree over capacities: how many open rows have exactly that much room."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.size + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) with the least room of at least ``need``."""
        count, i = self.count, self.size + need
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):    # up until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:                            # down to its leftmost row
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is in exactly one row of at most ``length``."""
    tree, rows = CapacityTree(length), []
    for piece in sorted(range(len(sizes)), key=lambda p: -sizes[p]):
        found = tree.take(sizes[piece])
        room, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(piece)
        tree.add(room - sizes[piece], row)
    return rows


def _pack(group: list[tuple[int | None, np.ndarray]], length: int, end: int, shard: int, number: int) -> pa.RecordBatch:
    pieces = []
    for doc, ids in group:
        n = -(-len(ids) // length)
        pieces += [(doc, k, n, ids[k * length:(k + 1) * length]) for k in range(n)]
    out = {name: [] for name in ("n", "ids", "cu", "resets", "docs", "parts", "counts")}
    for row in best_fit_decreasing([len(p[3]) for p in pieces], length):
        here = [pieces[p] for p in row]
        ends = np.cumsum([0] + [len(p[3]) for p in here]).astype(np.int32)
        matrix = np.full(length, end, here[0][3].dtype)
        matrix[:ends[-1]] = np.concatenate([p[3] for p in here])
        out["n"].append(int(ends[-1]))
        out["ids"].append(matrix.tobytes())
        out["cu"].append(ends)
        out["resets"].append(ends[:-1])
        for name, k in (("docs", 0), ("parts", 1), ("counts", 2)):
            out[name].append([p[k] for p in here])
    rows = len(out["n"])
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * rows, pa.int32()), pa.array([number] * rows, pa.int32()),
         pa.array(range(rows), pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["ids"], pa.binary()),
         pa.array(out["cu"], ints), pa.array(out["resets"], ints), pa.array(out["docs"], pa.list_(pa.int64())),
         pa.array(out["parts"], ints), pa.array(out["counts"], ints)],
        [c.split()[0] for c in SCHEMA.split(", ")])


def _task(vocabulary: str, length: int, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = enc.n_vocab
        kind = np.uint16 if end < 1 << 16 else np.uint32
        shard, number, group, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = [t for part in chunks(text.as_py() or "") for t in enc.encode_ordinary(part)]
                ids.append(end)
                group.append((doc.as_py(), np.array(ids, kind)))
                held += len(ids)
                if held >= group_tokens:
                    yield _pack(group, length, end, shard, number)
                    number, group, held = number + 1, [], 0
        if group:
            yield _pack(group, length, end, shard, number)

    return run


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows (``SCHEMA``): ``ids`` is one row of the id matrix, ``length`` little-endian
    numbers of 2 bytes (4 for vocabularies of 65,536 ids and more).

    Every row of ``docs`` becomes one document, repeated rows too. Null and empty texts are
    a single end token. Null ids stay null. An empty table gives no rows."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _task(vocabulary, length, group_tokens), SCHEMA)


def unpack(rows: list, vocabulary: str = VOCABULARY) -> list[tuple[int | None, str]]:
    """(id, text) of the documents in packed rows of one or more groups, joined from their
    pieces; the exact inverse of ``pack_tokens`` (pieces of a document lie in one group)."""
    enc, parts = encoder(vocabulary), {}
    kind, nth = (np.uint16 if enc.n_vocab < 1 << 16 else np.uint32), {}
    done = []
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), kind)
        for k, (doc, part, count) in enumerate(zip(r["doc_ids"], r["parts"], r["part_counts"])):
            seg = ids[r["cu_seqlens"][k]:r["cu_seqlens"][k + 1]].tolist()
            if count == 1:
                done.append((doc, seg))
                continue
            at = (r["shard"], r["pack_group"], doc, count)
            copy = nth[(*at, part)] = nth.get((*at, part), -1) + 1
            parts.setdefault((*at, copy), {})[part] = seg
    done += [(key[2], [t for p in sorted(got) for t in got[p]]) for key, got in parts.items()]
    return [(doc, enc.decode(seg[:-1])) for doc, seg in done]
