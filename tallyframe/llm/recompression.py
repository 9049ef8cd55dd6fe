"""Recompression of many word sequences into one run-length grammar, and its LCE queries.

The sequences of a batch stand behind one another as numbers; no rule crosses from one to
the next. *Block compression* names every maximal block ``x^k`` (k > 1), *pair compression*
splits the symbols into left and right ones and names every pair of a left symbol followed by a right one.
Both alternate until each sequence is one symbol. Names are given by content (two symbols
are equal exactly if their words are), so equal stretches are parsed alike but for their ends.

``extend`` answers many longest-common-extension queries at once. A query climbs while both
its places are boundaries of the next level; where only one is, at most one symbol or block is
compared, after which both are or the mismatch lies there. It then descends to the word
where the two differ. That is a constant number of array steps per level and direction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tallyframe.llm.grams import mixed


@dataclass
class Level:
    """One level: its symbols, the word at which each starts, the offsets of the sequences;
    and how it is joined into the next level (``kind`` None at the top)."""

    symbols: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    kind: str | None = None
    new: np.ndarray | None = None      # is this boundary also one of the next level?
    up: np.ndarray | None = None       # symbol of the next level that holds this one
    first: np.ndarray | None = None    # first symbol of each symbol of the next level, and the end


def _names(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Numbers from ``base`` on, equal exactly for equal (a, b)."""
    if not len(a):
        return np.empty(0, np.int64)
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1] + base


def _joined(level: Level, kind: str, new: np.ndarray, symbols: np.ndarray) -> Level:
    """Closes ``level`` and gives the next one, whose symbols start where ``new`` is true."""
    n = len(level.symbols)
    level.kind, level.new = kind, np.append(new, True)
    level.up = (np.cumsum(level.new) - 1).astype(np.int32)
    level.first = np.flatnonzero(level.new).astype(np.int32)
    return Level(symbols.astype(np.int32), level.words[level.first], level.up[level.offsets] if n else level.offsets)


def grammar(symbols: np.ndarray, offsets: np.ndarray) -> list[Level]:
    """Levels of the grammar of the non-empty sequences ``symbols[offsets[d]:offsets[d + 1]]``."""
    levels = [Level(symbols.astype(np.int32), np.arange(len(symbols) + 1, dtype=np.int32), offsets)]
    names, rounds = int(symbols.max(initial=-1)) + 1, 0
    while len(levels[-1].symbols) > len(offsets) - 1:
        level = levels[-1]
        s, starts = level.symbols, level.offsets[:-1]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new[starts] = True
        if not new.all():
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(s)))
            out, many = s[first].astype(np.int64), size > 1
            out[many] = _names(out[many], size[many], names)
            names = max(names, int(out.max()) + 1)
            levels.append(_joined(level, "block", new, out))
            continue
        # No two neighbours are equal. A random half of the symbols is left, the better way round.
        left = (mixed(s.astype(np.uint64) + np.uint64(rounds << 40)) & np.uint64(1)).astype(bool)
        rounds += 1
        inside = np.ones(len(s), bool)
        inside[starts] = False
        here, back = left[:-1] & ~left[1:] & inside[1:], ~left[:-1] & left[1:] & inside[1:]
        at = np.flatnonzero(back if back.sum() > here.sum() else here)
        if not len(at):
            continue
        new = np.ones(len(s), bool)
        new[at + 1] = False
        out = s.astype(np.int64)
        out[at] = _names(s[at], s[at + 1], names)
        names = max(names, int(out.max()) + 1)
        levels.append(_joined(level, "pair", new, out[new]))
    return levels


def extend(levels: list[Level], p: np.ndarray, r: np.ndarray, doc: np.ndarray, forward: bool) -> np.ndarray:
    """Number of equal words behind (``forward``) or ahead of the boundaries ``p < r`` of sequence ``doc``."""
    step, side = (1, 0) if forward else (-1, -1)        # the symbol next to boundary b is b + side
    met = np.zeros(len(p), np.int64)
    pending: list[list[tuple]] = [[] for _ in levels]

    def ended(level, p, r, d):
        return r == level.offsets[d + 1] if forward else p == level.offsets[d]

    def advance(level, p, r):
        """The boundaries behind the shorter of two blocks of one symbol, or behind one symbol."""
        if level.kind == "pair":
            return p + step, r + step, None
        a, b = (np.abs(level.first[level.up[x + side] + (1 if forward else 0)] - x) for x in (p, r))
        m = np.minimum(a, b) * step
        return p + m, r + m, a != b

    def finish(level, ask, p, r, d):
        """Takes out the queries that reached an end of their sequence."""
        over = ended(level, p, r, d)
        met[ask[over]] = level.words[r[over]]
        return ask[~over], p[~over], r[~over], d[~over]

    ask, d = np.arange(len(p)), doc
    for n, level in enumerate(levels):
        ask, p, r, d = finish(level, ask, p, r, d)
        if not len(ask):
            break
        odd = ~(level.new[p] & level.new[r])
        i = np.flatnonzero(odd)
        same = level.symbols[p[i] + side] == level.symbols[r[i] + side]
        stop = np.zeros(len(ask), bool)
        stop[i[~same]] = True
        i = i[same]
        p, r = p.copy(), r.copy()
        p[i], r[i], differ = advance(level, p[i], r[i])
        if differ is not None:
            stop[i[differ]] = True
        if stop.any():
            pending[n].append(finish(level, ask[stop], p[stop], r[stop], d[stop]))
        ask, p, r, d = ask[~stop], level.up[p[~stop]], level.up[r[~stop]], d[~stop]
    none = np.empty(0, np.int64)
    held = (none, none, none, none)
    for n in range(len(levels) - 1, -1, -1):
        ask, p, r, d = (np.concatenate(x) for x in zip(held, *pending[n]))
        if n == 0:
            met[ask] = r
        elif len(ask):                                  # the symbols differ: so do some of their parts
            below = levels[n - 1]
            p, r = below.first[p], below.first[r]
            i = np.flatnonzero(below.symbols[p + side] == below.symbols[r + side])
            p[i], r[i], _ = advance(below, p[i], r[i])
            ask, p, r, d = finish(below, ask, p, r, d)
        held = (ask, p, r, d)
    return met
