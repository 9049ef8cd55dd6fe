"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.infill import Boundaries, Container, boundaries, fill_in_middle, restored
from tallyframe.llm.periodic_runs import periodic_runs, runs_of
from tallyframe.llm.queries import QUERIES
from tallyframe.llm.recompression import extend, grammar
from tallyframe.llm.substring_dedup import Seeds, _last_minimum, dedup_substrings
from tests.conftest import SF001


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(rows):
    return {r.doc_id: r.text for r in rows}


# ---- operator 11

def runs_brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed_brute(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=5), st.integers(1, 9)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=6))
def test_runs_of_repetitive_sequences(docs):
    seqs = [[x for part, k in d for x in part * k] for d in docs]
    got = runs_of([np.array(s, np.int32) for s in seqs])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [runs_brute(s) for s in seqs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=2, max_size=40), min_size=1, max_size=4), st.randoms())
def test_extensions_of_the_grammar(docs, rnd):
    offsets = np.cumsum([0] + [len(d) for d in docs])
    levels = grammar(np.array(sum(docs, []), np.int32), offsets)
    assert len(levels[-1].symbols) == len(docs)
    asks = [(d, *sorted(rnd.sample(range(len(docs[d]) + 1), 2))) for d in range(len(docs)) for _ in range(9)]
    doc, p, r = (np.array(x) for x in zip(*asks))
    ahead = extend(levels, p + offsets[doc], r + offsets[doc], doc, True) - r - offsets[doc]
    back = r + offsets[doc] - extend(levels, p + offsets[doc], r + offsets[doc], doc, False)
    for (d, a, b), x, y in zip(asks, ahead, back):
        s = docs[d]
        assert x == next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b)
        assert y == next((k for k in range(a) if s[a - 1 - k] != s[b - 1 - k]), a)


def test_runs_of_long_sequences():
    assert runs_of([np.zeros(30_000, np.int32)])[0].tolist() == [[0, 30_000, 1]]
    block = np.random.default_rng(1).integers(0, 50, 5_000).astype(np.int32)
    tail = np.array([77], np.int32)
    assert [0, 20_000, 5_000] in runs_of([np.concatenate([np.tile(block, 4), tail])])[0].tolist()


def test_periodic_runs_of_the_driver_table(spark):
    docs = documents(spark.read.parquet(f"{SF001}/documents.parquet").collect())
    got = QUERIES["op11_periodic_runs"](spark, SF001).collect()
    assert len(got) == len(docs)
    seen = 0
    for r in got:
        w = planted(r.doc_id, words_of(docs[r.doc_id]))
        runs = runs_brute(w)
        best = min(((-n, a, q) for a, n, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed_brute(w, runs))
        seen += bool(runs)
    assert seen > 5


def test_periodic_runs_of_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "a " * 6, "a b " * 8, "x " + "é 😀 " * 9 + "y", "a " * 6, "A a " * 7 + "z " * 2_000]
    df = spark.createDataFrame([(k if k != 3 else None, t, 1, "r") for k, t in enumerate(texts)],
                               "doc_id long, text string, n_words int, runs string")
    got = sorted((r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect())
    assert got == sorted((len(w), runs_brute(w), collapsed_brute(w, runs_brute(w))) for w in map(words_of, texts))
    assert periodic_runs(df.limit(0)).count() == 0
    from tallyframe.llm.periodic_runs import with_planted_periods
    ids = [None, *range(60)]
    df = spark.createDataFrame([(k, "b c  d e\nf g") for k in ids] + [(60, None), (61, "")], "doc_id long, text string")
    for r in with_planted_periods(df).collect():
        if r.id is not None and r.text:
            assert words_of(r.text) == planted(r.id, list("bcdefg"))


# ---- operator 12

@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300_000), st.integers(1, 40_000), st.integers(1, 3)), min_size=1, max_size=6))
def test_boundary_sets_select(parts):
    numbers = np.unique(np.concatenate([np.arange(a, a + n * s, s) for a, n, s in parts]))
    places = Boundaries(numbers)
    assert len(places) == len(numbers)
    for k in {0, len(numbers) - 1, *random.Random(1).choices(range(len(numbers)), k=40)}:
        assert places.select(k) == numbers[k]


def test_containers_are_the_smallest_kind():
    kinds = [Container.of(np.array(x, np.uint16)).kind for x in (
        range(0, 9_000, 2), range(0, 60_000, 2), range(50, 9_000), [0], [1, 2])]
    assert kinds == ["bitmap", "bitmap", "run", "array", "array"]
    assert [c.kind for c in boundaries("a " * 40_000).containers] == ["bitmap", "bitmap"]
    assert [c.kind for c in boundaries("a" * 70_000, "char").containers] == ["run", "run"]


def fim_brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, hexes = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_odd_rows(spark):
    bits = ["a", "é😀", " ", "\n", "\t\x0b", "<P", ">", "<S>", " ", " ", "x́", "0"]
    rnd = random.Random(5)
    texts = [None, "", " ", "  a", "a  ", "<P", "S>", "word " * 40_000, "😀 " * 9_000]
    texts += ["".join(rnd.choices(bits[:7] + bits[8:] if k % 5 else bits, k=rnd.randrange(1, 30))) for k in range(300)]
    rows = [(k if k % 50 else None, t, 7, "f") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    out = fill_in_middle(df).select("*", restored(F.col("output"), F.col("form")).alias("again")).collect()
    want = Counter((i, *fim_brute(i, t)) for i, t, *_ in rows)
    got = Counter((r.id, r.n, r.form, r.start, None if r.start is None else r.end - r.start, r.output) for r in out)
    assert got == want
    assert sorted(r.again for r in out) == sorted(t or "" for t in texts)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0
    lines = fill_in_middle(df, unit="line", rate=100).collect()
    assert all(r.n == len((texts[r.id] or "").split("\n")) - (texts[r.id] or "\n").endswith("\n")
               for r in lines if r.id is not None)
    assert sorted(r.n for r in fill_in_middle(df, unit="char").collect()) == sorted(len(t or "") for t in texts)


def test_fill_in_middle_of_the_driver_table(spark):
    docs = documents(spark.read.parquet(f"{SF001}/documents.parquet").collect())
    got = QUERIES["op12_fill_in_middle"](spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, p, m, out = fim_brute(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == sha(out) and r.restored_sha256 == sha(docs[r.doc_id] or "")


# ---- operator 13

def substrings_brute(texts, m=35):
    words = [words_of(t) for t in texts]
    often = Counter(tuple(w[i:i + m]) for w in words for i in range(len(w) - m + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - m + 1) if often[tuple(w[i:i + m])] > 1 for k in range(m)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_last_minimum():
    rnd = random.Random(3)
    for _ in range(200):
        v = np.array([rnd.randrange(4) for _ in range(rnd.randrange(1, 60))], np.uint64)
        w = rnd.randrange(1, len(v) + 1)
        got = _last_minimum(v, w)
        assert got.tolist() == [max(range(i, i + w), key=lambda j: (-int(v[j]), j)) for i in range(len(v) - w + 1)]


def test_equal_windows_choose_equal_anchors():
    rnd = random.Random(9)
    seeds = Seeds(35)
    shared = [f"w{rnd.randrange(40)}" for _ in range(35)]
    seen = set()
    for _ in range(30):
        left = [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(50))]
        text = " ".join(left + shared + [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(50))])
        anchor, first, size, place, windows, _ = seeds.of(text.encode())
        k = int(np.searchsorted(first, len(left), side="right")) - 1
        seen.add((int(anchor[k]), int(place[k] - (len(left) - first[k])), int(windows[len(left)])))
    assert len(seen) == 1


def odd_texts():
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(9))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 90, 200)]
    texts = [None, "", " \n", "a", "a " * 34, "a " * 36, "b c " * 100, "Ü x " * 40, "z\x0b" * 20_000]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            parts += [word() for _ in range(rnd.randrange(30))]
            p = rnd.choice(passages)
            a = rnd.randrange(0, len(p) // 2)
            p = p[a:a + rnd.randrange(20, 200)]
            if rnd.random() < 0.3:
                p = [*p[:len(p) // 2], word(), *p[len(p) // 2:]]
            parts += p
        texts.append(rnd.choice([" ", "\n", "\t "]).join(parts))
    return texts + texts[20:40] + [texts[30].upper()]


@pytest.mark.parametrize("m, split", [(35, False), (35, True), (50, False)])
def test_substrings_of_odd_rows(spark, monkeypatch, m, split):
    texts = odd_texts()
    rows = [(None if k % 9 == 0 else k % 60, t, "s", k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans string, kept int")
    if split:                                          # every key that repeats is a hot one
        monkeypatch.setattr(common, "HOT_ROWS", 1)
    got = dedup_substrings(df, min_words=m).collect()
    assert sorted((r.n_words, r.n_removed, r.kept) for r in got) == sorted(substrings_brute(texts, m))
    assert all(r.n_removed == sum(x.end - x.start for x in r.spans) for r in got)
    assert sorted(r.id is None for r in got) == sorted(r[0] is None for r in rows)
    assert dedup_substrings(df.limit(0), min_words=m).count() == 0


def test_substrings_of_the_driver_table(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    want = {r.doc_id: x for r, x in zip(rows, substrings_brute([r.text for r in rows]))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op13_substring_dedup"](spark, SF001).collect()}
    assert got == {k: (n, gone, sha(kept)) for k, (n, gone, kept) in want.items()}
    assert sum(x[1] for x in want.values()) > 0
