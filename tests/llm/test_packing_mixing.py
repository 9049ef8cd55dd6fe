import random
from collections import Counter, defaultdict

import pytest

from tallyframe.llm.mixing import mix
from tallyframe.llm.packing import CapacityTree, best_fit_decreasing, chunks, encoder, VOCABULARY, pack_tokens, unpack
from tests.conftest import SF001, SF01


def simple_bfd(sizes, length):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms[rooms.index(min(fit))] -= s
        else:
            rooms.append(length - s)
    return sorted(rooms)


def test_best_fit_matches_a_plain_search():
    rnd = random.Random(3)
    for _ in range(60):
        length = rnd.choice([7, 64, 100])
        sizes = [rnd.randrange(1, length + 1) for _ in range(rnd.randrange(0, 120))]
        rows = best_fit_decreasing(sizes, length)
        assert sorted(p for r in rows for p in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[p] for p in r) for r in rows) == simple_bfd(sizes, length)


def test_capacity_tree_takes_the_tightest_row():
    t = CapacityTree(10)
    for room, row in ((4, 0), (9, 1), (4, 2), (0, 3)):
        t.add(room, row)
    assert t.take(5) == (9, 1) and t.take(5) is None and t.take(1)[0] == 4 and t.take(0) == (0, 3)


def test_packing_is_a_round_trip(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = pack_tokens(docs, length=256, group_tokens=20_000).collect()
    assert Counter(unpack(rows)) == Counter((r.doc_id, r.text) for r in docs.collect())
    for r in rows:
        assert len(r.ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.parts) == len(r.position_resets)


def test_packing_of_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "no id"), (3, "x" * 200_000), (4, " " * 150_000), (5, "é<|endoftext|> ok"),
             (5, "é<|endoftext|> ok"), (6, "long text " * 30_000)]
    df = spark.createDataFrame([(i, t, "a", 0) for i, t in texts], "doc_id long, text string, ids string, row int")
    assert Counter(unpack(pack_tokens(df).collect())) == Counter((i, t or "") for i, t in texts)
    assert pack_tokens(df.limit(0)).count() == 0


def test_chunks_do_not_change_the_ids():
    enc, text = encoder(VOCABULARY), "some words, and  more\n words 12 " * 400
    assert [t for c in chunks(text, 100) for t in enc.encode_ordinary(c)] == enc.encode_ordinary(text)


def test_chunks_keep_the_ids_of_any_text():
    enc, rnd = encoder(VOCABULARY), random.Random(8)
    parts = ["word", "Über", "don't", "日本語のテキスト", "한국어", "42", "3.14", "!!", "—", "\n", "\n\n", "\t", " ", "   ", "\r\n", "\u00a0", "😀", "x'll", "\x1c", "́"]
    texts = [sep.join(f"word{k}" for k in range(400)) for sep in ("\n", "\t", "\n\n", "  ", ", ", "。")]
    texts += ["".join(rnd.choices(parts, k=500)) for _ in range(60)]
    for text in texts:
        pieces = list(chunks(text, 100))
        assert "".join(pieces) == text and len(pieces) > 3
        assert [t for c in pieces for t in enc.encode_ordinary(c)] == enc.encode_ordinary(text)
    long = "\n".join(f"line {k}" for k in range(30_000))
    assert [t for c in chunks(long) for t in enc.encode_ordinary(c)] == enc.encode_ordinary(long)
    assert "".join(chunks("y" * 1_000, 300)) == "y" * 1_000


def fill(budget, kids):
    """kids {name: (cap, weight)} -> {name: budget}, by repeated rounds."""
    got, open_ = {}, dict(kids)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap <= budget * w / total + 1e-9]
        if not full:
            return got | {k: budget * w / total for k, (_, w) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[0]
            budget -= got[k]
    return got


def brute_mix(rows, weights, budget, max_epochs):
    """rows (domain, lang, source, tokens) -> budgets of the leaves."""
    supply = Counter()
    for d, la, s, n in rows:
        supply[d, la, s] += n
    weight = lambda k: weights.get(k, 1.0)
    leaves = {k: v for k, v in supply.items() if v and all(weight(k[:i]) > 0 for i in (1, 2, 3))}

    def down(path, amount):
        if len(path) == 3:
            return {path: amount}
        kids = {k[:len(path) + 1] for k in leaves if k[:len(path)] == path}
        caps = {k: (sum(v for x, v in leaves.items() if x[:len(k)] == k) * max_epochs, weight(k)) for k in kids}
        out = {}
        for k, b in fill(amount, caps).items():
            out |= down(k, b)
        return out

    return supply, down((), float(budget if budget is not None else sum(leaves.values())))


@pytest.mark.parametrize("budget,epochs", [(None, 4), (3000, 1), (40_000, 3), (10**9, 2), (0, 2)])
def test_mix_meets_the_budgets(spark, budget, epochs):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 300")
    weights = {("src0",): 3.0, ("other", "en"): 2.5, ("other", "de", "src3"): 0.0, ("other", "fr", "src4"): 9.0}
    from pyspark.sql import functions as F

    domain = F.when(F.col("source") == "src0", "src0").otherwise("other")
    taken = mix(docs, weights, budget, epochs, domain=domain).collect()
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    rows = [("src0" if r.source == "src0" else "other", r.lang, r.source, words[r.doc_id]) for r in docs.collect()]
    supply, want = brute_mix(rows, weights, budget, epochs)
    got, per_epoch = Counter(), defaultdict(set)
    for r in taken:
        leaf = (r.domain, r.language, r.source)
        assert r.id not in per_epoch[leaf, r.epoch] and r.row.doc_id == r.id and r.n_tokens == words[r.id]
        per_epoch[leaf, r.epoch].add(r.id)
        got[leaf] += r.n_tokens
    longest = max(words.values())
    for leaf, b in want.items():
        assert got[leaf] <= b + 1e-3 and b - got[leaf] <= longest
        last = max([e for (x, e) in per_epoch if x == leaf], default=-1)
        everything = {r.doc_id for r in docs.collect() if (r.lang, r.source) == leaf[1:] and
                      ("src0" if r.source == "src0" else "other") == leaf[0]}
        for e in range(last):
            assert per_epoch[leaf, e] == everything
    assert set(got) <= set(want)


def test_mix_takes_the_longest_prefix_that_fits(spark):
    import hashlib

    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", "a") for i in range(200)], "doc_id long, text string, lang string, source string")
    taken = [r.id for r in mix(df, budget=333).collect()]
    order = sorted(range(200), key=lambda i: hashlib.md5(f"42:0:{i}".encode()).hexdigest())
    want, total = [], 0
    for i in order:
        if total + i % 7 + 1 > 333:
            break
        want.append(i)
        total += i % 7 + 1
    assert sorted(taken) == sorted(want)


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, row string, epoch int"
    df = spark.createDataFrame([(None, "a b", None, None, "r", 1), (1, None, "en", "x", None, 2), (2, "", "en", "x", "r", 2),
                                (3, "c", "en", "x", "r", 2), (3, "c", "en", "x", "r", 2)], schema)
    got = mix(df, max_epochs=1).collect()
    assert sorted((r.id is None, r.id or 0, r.epoch) for r in got) == [(False, 1, 0), (False, 2, 0), (False, 3, 0),
                                                                       (False, 3, 0), (True, 0, 0)]
    assert mix(df.limit(0)).count() == 0
