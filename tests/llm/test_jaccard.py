import random

from tallyframe.llm.grams import Fragments, WordHashes, shingles
from tallyframe.llm.jaccard import near_duplicate_groups
from tests.conftest import SF001


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows, width, percent):
    """rows of (id, text) -> {id: (n, smallest reachable id)}, all pairs compared."""
    sets = {}
    for i, t in rows:
        w = words_of(t)
        k = min(width, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and len(a) * 100 >= percent * len(b) and len(b) * 100 >= percent * len(a):
                c = len(a & b)
                if 100 * c >= percent * (len(a) + len(b) - c):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def groups(spark, rows, width, percent):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, id int")
    return {r["id"]: (r["n"], r["group"]) for r in near_duplicate_groups(df, width=width, percent=percent).collect()}


def near_copies(seed, bases=6, copies=14, length=90):
    rnd = random.Random(seed)
    rows, shared = [], " ".join(f"common{i}" for i in range(12))
    for b in range(bases):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([9, 30, length]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
                k = rnd.randrange(len(w))
                w[k:k + 1] = rnd.choice([[], [f"n{rnd.randrange(10**6)}"], [w[k], f"m{rnd.randrange(10**6)}"]])
                w = w or ["x"]
            rows.append((" ".join(w) + (" " + shared if rnd.random() < 0.2 else "")))
    rnd.shuffle(rows)
    return list(enumerate(rows, 100))


def test_links_match_all_pairs(spark):
    rows = near_copies(1)
    assert groups(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_other_width_and_threshold(spark):
    rows = near_copies(2)
    assert groups(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_driver_documents_match_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert groups(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one  two"), (7, "a " * 5000),
            (8, "A " * 5000), (9, "É é"), (10, "é é")]
    got = groups(spark, rows, 4, 85)
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 4), 7: (1, 7), 8: (1, 7),
                   9: (1, 9), 10: (1, 10)}


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicate_groups(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (4, "A b c")], schema)
    assert sorted(map(tuple, near_duplicate_groups(df).collect()), key=str) == [
        (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None)]


def test_null_id_ahead_of_a_text_and_its_near_copy(spark):
    words = [f"w{k}" for k in range(100)]
    text, near = " ".join(words), " ".join(words[:99] + ["other"])
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, text), (2, text), (1, near)], schema).coalesce(1)    # one task, in this order
    assert sorted(map(tuple, near_duplicate_groups(df).collect()), key=str) == [
        (1, 96, 1), (2, 96, 1), (None, 96, None)]


def test_linked_sets_share_a_signature():
    """The pigeonhole bound, on random pairs right at the threshold."""
    rnd, words = random.Random(5), WordHashes()
    for percent in (80, 85):
        cuts = Fragments(percent)
        for _ in range(400):
            n = rnd.randrange(2, 300)
            a = [f"a{rnd.randrange(10**9)}" for _ in range(n)]
            b = list(a)
            rnd.shuffle(b)
            drop = rnd.randrange(0, n // 3 + 1)
            b = b[drop:] + [f"b{rnd.randrange(10**9)}" for _ in range(rnd.randrange(0, n // 4 + 1))]
            x, y = (shingles(" ".join(t), 1, words) for t in (a, b))
            c = len(set(x.tolist()) & set(y.tolist()))
            if 100 * c >= percent * (len(x) + len(y) - c) and x.tolist() != y.tolist():
                assert set(cuts.signatures(x).tolist()) & set(cuts.signatures(y).tolist())
