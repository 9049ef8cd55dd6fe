"""Every stage of the pipeline against a plain version of its decisions."""

from collections import Counter

import corpus_pipeline as cp
from tallyframe.llm.packing import unpack
from tallyframe.llm.quality_rules import quality_rules
from tests.conftest import SF001
from tests.llm.test_jaccard import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def saved(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def contains_item(text, items):
    words = text.lower().encode().split()
    have = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    return any(100 * len(g & have) >= 80 * len(g) for g in items if g)


def test_stages(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = saved(spark, cp.quality(spark, docs, SF001), f"{tmp_dir}/1")
    want = {r.id: r.clean_text for r in quality_rules(docs).where("kept").collect()}
    got = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == COLUMNS and set(got) == set(want)
    for i, r in got.items():
        assert r.n_chars == len(r.text)
        assert r.text == rows[i].text or r.text == want[i]

    one = saved(spark, cp.near_duplicates(spark, kept, SF001), f"{tmp_dir}/2")
    groups = brute([(i, r.text) for i, r in got.items()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, g) in groups.items() if i == g)
    assert one.columns == COLUMNS and len(groups) > one.count()

    clean = saved(spark, cp.decontaminate(spark, one, SF001), f"{tmp_dir}/3")
    items = []
    for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect():
        w = r.text.lower().encode().split()
        items.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not contains_item(r.text, items)}
    assert clean.columns == COLUMNS and clean.count() < one.count()

    mixed = saved(spark, cp.mixing(spark, clean, SF001), f"{tmp_dir}/4")
    assert mixed.columns == COLUMNS and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in clean.collect()}

    packed = cp.tokens(spark, mixed, SF001).collect()
    assert Counter(unpack(packed)) == Counter((r.doc_id, r.text) for r in mixed.collect())


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination",
                                         "mixing sources to target weights", "token-ID / binary output"]
    out = cp.run(spark, SF001)
    assert out.count() > 0 and "ids" in out.columns


def test_stages_on_odd_rows(spark):
    text = "The quick brown fox jumps over the lazy dog near the old river bank, again and once more. "
    rows = [(None, text * 1, "en", "src0", 90, "r"), (1, None, None, None, None, "r"), (2, "", "en", "a", 0, "r"),
            (3, text, "en", "a", 90, "r"), (3, text, "en", "a", 90, "r"), (4, text, "de", None, 90, "x"),
            (5, text + "\nhome\n" + "Different words entirely follow here, in a much longer line than before.", "en", "a", 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    kept = cp.quality(spark, df, SF001)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 3, 4, 5] and kept.columns == df.columns
    assert [r.text.count("home") for r in kept.where("doc_id = 5").collect()] == [0]
    one = cp.near_duplicates(spark, kept, SF001)
    assert sorted((r.doc_id or -1) for r in one.collect()) == [-1, 3, 5]
    assert cp.mixing(spark, one, SF001).columns == df.columns
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), SF001).count() == 0


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    item = spark.read.parquet(f"{SF001}/benchmark.parquet").orderBy("item_id").first().text
    words = [f"w{k}" for k in range(100)]
    text, near, other, more = " ".join(words), " ".join(words[:99] + ["x"]), "an entirely different clean text", "one more clean text"
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def left(stage, rows):
        df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], schema)
        out = stage(spark, df, SF001)
        assert out.columns == df.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    assert left(cp.near_duplicates, [(1, text), (2, near), (2, other)]) == [(1, text), (2, other)]
    got = left(cp.near_duplicates, [(3, text), (3, near), (3, other), (3, other)])
    assert len(got) == 2 and (3, other) in got
    dirty = f"some words {item} more words"
    assert left(cp.decontaminate, [(4, dirty), (4, other), (None, dirty), (None, more), (5, more)]) == sorted(
        [(4, other), (None, more), (5, more)], key=str)
