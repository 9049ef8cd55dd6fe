import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm.chat import digests, format_conversations, read_back
from tallyframe.llm.licenses import _automaton, evaluate, normal_form, parse_expression, scan_licenses, scan_text
from tallyframe.llm.line_dedup import dedup_lines
from tallyframe.llm.queries import QUERIES
from tallyframe.llm.warc import normalise, read_records, round_trip, write_archives
from tests.conftest import SF001, SF01


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- operator 5

def chat_brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss))
    return out


def chat(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    return {r[0]: tuple(r)[1:5] for r in digests(read_back(format_conversations(df))).collect()}


def test_chat_of_the_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r[0]: tuple(r)[1:5] for r in QUERIES["op5_chat_format"](spark, SF01).collect()}
    assert got == chat_brute(rows)


def test_chat_of_odd_rows(spark):
    rnd = random.Random(2)
    bits = ["<s>", "</s>", "<sep>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "s>", "/", "\n", "é😀", " ", "$1"]
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", None, "<s>r", "<s>r\n", "a\\n", "\\\n\nb"]), rnd.choice(
        [None, "", *("".join(rnd.choices(bits, k=rnd.randrange(1, 9))) for _ in range(8))]))
        for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(None, None, "assistant", "x"), (7, 0, "assistant", "twice"), (7, 0, "assistant", "twice"),
             (8, 3, "assistant", "long " * 40_000)]
    assert chat(spark, rows) == chat_brute(rows)


def test_chat_merges_turns_of_one_role(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c</s>")],
                               "conv_id long, turn long, role string, text string")
    row = format_conversations(df).first()
    assert row.formatted == "<s>user\na</s><s>assistant\nb<sep>c<\\/s></s>"
    assert [row.formatted[m.start:m.start + m.length] for m in row.loss_mask] == ["b", "c<\\/s>"]
    assert format_conversations(df.limit(0)).count() == 0


# ---- operator 7

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words))
            if words[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def test_licenses_of_the_driver_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = QUERIES["op7_license_scan"](spark, SF01).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("MIT license cc by CC-BY gnu general public apache é ı İ K x 7 { ~ \x7f \n \t \x00".split(" ") + ["mit license"]),
                max_size=25))
def test_licenses_of_odd_texts(parts):
    text = " ".join(parts)
    assert scan_text(text, _automaton())[:5] == license_brute(text)


def test_expressions():
    ids = lambda e: parse_expression(e) and evaluate(parse_expression(e))
    assert ids("MIT OR Apache-2.0") == [{"mit"}, {"apache-2.0"}]
    assert ids("MIT and (BSD-3-Clause or ISC) */") == [{"mit", "bsd-3-clause"}, {"mit", "isc"}]
    assert ids("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT") == [
        {"gpl-2.0-only with classpath-exception-2.0"}, {"mit"}]
    assert ids("a or b and c") == [{"a"}, {"b", "c"}]
    for bad in ("", "or MIT", "MIT or", "(MIT", "MIT and or X"):
        assert parse_expression(bad) is None
    row = scan_text("x\n// SPDX-License-Identifier: (MIT OR GPL-2.0+)\ny", _automaton())
    assert row[5] == "gpl-2.0+,mit" and row[6] == ["gpl-2.0+|mit"] and row[7] == 1.0


def test_normal_form_stays_as_long_as_the_expression():
    form = lambda e: normal_form(parse_expression(e))
    assert form("MIT and (BSD-3-Clause or ISC)") == "(bsd-3-clause|isc)+mit"
    assert form("b or a or (b) or c and b") == "(b+c)|a|b"
    assert form("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT") == "gpl-2.0-only with classpath-exception-2.0|mit"
    assert form("(x or x) and x") == "x"
    line = " AND ".join(f"(a{k} OR b{k})" for k in range(60))      # 2^60 choices
    got, = scan_text("SPDX-License-Identifier: " + line, _automaton())[6]
    assert len(got) <= len(line) and got.count("|") == 60


def test_license_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (None, "", "t"), (2, "The MIT License " * 9000, "t"),
                                (2, "The MIT License " * 9000, "t")], "doc_id long, text string, labels string")
    got = sorted(map(tuple, scan_licenses(df).select("id", "n_words", "n_base", "last_word").collect()), key=str)
    assert got == [(1, 0, 0, None), (2, 27000, 9000, 26998), (2, 27000, 9000, 26998), (None, 0, 0, None)]
    assert scan_licenses(df.limit(0)).count() == 0


# ---- operator 2

def warc_brute(rows):
    digest = {i: hashlib.sha1((h or "").encode()).hexdigest() for i, _, h in rows}
    size = {i: len((h or "").encode()) for i, _, h in rows}
    last = {}
    for i in digest:
        if size[i] >= 1000:
            last[digest[i]] = max(i, last.get(digest[i], i))
    return {(i, size[i], digest[i], "response" if last.get(digest[i], i) == i else "revisit",
             None if last.get(digest[i], i) == i else last[digest[i]]) for i in digest}


def test_warc_of_the_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op2_warc"](spark, SF01).collect()
    assert len(got) == len(rows) and {tuple(r)[:5] for r in got} == warc_brute(rows)


def test_warc_of_odd_pages(spark, tmp_dir):
    big = "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", big), (4, "u", "same"), (5, "ü", "same"), (6, "u", None),
            (0, "u", ""), (7, "u", "x" * 1_500_000), (8, "u", "y" * 999), (9, "u", "y" * 999)]
    df = spark.createDataFrame([(*r, "r") for r in rows], "page_id long, url string, html string, record_type string")
    got = round_trip(spark, df).collect()
    assert {tuple(r)[:5] for r in got} == warc_brute(rows) and len(got) == len(rows)
    files = normalise(write_archives(df, f"{tmp_dir}/raw"), f"{tmp_dir}/raw", f"{tmp_dir}/new")
    import glob
    import gzip
    import zlib

    for f in glob.glob(f"{tmp_dir}/raw/*.gz"):
        raw = open(f, "rb").read()
        one = zlib.decompressobj(31)
        one.decompress(raw)
        assert one.eof and not one.unused_data                       # a single stream
        assert gzip.open(f).read() == gzip.open(f.replace("/raw/", "/new/")).read()
    assert read_records(files, f"{tmp_dir}/new").count() == len(rows)
    assert round_trip(spark, df.limit(0)).count() == 0


def test_warc_without_ids(spark):
    big = "z" * 2000
    df = spark.createDataFrame([(None, "a", big), (None, "b", big), (4, "c", "q" * 1000), (None, "c", "q" * 1000)],
                               "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in round_trip(spark, df).collect())
    assert got == [(-1, "response", -1), (-1, "response", -1), (-1, "revisit", 4), (4, "response", -1)]


# ---- operator 10

def dedup_brute(rows, min_words):
    """Removed line numbers by (id, text), comparing all suffixes."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seqs = [[x for x in (t or "").split("\n") if x.encode().split()] for _, t in docs]
    count = Counter(x for (i, t), s in zip(docs, seqs) for x in s)
    for r, k in Counter(rows).items():
        for x in (r[1] or "").split("\n"):
            count[x] += k - 1
    first, removed = {}, [set() for _ in docs]
    for d, s in enumerate(seqs):
        for i in range(len(s)):
            m = words = 0
            while i + m < len(s) and count[s[i + m]] > 1 and words < min_words:
                words += len(s[i + m].encode().split())
                m += 1
            if words < min_words:
                continue
            key = tuple(s[i:i + m])
            if key in first:
                e, j = first[key]
                n = m
                while i + n < len(s) and j + n < len(seqs[e]) and s[i + n] == seqs[e][j + n]:
                    n += 1
                removed[d].update(range(i, i + n))
            else:
                first[key] = (d, i)
    return {docs[d]: sorted(removed[d]) for d in range(len(docs))}


def dedup(spark, rows, min_words):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, removed string, i int")
    out = dedup_lines(df, min_words=min_words).collect()
    assert len(out) == len(rows)
    return out


def test_line_dedup_matches_all_suffixes(spark):
    rnd = random.Random(4)
    pool = [" ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 9))) for _ in range(25)]
    runs = [[rnd.choice(pool) for _ in range(rnd.randrange(2, 12))] for _ in range(6)]
    rows = []
    for n in range(70):
        parts = list(itertools.chain.from_iterable(
            rnd.choice([rnd.choice(runs), [f"unique {n} {k}"], [rnd.choice(pool)], ["", "  "]]) for k in range(rnd.randrange(0, 9))))
        rows.append((n, "\n".join(parts)))
    rows += [(5000, rows[3][1]), (5001, "\n".join(runs[0] * 5))]
    want = dedup_brute(rows, 12)
    got = dedup(spark, rows, 12)
    assert any(want.values())
    for r in got:
        text = dict(rows)[r.id]
        assert r.removed == want[r.id, text], r.id
        lines = [x for x in text.split("\n") if x.strip()]
        if r.removed:
            assert r.clean_text == "\n".join(x for n, x in enumerate(lines) if n not in set(r.removed))
        else:
            assert r.clean_text == text


def any_copy_brute(rows, min_words):
    """Removed line numbers by (id, text): from every line on, the longest run with any earlier copy."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seqs = [[x for x in (t or "").split("\n") if x.encode().split()] for _, t in docs]
    places, removed = defaultdict(list), [set() for _ in docs]
    for d, s in enumerate(seqs):
        for i, x in enumerate(s):
            n = 0
            for e, j in places[x]:
                m = 1
                while i + m < len(s) and j + m < len(seqs[e]) and s[i + m] == seqs[e][j + m]:
                    m += 1
                n = max(n, m)
            if sum(len(x.encode().split()) for x in s[i:i + n]) >= min_words:
                removed[d].update(range(i, i + n))
            places[x].append((d, i))
    return {docs[d]: sorted(removed[d]) for d in range(len(docs))}


def test_line_dedup_follows_any_earlier_copy(spark):
    head = " ".join(f"h{k}" for k in range(60))
    rows = [(2 * k + n, f"{head}\ntail a{k}\ntail b{k}") for k in range(20) for n in (0, 1)]
    assert {r.id: r.removed for r in dedup(spark, rows, 50)} == {
        i: [] if i == 0 else [0, 1, 2] if i % 2 else [0] for i, _ in rows}


@pytest.mark.parametrize("seed", [11, 12])
def test_line_dedup_matches_the_longest_run_of_any_copy(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.choice([1, 1, 2, 4, 8, 14]))) for _ in range(12)]
    runs = [[rnd.choice(pool) for _ in range(rnd.randrange(2, 12))] for _ in range(6)]
    rows = []
    for n in range(120):
        parts = [rnd.choice([rnd.choice(runs), [f"unique {n} {k}"], [rnd.choice(pool)], ["", "  "]])
                 for k in range(rnd.randrange(0, 9))]
        rows.append((n, "\n".join(itertools.chain.from_iterable(parts))))
    rows += rows[:5]
    want = any_copy_brute(rows, 12)
    got = dedup(spark, rows, 12)
    assert Counter((r.id, r.n_lines, tuple(r.removed)) for r in got) == Counter(
        (i, sum(1 for x in t.split("\n") if x.strip()), tuple(want[i, t])) for i, t in rows)


def test_line_dedup_of_the_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = dedup_brute(rows, 50)
    got = {r.doc_id: r.removed for r in QUERIES["op10_line_dedup"](spark, SF001).collect()}
    assert got == {i: v for (i, _), v in want.items()} and any(got.values())


def test_line_dedup_of_odd_rows(spark):
    long = "\n".join(f"line {k} of a long text" for k in range(3000))
    rows = [(None, "a b c\nd e f"), (1, None), (2, ""), (3, "a b c\nd e f"), (3, "a b c\nd e f"), (4, long), (5, long),
            (6, "x\nx\nx\nx\nx\nx\nx")]
    got = {(r.id, r.n_lines): r.removed for r in dedup(spark, rows, 4)}
    assert got[None, 2] == [] and got[3, 2] == [0, 1] and got[1, 0] == [] and got[2, 0] == []
    assert got[4, 3000] == [] and got[5, 3000] == list(range(3000))
    assert got[6, 7] == dedup_brute(rows, 4)[6, "x\nx\nx\nx\nx\nx\nx"]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op7_license_scan", "op5_chat_format"])
def test_queries_have_the_contract_columns(spark, name):
    want = {"op7_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                                 "expressions"],
            "op5_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]}
    assert QUERIES[name](spark, SF001).columns == want[name]


def test_archives_of_several_members(spark, tmp_dir):
    """Gzip files of one, two and a hundred members, padded or not, keep every record; a cut one is an error."""
    import gzip
    import os

    from tallyframe.llm.warc import record

    os.makedirs(f"{tmp_dir}/raw")
    records = [record(k, f"http://x/{k}", f"<p>{k}</p>".encode() * 50, sha(str(k)), None) for k in range(100)]
    cuts = {"one": [100], "two": [30, 70], "hundred": [1] * 100, "padded": [50, 50]}
    for name, sizes in cuts.items():
        at, members = 0, []
        for n in sizes:
            members.append(gzip.compress(b"".join(records[at:at + n])))
            at += n
        with open(f"{tmp_dir}/raw/{name}", "wb") as f:
            f.write((b"\0" * 600 if name == "padded" else b"").join(members) + (b"\0" * 9 if name == "padded" else b""))
    files = spark.createDataFrame([(n,) for n in cuts], "file string")
    assert {r.file: r.records for r in normalise(files, f"{tmp_dir}/raw", f"{tmp_dir}/new").collect()} == dict.fromkeys(cuts, 100)
    with open(f"{tmp_dir}/raw/two", "rb") as f, open(f"{tmp_dir}/raw/cut", "wb") as g:
        g.write(f.read()[:-20])
    with pytest.raises(Exception, match="ends within"):
        normalise(spark.createDataFrame([("cut",)], "file string"), f"{tmp_dir}/raw", f"{tmp_dir}/bad").collect()


def test_licence_expressions_reach_the_result(spark, tmp_dir):
    texts = ["SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: MIT AND Apache-2.0", "no licence", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = {r.doc_id: r.expressions for r in QUERIES["op7_license_scan"](spark, tmp_dir).collect()}
    assert got == {0: "apache-2.0|mit", 1: "apache-2.0+mit", 2: "", 3: ""}
