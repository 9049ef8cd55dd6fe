import pytest

from tallyframe.llm.queries import ORACLES
from tests.conftest import SF01
from tests.llm.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    check(spark, name, SF01)


def test_short_items_inside_documents(spark):
    """Items of one to four words are found in long documents; the SQL twin finds the same."""
    import duckdb

    from tallyframe.llm.decontaminate import contained_items
    from tallyframe.llm.oracles import contained_sql

    docs = [(1, "some words and then the FOUR word item stands here at the end of it all"), (2, "four word"), (3, None), (4, ""),
            (5, "one"), (6, "The four words item"), (7, "a b c d e f g h i j"), (8, "x a b c d e f g y"), (None, "one"), (5, "also one here")]
    items = [(10, "the four word item"), (11, "one"), (12, "four word"), (13, "a b c d e f g"), (14, None), (15, " "), (16, "a c"),
             (17, "h i j k"), (None, "one"), (18, "one"), (18, "here at the end of")]
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, gram string, m int")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, n_common int")
    got = sorted(tuple(r) for r in contained_items(d, i).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in docs if r[0]])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [r for r in items if r[0]])
    want = sorted(con.execute("WITH " + contained_sql("documents") + " SELECT * FROM contained").fetchall())
    assert got == want
    assert {(a, b) for a, b, *_ in got} >= {(1, 10), (1, 12), (2, 12), (5, 11), (7, 13), (8, 13)}
    assert not {b for _, b, *_ in got} & {14, 15, 16, 17}
    assert contained_items(d.limit(0), i).count() == 0 and contained_items(d, i.limit(0)).count() == 0
