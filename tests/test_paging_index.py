"""Deep pages and the substring index against the plain ways."""

import datetime as dt
from decimal import Decimal

import pytest

from tallyframe.operators import listings
from tallyframe.sources.textindex import TextIndex

from .conftest import rows
from .fixtures import frame

T0 = dt.datetime(2024, 1, 1)


def txs(spark):
    texts = ["Rent for May", "Émile's order 12", None, "", "ab", "order 120 and ORDER 13"]
    return frame(spark, "transactions", [
        dict(id=k, user_id=k % 3, type="send", amount=Decimal(1), amount_usd=Decimal(1), description=texts[k % 6],
             from_address=f"acct_{k % 40}" if k % 4 else None,
             created_at=None if k % 50 == 9 else T0 + dt.timedelta(minutes=k % 70)) for k in range(300)])


@pytest.mark.parametrize("offset, n", [(0, 5), (3, 300), (120, 40), (290, 50), (295, 1), (300, 5), (9_999, 5)])
def test_deep_pages(spark, offset, n):
    t = txs(spark).select(*listings.TX_COLUMNS)
    want = [r.id for r in t.orderBy(*listings.newest_first()).collect()][offset:offset + n]
    assert [r.id for r in listings.deep_page(t, n, offset, partitions=5).collect()] == want


def test_tx_page_goes_deep(spark, monkeypatch):
    monkeypatch.setattr(listings, "DEEP_PAGE", 20)
    t = txs(spark)
    ids = [r.id for r in t.orderBy(*listings.newest_first()).collect()]
    assert [r.id for r in listings.tx_page(t, 10, 100).collect()] == ids[100:110]
    assert [r.id for r in listings.tx_page(t, 10, 10).collect()] == ids[10:20]


def test_index_finds_what_the_scan_finds(spark, tmp_dir):
    t = txs(spark)
    index = TextIndex(spark, f"{tmp_dir}/index").build(t, blocks=12)
    for term in ["order 12", "ORDER 120", "émile", "acct_7", "acct_39", "299", "ab", "9", "rent for may", "zzz", "order 12x", None, ""]:
        for user in (None, 1):
            assert rows(index.search(term, user), "id") == rows(listings.tx_text_search(t, term, user), "id"), term
    assert index.blocks("ab") is None                       # too short to tell
    assert index.blocks("zzz") == []
    one = index.blocks("299")                               # an id: one block of twelve is read
    plan = index.search("299")._jdf.queryExecution().executedPlan().toString()
    assert len(one) == 1 and f"PartitionFilters: [isnotnull(block" in plan and f"= {one[0]})" in plan


def test_index_of_nothing(spark, tmp_dir):
    index = TextIndex(spark, f"{tmp_dir}/index")
    index.build(txs(spark).where("id in (2, 3)"), blocks=3)
    assert index.search("rent").count() == 0 and index.search(None).count() == 2
