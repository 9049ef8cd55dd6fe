"""tallyframe: payments-ledger analytics as Spark DataFrame jobs.

The package answers, for all users at once, the questions a payments dashboard asks
one user at a time: portfolio KPIs and bars, transaction search and statements,
allocation runs with exact decimal conservation, wallet valuation from landed feeds,
data-quality checks and change application over Parquet snapshots, plus Structured
Streaming ingestion of processor events and request-quota reports.

Layout
------
``sources``    ledger table binding, landed feeds, audit/log sources and sinks
``functions``  Column-expression helpers (money, text, time)
``operators``  the ledger's operators (listings, portfolio, allocation, ...)
``plans``      the named query registry and its DuckDB oracle twins
``streaming``  Structured Streaming jobs (webhook ingestion, quota windows)
"""

from tallyframe.session import checkpoint_root, get_session

__all__ = ["get_session", "checkpoint_root"]
