"""Queries over the data tables, each with the SQL that must give the same rows."""

from tidebook.plans import history, integrity, ledger, metrics, reports, streams, window_txn
from tidebook.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "history", "integrity", "ledger", "metrics", "reports", "streams", "window_txn"]
