"""Imports every module that registers queries."""

from __future__ import annotations

from quern.plans import history_queries, ledger_queries, line_queries, memory_queries, report_queries, search_queries, shell_queries, summary_queries  # noqa: F401
from quern.plans.catalog import QUERIES, SQL  # noqa: F401
