"""All registered market-tape queries and their SQL."""

from __future__ import annotations

from tapewright.plans import backtest, book, capture, files, ops, research, signals, streams

_ALL = (backtest, book, research, ops, signals, capture, files, streams)

QUERIES: dict = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}
