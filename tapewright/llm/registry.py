"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tapewright.llm import alignment, bpe, chat, decontaminate, exact_dedup, jaccard, passages, pii, quality, repeats, spelling, toxicity, warc

_ALL = (bpe, chat, decontaminate, exact_dedup, jaccard, pii, quality, repeats, toxicity, warc, passages, spelling, alignment)

QUERIES = {m.QUERY: m.query for m in _ALL}
ORACLE_SQL = {m.QUERY: m.SQL for m in _ALL if getattr(m, "SQL", None)}
