"""All registered queries of the llm operators."""

from __future__ import annotations

from quillspark.llm import document_queries, harvest_queries, mail_queries, memo_queries, pii_queries, survivor_queries, transcript_queries

_MODULES = [document_queries, harvest_queries, mail_queries, memo_queries, pii_queries, survivor_queries, transcript_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
