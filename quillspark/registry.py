"""All registered queries of the core, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from quillspark.operators import findings, live, lookups, memory, metrics, provenance, runs, texts, timestamp_queries
from quillspark.streaming import streams

_MODULES = [metrics, runs, memory, texts, findings, provenance, live, lookups, streams, timestamp_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
