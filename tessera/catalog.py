"""All registered queries, each with the DuckDB statement it must agree with."""

from __future__ import annotations

from tessera.plans import aggregation, cells, derived, fulltext, history, keyed, people, platform, relational, search, sources, texts, transcripts
from tessera.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregation", "cells", "derived", "fulltext", "history", "keyed", "people", "platform", "relational", "search", "sources", "texts", "transcripts"]
