"""All queries of the engine's own operators, by name, and their SQL."""

from __future__ import annotations

from tallyspark.plans import checks, filters, joins, listings, parsers, rollups, scans, scoring, streams, stubs, summaries, text, windows  # noqa: F401  they register their queries
from tallyspark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
