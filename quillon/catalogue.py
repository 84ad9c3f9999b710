"""All named queries of the library with their SQL equivalents."""

from __future__ import annotations

from quillon.plans import mining as _mining  # noqa: F401  (registers its queries)
from quillon.plans import queries as _queries
from quillon.plans import sources_reports as _sources_reports  # noqa: F401  (registers its queries)


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.SQL)
