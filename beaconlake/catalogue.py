"""Every query of the library by name, with the SQL that DuckDB answers it with."""

from __future__ import annotations

from .plans import files, logs, passages, redirects, reports, series, sites, surveys, trees

FAMILIES = [logs, surveys, series, redirects, sites, files, passages, trees, reports]


def queries() -> dict:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.SQL.items()}
