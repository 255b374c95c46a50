"""Every registered query of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from countloom.plans import contracts, core, domain, evaluation, evidence, modelling  # noqa: F401
from countloom.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
