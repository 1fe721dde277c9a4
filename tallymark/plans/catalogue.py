"""All registered queries of the index library and their SQL."""

from __future__ import annotations

from . import audits, filings, prices, reports, scores, snapshots, stores

MODULES = (snapshots, scores, prices, reports, audits, filings, stores)


def queries() -> dict:
    return {n: f for m in MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {n: s for m in MODULES for n, s in m.ORACLES.items()}
