"""Collects the registered queries and their DuckDB oracles from the plan modules."""

from __future__ import annotations


def _modules():
    from curbflow.plans import days, fields, signatures, space, stores

    return [space, days, signatures, fields, stores]


def queries():
    found = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql():
    found = {}
    for module in _modules():
        found |= module.ORACLES
    return found
