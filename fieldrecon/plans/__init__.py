"""Registered queries: each binds an operator to the driver's tables."""

from __future__ import annotations


def load():
    """(queries, oracles) of every plan module."""
    from fieldrecon.plans import common, joins, pages, records, rules, schedule  # noqa: F401

    return common.QUERIES, common.ORACLES
