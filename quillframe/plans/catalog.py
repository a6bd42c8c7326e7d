"""All queries over the reference operators, by name."""

from __future__ import annotations

from quillframe.plans import features, planes, reports, scenes, sequences, streams, tracks

PLANS = (sequences, features, planes, scenes, tracks, reports, streams)


def queries():
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql():
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
