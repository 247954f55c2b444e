"""All queries over the fixtures, and their SQL."""

from __future__ import annotations

from . import calibration_queries, contact_queries, matching_queries, quality_queries, reliability_queries, report_queries, selection_queries, split_queries

MODULES = (contact_queries, selection_queries, split_queries, reliability_queries, calibration_queries, report_queries, quality_queries, matching_queries)


def gathered(modules) -> tuple[dict, dict]:
    """The queries of modules and their SQL; a name that two of them have is an error."""
    queries, oracles = {}, {}
    for m in modules:
        twice = queries.keys() & m.Q.keys()
        if twice or not m.O.keys() <= m.Q.keys():
            raise ValueError(f"{m.__name__}: {sorted(twice or m.O.keys() - m.Q.keys())} are registered twice, or SQL without a query")
        queries |= m.Q
        oracles |= m.O
    return queries, oracles


QUERIES, ORACLES = gathered(MODULES)
