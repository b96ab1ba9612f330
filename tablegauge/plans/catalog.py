"""All registered queries and their checking SQL, by operator."""

from __future__ import annotations

from tablegauge.plans import (
    drift_queries,
    evaluate_queries,
    evidence_queries,
    experiment_queries,
    leakage_queries,
    profile_queries,
    run_queries,
    store_queries,
    stream_queries,
)

entry_query = drift_queries.entry_query

_MODULES = (
    profile_queries,
    leakage_queries,
    drift_queries,
    evaluate_queries,
    run_queries,
    store_queries,
    stream_queries,
    evidence_queries,
    experiment_queries,
)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
