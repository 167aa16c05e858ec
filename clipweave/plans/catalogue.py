"""Every query of the engine by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from clipweave.plans import candidates, canonical, evaluation, export_state, intervals, planner, qc, records, review, rules, selection, signals, slicer, text, vectors, views
from clipweave.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = qc.qc_finalize_clips

__all__ = ["candidates", "canonical", "evaluation", "export_state", "intervals", "planner", "records", "review", "rules", "selection", "signals", "slicer", "text", "vectors", "views", "FLAGSHIP", "ORACLE_SQL", "QUERIES"]
