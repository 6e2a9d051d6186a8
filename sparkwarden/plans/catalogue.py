"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from sparkwarden.plans import detection, edges, evaluate, lines, relational, scored, training

_PARTS = [lines.R, detection.R, evaluate.R, relational.R, edges.R, training.R, scored.R]


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
