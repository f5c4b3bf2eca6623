"""DuckDB SQL per query, composed from the data model and shared steps."""

from __future__ import annotations

from tidemark.plans import oracle_experiments, oracle_ingest, oracle_marts, oracle_scoring, oracle_warehouse
from tidemark.plans.oracle_sources import compose

SHARED: dict[str, str] = {**oracle_marts.SHARED, **oracle_experiments.SHARED, **oracle_scoring.SHARED, **oracle_ingest.SHARED, **oracle_warehouse.SHARED}
BODIES: dict[str, str] = {**oracle_marts.BODIES, **oracle_experiments.BODIES, **oracle_scoring.BODIES, **oracle_ingest.BODIES, **oracle_warehouse.BODIES}
ORACLE: dict[str, str] = {name: compose(body, SHARED) for name, body in BODIES.items()}
