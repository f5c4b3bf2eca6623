"""Name -> function(Warehouse) -> DataFrame, one entry per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.plans import experiment_queries, ingest_queries, mart_queries, scoring_queries, warehouse_queries
from tidemark.sources import Warehouse

CATALOG: dict[str, Callable[[Warehouse], DataFrame]] = {
    **mart_queries.QUERIES,
    **experiment_queries.QUERIES,
    **scoring_queries.QUERIES,
    **ingest_queries.QUERIES,
    **warehouse_queries.QUERIES,
}
