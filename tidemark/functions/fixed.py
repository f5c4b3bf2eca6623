"""Small fixed tables as local relations: their exact size is known to the planner and no Python worker is involved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def fixed_rows(spark: SparkSession, rows: Sequence[Sequence[object]], columns: Sequence[str]) -> DataFrame:
    """A frame of literal rows (strings, numbers, booleans)."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
