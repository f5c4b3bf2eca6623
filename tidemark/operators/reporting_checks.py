"""Checks of the reporting marts against their sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.quality import stacked


def _profile(df: DataFrame, **measures: Column) -> Column:
    """Several totals of one frame as a struct, from one aggregate."""
    return df.agg(F.struct(*[F.coalesce(m, F.lit(0)).cast("decimal(28,2)").alias(k) for k, m in measures.items()])).scalar()


def reporting_checks(spec: dict[str, tuple[DataFrame, dict[str, Column]]], checks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Compare named totals.  ``spec`` profiles each frame once; a check is (name, observed, expected) with ``frame.total`` paths."""
    frames = {k: _profile(df, **measures) for k, (df, measures) in spec.items()}
    first = next(iter(spec.values()))[0]
    one = first.agg(F.count(F.lit(1)).alias("__n")).withColumns({k: v for k, v in frames.items()})
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(o).alias("observed_value"),
                              (F.col(e) if "." in e else F.lit(e).cast("decimal(28,2)")).alias("expected_value")) for n, o, e in checks])
    gap = F.abs(F.col("observed_value") - F.col("expected_value"))
    return one.select(F.inline(rows)).select(
        "check_name", F.col("observed_value").cast("double").alias("observed_value"), F.col("expected_value").cast("double").alias("expected_value"),
        gap.cast("double").alias("gap"), (gap == 0).alias("passed"))


def rate_bounds(marts: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows with any rate outside [0, 1], per mart."""
    out = []
    for name, (df, rates) in marts.items():
        bad = reduce(lambda a, b: a | b, [F.coalesce((F.col(r) < 0) | (F.col(r) > 1), F.lit(False)) for r in rates])
        out.append(df.agg(F.count_if(bad).alias("violation_count")).select(F.lit(name).alias("mart"), "violation_count"))
    return stacked(out)


def retention_consistency(base: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Retained implies eligible at every horizon."""
    rows = F.array(*[F.struct(F.lit(n).alias("horizon_days"), F.count_if(F.col(f"retained_d{n}") & ~F.col(f"eligible_d{n}")).alias("violation_count")) for n in horizons])
    return base.agg(rows.alias("r")).select(F.inline("r"))


def cutoff_exact(events: DataFrame, cutoffs: DataFrame, lineage: Sequence[str]) -> DataFrame:
    """One cutoff per build, equal to its latest event."""
    latest = events.groupBy(*lineage).agg(F.max("occurred_at").alias("latest"))
    recorded = cutoffs.groupBy(*lineage).agg(F.count(F.lit(1)).alias("cutoff_rows"), F.max("observation_cutoff_at").alias("cutoff"))
    good = F.coalesce((F.col("cutoff_rows") == 1) & (F.col("cutoff") == F.col("latest")), F.lit(False))
    return latest.join(recorded, list(lineage), "left").agg(
        F.count(F.lit(1)).alias("build_count"), F.count_if(~good).alias("violation_count"), F.bool_and(good).alias("passed"))
