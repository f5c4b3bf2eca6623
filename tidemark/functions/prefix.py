"""Running totals and ranks over a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered_prefix(
    df: DataFrame,
    order: list[Column],
    bucket: list[Column],
    measures: dict[str, Column],
    within: list[str] | None = None,
) -> DataFrame:
    """Add one inclusive running sum per measure along ``order``, separately per ``within`` key.

    A plain window would put each ``within`` group (or, without one, the whole table) into one task.
    Here ``bucket`` is a tuple of columns monotone in ``order``: rows are aggregated per bucket, the
    bucket table gets exclusive prefix sums, and only (within, bucket) slices are windowed.  With several columns the first
    is the coarse part: buckets are summed inside it, and only the table of coarse parts is windowed as a whole.  A hot key is
    therefore spread over as many tasks as it has buckets.  ``bucket`` values come from the data, so a
    recomputed task lands on the same slice.
    """
    # One struct key per slice: it is never NULL itself, NULL fields compare equal, and the window, the totals and
    # the join all use it, so the rows are shuffled exactly once.
    group = F.struct(*within) if within else F.lit(0)
    tagged = df.select("*", F.struct(group.alias("g"), F.struct(*[b.alias(f"b{i}") for i, b in enumerate(bucket)]).alias("b")).alias("__k"),
                       *[m.alias(f"__m_{k}") for k, m in measures.items()])
    totals = tagged.groupBy("__k").agg(*[F.sum(f"__m_{k}").alias(f"__t_{k}") for k in measures])
    offsets = _before(totals, measures, bool(within), len(bucket) > 1)
    inside = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(f"__m_{k}").over(inside).alias(f"__l_{k}") for k in measures])
    joined = local.join(offsets, F.col("__k") == F.col("__j"))
    return joined.select(*df.columns, *[(F.col(f"__l_{k}") + F.col(f"__o_{k}")).alias(k) for k in measures])


def _before(totals: DataFrame, measures: dict[str, Column], grouped: bool, layered: bool) -> DataFrame:
    """Per bucket (__j): what all earlier buckets of its group hold."""
    group = [F.col("__k.g")] if grouped else []

    def earlier(df: DataFrame, parts: list[Column], order: Column, name: str) -> list[Column]:
        window = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(f"__t_{k}").over(window), F.lit(0)).alias(f"{name}_{k}") for k in measures]

    if not layered:
        return totals.select(F.col("__k").alias("__j"), *earlier(totals, group, F.col("__k.b"), "__o"))
    coarse = F.struct(F.col("__k.g").alias("g"), F.col("__k.b.b0").alias("b"))
    fine = totals.withColumn("__c", coarse)
    inner = fine.select(F.col("__k").alias("__j"), "__c", *earlier(fine, [F.col("__c")], F.col("__k.b"), "__f"))
    sums = fine.groupBy("__c").agg(*[F.sum(f"__t_{k}").alias(f"__t_{k}") for k in measures])
    outer = sums.select(F.col("__c").alias("__d"), *earlier(sums, [F.col("__c.g")] if grouped else [], F.col("__c.b"), "__e"))
    return inner.join(outer, F.col("__c") == F.col("__d")).select("__j", *[(F.col(f"__f_{k}") + F.col(f"__e_{k}")).alias(f"__o_{k}") for k in measures])
