"""Exact distinct counts that merge: bitmaps of numeric ids per day, or-ed to weeks, months or any window of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

GRAINS = {"day": "DAY", "week": "WEEK", "month": "MONTH"}


def daily_bitmaps(rows: DataFrame, key: str, day: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, day, bucket, bits): the distinct ``key`` values of each day, one bit each, 32,768 ids to a bucket of at most 4 KB.

    Rows without a key or day are left out.  Bits are set per task before anything is shuffled, so a day or key with a third of all rows
    reaches the shuffle as a few buckets.  Ids are whole numbers; far-apart ids cost a bucket each.
    """
    known = rows.where(F.col(key).isNotNull()).withColumn("day", F.to_date(day)).where(F.col("day").isNotNull())
    return known.groupBy(*by, "day", F.bitmap_bucket_number(F.col(key)).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias("bits"))


def merged(bitmaps: DataFrame, period: Column, by: Sequence[str] = (), name: str = "period_start") -> DataFrame:
    """Bitmaps of longer periods from those of days; they merge again."""
    return bitmaps.groupBy(*by, period.alias(name), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(bitmaps: DataFrame, by: Sequence[str], name: str = "active_count") -> DataFrame:
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def active_counts(bitmaps: DataFrame, by: Sequence[str] = (), grains: Sequence[str] = tuple(GRAINS)) -> DataFrame:
    """(by, grain, period_start, active_count) of days, weeks (from Monday) and months, all from the daily bitmaps."""
    out = None
    for grain in grains:
        period = F.col("day") if grain == "day" else F.to_date(F.date_trunc(GRAINS[grain], F.col("day")))
        part = counted(merged(bitmaps, period, by), [*by, "period_start"]).withColumn("grain", F.lit(grain))
        out = part if out is None else out.unionByName(part)
    return out


def trailing_actives(bitmaps: DataFrame, days: int, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ids of the last ``days`` days up to each day that has any (28-day actives, say).

    Each daily bitmap unfolds to the days it still counts for, at most ``days`` of them, however many rows or ids it stands for.
    """
    seen = bitmaps.select(*by, F.col("day").alias("period_start")).distinct()
    until = F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1)))
    reached = bitmaps.select(*by, "bucket", "bits", until.alias("period_start")).join(seen, [*by, "period_start"], "left_semi")
    return counted(reached.groupBy(*by, "period_start", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")), [*by, "period_start"])
