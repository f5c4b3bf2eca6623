import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import actives


def events(spark, n=3_000):
    r = random.Random(2)
    rows = [(r.choice([1, 2, 40_000, 10**12, 7 * r.randint(0, 9_000)]), dt.datetime(2024, 1, 25) + dt.timedelta(hours=r.randint(0, 900)), r.choice("ab")) for _ in range(n)]
    rows += [(None, rows[0][1], "a"), (5, None, "a"), *[(1, rows[0][1], "a")] * 500]
    return rows, spark.createDataFrame(rows, "user_id long, at timestamp_ntz, kind string")


def test_every_grain_equals_count_distinct(spark):
    rows, df = events(spark)
    bitmaps = actives.daily_bitmaps(df, "user_id", F.col("at"), ["kind"])
    start = {"day": lambda d: d, "week": lambda d: d - dt.timedelta(days=d.weekday()), "month": lambda d: d.replace(day=1)}
    wanted = {}
    for user, at, kind in rows:
        if user is not None and at is not None:
            for grain, of in start.items():
                wanted.setdefault((kind, grain, of(at.date())), set()).add(user)
    got = {(r.kind, r.grain, r.period_start): r.active_count for r in actives.active_counts(bitmaps, ["kind"]).collect()}
    assert got == {k: len(v) for k, v in wanted.items()}


def test_months_from_weeks_of_bitmaps_are_not_sums(spark):
    _, df = events(spark)
    bitmaps = actives.daily_bitmaps(df, "user_id", F.col("at"))
    months = {r.period_start: r.active_count for r in actives.active_counts(bitmaps, grains=["month"]).collect()}
    days = actives.active_counts(bitmaps, grains=["day"]).groupBy(F.to_date(F.date_trunc("MONTH", "period_start")).alias("m")).agg(F.sum("active_count").alias("n")).collect()
    assert all(r.n > months[r.m] for r in days)


def test_trailing_windows(spark):
    rows, df = events(spark, 400)
    got = {r.period_start: r.active_count for r in actives.trailing_actives(actives.daily_bitmaps(df, "user_id", F.col("at")), 5).collect()}
    by_day = {}
    for user, at, _ in rows:
        if user is not None and at is not None:
            by_day.setdefault(at.date(), set()).add(user)
    assert got == {d: len(set().union(*(v for e, v in by_day.items() if 0 <= (d - e).days < 5))) for d in by_day}
    assert actives.active_counts(actives.daily_bitmaps(df.where("false"), "user_id", F.col("at"))).count() == 0
