"""Orders and counts over event histories where many rows share a user, a moment or a score."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import ordered_prefix
from tidemark.operators import events as ev, scoring

START = datetime(2024, 1, 1)


def test_one_user_with_many_intervals_and_events(spark):
    rng = random.Random(4)
    moments = [START + timedelta(seconds=rng.randrange(200_000)) for _ in range(3_000)]
    spans = [(i, 1, a, a + timedelta(seconds=rng.randrange(90_000))) for i, a in enumerate(START + timedelta(seconds=rng.randrange(200_000)) for _ in range(2_000))]
    spans += [(9_000, 2, START, START), (9_001, 1, moments[0], moments[0]), (9_002, 1, START - timedelta(1), START + timedelta(9))]
    events = spark.createDataFrame([(1, m) for m in moments] + [(None, START)], "user_id long, occurred_at timestamp_ntz")
    out = ev.interval_counts(spark.createDataFrame(spans, "interval_id long, user_id long, from_at timestamp_ntz, until_at timestamp_ntz"), events)
    got = {r["interval_id"]: (r["in_interval"], r["up_to_end"]) for r in out.collect()}
    mine = {1: moments, 2: []}
    assert got == {i: (sum(a <= m < b for m in mine[u]), sum(m <= b for m in mine[u])) for i, u, a, b in spans}


def stream(spark, rows):
    return spark.createDataFrame(rows, "occurred_at timestamp_ntz, installation_id long, event_name string, session_id string, feature_name string, source_id long")


def test_all_events_in_one_moment(spark):
    rows = [(START, (i * 7_919) % 50_000, "signup" if i % 3 else "app_install", None, None, i) for i in range(20_000)]
    got = ev.merge_events(stream(spark, rows[:9_000]), stream(spark, rows[9_000:])).orderBy("merged_event_id").collect()
    assert [r["merged_event_id"] for r in got] == list(range(1, 20_001))
    key = lambda r: (r[1], ev.PRIORITY.index(r[2]), r[5])
    assert [r["source_id"] for r in got] == [r[5] for r in sorted(rows, key=key)]


def test_unknown_event_names_are_refused(spark):
    with pytest.raises(PySparkException, match="unknown event name"):
        ev.merge_events(stream(spark, [(START, 1, "nonsense", None, None, 1)])).collect()


def test_layered_prefix_equals_a_running_sum(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(100), i, rng.randrange(5)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g int, t int, i int, n int")
    out = ordered_prefix(df, [F.col("t"), F.col("i")], [F.floor(F.col("t") / 10), F.col("t"), F.floor(F.col("i") / 100)], {"s": F.col("n")}, ["g"])
    total, want = {}, {}
    for g, t, i, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total[g] = total.get(g, 0) + n
        want[i] = total[g]
    assert {r["i"]: r["s"] for r in out.collect()} == want


def test_text_keys_rank_like_numbers(spark):
    rows = [(f"sub_{(i * 37) % 500:06d}", 0.1 * (i % 4), i % 2) for i in range(500)]
    got = scoring.score_rank(spark.createDataFrame(rows, "subscription_id string, p double, label int")).collect()
    assert {r["subscription_id"]: r["rank"] for r in got} == {k: n for n, (_, k) in enumerate(sorted((p, k) for k, p, _ in rows), 1)}
