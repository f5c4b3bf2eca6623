"""Isotonic blocks against the max-min formula and Spark's own fit."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tidemark.operators.isotonic import isotonic_blocks, isotonic_scores, pool


def sample(spark, n=600, seed=1, digits=3):
    r = random.Random(seed)
    rows = [(i, p := round(r.random(), digits), int(r.random() < p * p)) for i, _ in enumerate(range(n))]
    return rows, spark.createDataFrame([*rows, (n, None, 1), (n + 1, 0.5, None)], "subscription_id long, p double, label int")


def brute(rows):
    """Fitted rate per distinct score: greatest over starts of the least mean over ends."""
    points = sorted({p for _, p, _ in rows})
    count = {p: [sum(y for _, q, y in rows if q == p), sum(q == p for _, q, _ in rows)] for p in points}
    means = [[sum(count[q][0] for q in points[j:k + 1]) / sum(count[q][1] for q in points[j:k + 1]) if k >= j else None for k in range(len(points))] for j in range(len(points))]
    return {points[i]: max(min(means[j][i:]) for j in range(i + 1)) for i in range(len(points))}


@pytest.mark.parametrize("partitions", [1, 20])
def test_blocks_equal_the_formula(spark, partitions):
    rows, df = sample(spark, 200, digits=2)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = [r.asDict() for r in isotonic_blocks(df).orderBy("lo").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    wanted = brute(rows)
    for p, value in wanted.items():
        inside = [b for b in blocks if b["lo"] <= p <= b["hi"]]
        assert len(inside) == 1 and inside[0]["value"] == pytest.approx(value)
    assert [b["value"] for b in blocks] == sorted({b["value"] for b in blocks}) and sum(b["n"] for b in blocks) == 200


def test_scores_equal_sparks_isotonic_regression(spark):
    _, df = sample(spark)
    known = df.dropna()
    model = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="q").fit(known.withColumn("label", F.col("label").cast("double")))
    grid = spark.range(2_003).select(F.col("id").alias("subscription_id"), ((F.col("id") - 1) / 2_000.0).alias("p"))
    theirs = {r.subscription_id: r.q for r in model.transform(grid).collect()}
    for r in isotonic_scores(grid, isotonic_blocks(df)).collect():
        assert r.q == pytest.approx(theirs[r.subscription_id], abs=1e-9), r.p


def test_edges(spark):
    one = spark.createDataFrame([(1, 0.4, 1), (2, 0.6, 0)], "subscription_id long, p double, label int")
    assert [(r.lo, r.hi, r.value) for r in isotonic_blocks(one).collect()] == [(0.4, 0.6, 0.5)]
    assert {r.q for r in isotonic_scores(one, isotonic_blocks(one)).collect()} == {0.5}
    none = isotonic_blocks(one.where("false"))
    assert none.count() == 0 and [r.q for r in isotonic_scores(one, none).collect()] == [None, None]
    assert pool([(0.1, 0.1, 0, 3), (0.2, 0.2, 0, 1), (0.3, 0.3, 1, 1), (0.4, 0.4, 1, 2)]) == [(0.1, 0.2, 0, 4), (0.3, 0.4, 2, 3)]
