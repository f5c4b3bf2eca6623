import random

import pytest

from tidemark.llm.graph import components, contractions


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1_000, 1_300)] + [(5_000, i) for i in range(5_001, 5_400)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    part = {}

    def root(v):
        while part.setdefault(v, v) != v:
            v = part[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            part[max(x, y)] = min(x, y)
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        assert r["node"] not in got
        got[r["node"]] = r["root"]
    assert set(got) == set(part)
    names = {}
    for node, label in got.items():
        assert names.setdefault(label, root(node)) == root(node) and root(label) == root(node)
    assert len(names) == len({root(v) for v in part})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", ["rising", "shuffled"])
def test_a_long_chain_takes_few_rounds(spark, order):
    names = list(range(1_001))
    if order == "shuffled":
        random.Random(1).shuffle(names)
    chain = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    rounds = contractions(chain)
    assert len(rounds) <= 10
    assert [r.count() for r in rounds][0] == 1_001 and rounds[1].count() < 450
    assert components(chain).select("root").distinct().count() == 1


def test_a_large_star_takes_one_round(spark):
    star = spark.range(1, 100_001).selectExpr("0L AS a", "id AS b")
    assert len(contractions(star)) <= 2
    assert components(star).select("root").distinct().count() == 1 and components(star).count() == 100_001
