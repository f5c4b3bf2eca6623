import math

from pyspark.sql import functions as F

from support import corpus, documents, empty, word_list
from tidemark.llm.mixing import WEIGHTS, mix_sources, mixed_documents


def targets(sizes):
    """Water filling by hand: sources in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in above}


def test_targets_and_taken_words(spark):
    docs = documents(spark, corpus(400, seed=2))
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(word_list(r["text"]))
    want = targets(sizes)
    decided = mix_sources(docs)[0].collect()
    assert sum(r["n"] for r in decided) == len(rows)
    largest = max(r["size"] * r["n"] for r in decided)
    for source, target in want.items():
        own = [r for r in decided if r["source"] == source]
        assert all(math.isclose(r["target"], target, rel_tol=1e-9) and r["source_size"] == sizes[source] for r in own)
        assert abs(sum(r["size"] * r["copies"] * r["n"] for r in own) - target) <= largest / 2 + 1e-6
    assert all(0 <= r["copies"] <= 2 for r in decided)
    again = mix_sources(docs.repartition(11))[0].collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"])
    assert sorted((key(r), r["copies"]) for r in decided) == sorted((key(r), r["copies"]) for r in again)


def test_tree_of_several_levels_keeps_the_words(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"),
                                     F.when(F.col("id") % 9 == 0, "a").when(F.col("id") % 9 < 4, "b").otherwise("c").alias("source"))
    got = mix_sources(docs)[0].groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
    assert len(got) == 3
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 20.5, r


def test_copies_of_documents(spark):
    docs = documents(spark, corpus(80, seed=4))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    decided = {(r["doc_id"], r["source"], r["size"]): r["copies"] * r["n"] for r in mix_sources(docs)[0].collect()}
    got = {}
    for r in out.collect():
        k = (r["doc_id"], r["source"], len(word_list(r["text"])))
        got[k] = got.get(k, 0) + 1
    assert got == {k: c for k, c in decided.items() if c}


def test_empty_tables(spark):
    assert mix_sources(empty(spark))[0].count() == 0
    assert mixed_documents(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["copies"] for r in mix_sources(blank)[0].collect()] == [0, 0]
