import corpus_pipeline
from pyspark.sql import functions as F

from support import word_list
from test_jaccard_join import brute as near_brute
from test_line_dedup import brute as line_brute
from tidemark.llm.packing import CAPACITIES
from test_packing import check as check_bins
from tidemark.llm.store import stage


def test_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "source_mix", "best_fit_packing"]
    out = []
    for name, apply in corpus_pipeline.STAGES:
        out.append(stage(apply(spark, docs, sf_dir), f"test-{name}"))
        docs = out[-1]
    for frame in out[:-1]:
        assert frame.columns == columns
    good, lines, near, mixed, packed = out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) / len(clean) > 0.97
    want = {d: h for d, _, _, h in line_brute([(r["doc_id"], r["text"]) for r in good.collect()])}
    assert {r["doc_id"]: r["h"] for r in lines.select("doc_id", F.sha2("text", 256).alias("h")).collect()} == want
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0
    groups = near_brute([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert {r["doc_id"] for r in near.collect()} == {d for d, n, c in groups if d == c}
    words = {r["doc_id"]: len(word_list(r["text"])) for r in near.collect()}
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= {d for d, n in words.items() if n} and max(copies.values()) <= 2
    total = sum(words[d] * c for d, c in copies.items())
    # Half a document per source at most.
    assert abs(total - 1.5 * sum(words.values())) <= 20 * max(words.values()) / 2
    check_bins(packed.collect(), CAPACITIES, total)


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__

    assert corpus_pipeline.ORACLE_SQL is None and __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
