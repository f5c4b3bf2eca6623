import hashlib

from pyspark.sql import functions as F

from support import corpus, documents, empty
from tidemark.llm.line_dedup import BLANK, LAST, dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or (LAST if doc is None else doc) == min(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force_with_awkward_rows(spark):
    docs = documents(spark, corpus())
    done = dedup_lines(docs)
    assert done.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    got = done.select("doc_id", "__n_lines", "__n_dropped", F.sha2("text", 256)).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert sum(w[2] for w in want) > 20


def test_a_line_in_every_document_spans_ranges(spark):
    rows = [(i, f"the line that everybody has\nown line number {i} here\nthe line that everybody has") for i in range(3_000)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).select("doc_id", "__n_dropped").collect()
    assert {r["doc_id"]: r["__n_dropped"] for r in got} == {i: 0 if i == 0 else 2 for i in range(3_000)}


def test_empty_table(spark):
    assert dedup_lines(empty(spark)).count() == 0
