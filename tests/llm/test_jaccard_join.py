import pytest

from support import corpus, documents, empty, word_list
from tidemark.llm.jaccard_join import join_region, near_duplicates, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w.translate(LOWER) for w in word_list(text)]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, text) -> (doc_id, n_shingles, component_id), all pairs."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 80 * (len(x) + len(sets[j]) - both) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    named = {}
    for (doc, _), p in zip(rows, part):
        if doc is not None:
            named[p] = min(doc, named.get(p, doc))
    return sorted(((doc, len(s), named.get(p) if s else doc) for (doc, _), s, p in zip(rows, sets, part)), key=str)


@pytest.mark.parametrize("cap", [1_000_000, 150])
def test_equals_all_pairs(spark, cap):
    docs = documents(spark, corpus(160, seed=5)).repartition(5)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = near_duplicates(docs, cap).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sum(w[0] != w[2] for w in want) > 20


def test_chain_of_copies_above_the_region_cap(spark):
    """A group whose ends share little: every text differs from the next by two words."""
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words[(7 * i) % 80] = f"n{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = near_duplicates(docs, 200).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert len({w[2] for w in want}) < 30


def test_one_of_each(spark):
    docs = documents(spark, corpus(100, seed=9))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for d, n, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if n and c is not None}
    got = [r["doc_id"] for r in kept.collect() if shingles(r["text"]) and r["doc_id"] is not None]
    assert sorted(got) == sorted(want)
    blank = lambda df: sorted(str(r["doc_id"]) for r in df.collect() if not shingles(r["text"]))
    assert blank(kept) == blank(docs)


def test_empty_and_wordless_tables(spark):
    assert near_duplicates(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " \n"), (2, " \n")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(blank).select("doc_id", "n_shingles", "component_id").collect())) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    assert one_of_each(blank).count() == 3


def test_region_join_uses_true_sizes():
    import numpy as np

    # Tokens nobody shares are left out of the lists but count in the sizes.
    lists = [np.arange(8), np.arange(8), np.arange(8)]
    assert join_region(np.array([1, 2, 3]), np.array([8, 10, 11]), lists) == [(1, 2)]


@pytest.mark.parametrize("repeat", [1, 2])
def test_rows_without_words_stay_whether_or_not_others_repeat(spark, repeat):
    rows = [(1, "one text of some words here")] * repeat + [(2, ""), (2, ""), (None, None), (None, None), (3, " \n"), (3, " \n")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], *rows[repeat:]], key=str)
