import random

import numpy as np
import pytest

from support import corpus, documents, empty, word_list
from tidemark.llm.packing import best_fit, cheapest, pack_documents, places, plan


def check(rows, capacities, words):
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start_word"], r["n_words"]))
    for held in bins.values():
        held.sort(key=lambda r: r["bin_start"])
        at = 0
        for r in held:
            assert r["bin_start"] == at
            at += r["n_words"]
        assert all(r["filled"] == at for r in held) and {r["capacity"] for r in held} == {min(c for c in capacities if c >= at)}
    assert sum(r["n_words"] for r in rows) == words
    return sum(h[0]["capacity"] for h in bins.values())


def test_every_word_is_packed_once(spark):
    docs = documents(spark, corpus(200))
    total = sum(len(word_list(r["text"])) for r in docs.collect())
    for shard in (20_000, 20):
        rows = pack_documents(docs, (64, 128, 512), shard).collect()
        assert check(rows, (64, 128, 512), total) < 1.05 * total + 512
    longest = sorted((r["piece"], r["start_word"], r["n_words"]) for r in rows if r["doc_id"] == 200)
    assert [p[1] for p in longest] == [512 * i for i in range(len(longest))] and sum(p[2] for p in longest) == 9_000


def test_best_fit_against_first_principles():
    rng = random.Random(1)
    items = [(rng.randint(1, 100), str(i)) for i in range(300)]
    bins = best_fit(items, (50, 100))
    assert sorted(i for _, _, held in bins for i in held) == sorted(items)
    assert all(sum(i[0] for i in held) == filled <= capacity for capacity, filled, held in bins)
    assert all(capacity == 50 or filled > 50 for capacity, filled, _ in bins)
    assert best_fit([], (50,)) == [] and best_fit(items, (50, 100)) == best_fit(items[::-1], (50, 100))


def test_empty_table(spark):
    assert pack_documents(empty(spark)).count() == 0


def one_by_one(sizes, capacities):
    """Best fit of single pieces -> sorted (capacity, filled) of the bins; a size chooses its bins once, when it first needs one."""
    bins, chosen, ordered = [], {}, sorted(sizes, reverse=True)
    for i, size in enumerate(ordered):
        fits = [b for b in bins if b[0] - b[1] >= size]
        if fits:
            into = min(fits, key=lambda b: b[0] - b[1])
        else:
            if size not in chosen:
                left = sum(s == size for s in ordered[i:])
                smaller = np.cumsum([s * ordered.count(s) if s < size else 0 for s in range(size + 1)])
                chosen[size] = cheapest(size, left, smaller, sum(c - f for c, f in bins), capacities)
            bins.append(into := [chosen[size], 0])
        into[1] += size
    return sorted((min(c for c in capacities if c >= filled), filled) for _, filled in bins)


def test_counts_pack_as_single_pieces_do():
    rng = random.Random(2)
    for trial in range(60):
        sizes = [rng.choice((rng.randint(1, 100), 30, 51)) for _ in range(rng.randint(1, 400))]
        assert sorted((c, f) for c, f, _ in best_fit([(s, str(i)) for i, s in enumerate(sizes)], (50, 100, 128))) == one_by_one(sizes, (50, 100, 128)), trial


@pytest.mark.parametrize("size, share", [(300, 0.9), (520, 0.85), (1_400, 0.68), (2_100, 0.51), (4_096, 1.0), (40, 0.97)])
def test_bins_are_chosen_for_all_that_is_to_be_packed(size, share):
    """Many equal pieces fill the bins about as well as their size permits."""
    bins = best_fit([(size, str(i)) for i in range(2_000)], (512, 1024, 2048, 4096))
    assert sum(f for _, f, _ in bins) / sum(c for c, _, _ in bins) >= share
    # Small pieces that can fill the rest are counted on.
    bins = best_fit([(size, str(i)) for i in range(300)] + [(5, f"s{i}") for i in range(250_000)], (512, 1024, 2048, 4096))
    assert sum(f for _, f, _ in bins) / sum(c for c, _, _ in bins) > 0.98


def test_work_does_not_grow_with_the_pieces_of_a_size():
    counts = {300: 10**12, 2_100: 10**12 + 1, 1_400: 7, 5: 10**13}
    runs, bins = plan(counts, (512, 1024, 2048, 4096))
    assert len(runs) < 20 and len(bins) < 20
    last = sum(counts.values()) - 1
    index, at, capacity, filled = (int(v[0]) for v in places(np.array([last]), runs, bins))
    assert at + 5 <= filled <= capacity


def test_equal_sizes_are_packed_whole_in_every_shard(spark):
    rows = [(i, " ".join(["w"] * (300 if i % 3 else 40 + i % 7))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = [len(t.split()) for _, t in rows]
    for shard in (20_000, 20):
        got = pack_documents(docs, shard=shard).collect()
        check(got, (512, 1024, 2048, 4096), sum(sizes))
        assert sorted({r["bin_id"]: (r["capacity"], r["filled"]) for r in got}.values()) == one_by_one(sizes, (512, 1024, 2048, 4096))
