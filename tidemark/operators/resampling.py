"""Exact resampling of rows through counts per distinct value: multinomial (bootstrap) and hypergeometric (permutation) draws.

A population is a table of distinct values with their numbers of rows.  Values are hashed to 60 bits and so are the leaves of a binary
trie.  A replicate's sample size flows from the root to the leaves: at each fork the left side's share is one binomial or hypergeometric
draw, by the inverse of its distribution function from a uniform that is a hash of (salt, fork, replicate).  The draws of a replicate sum
to its size exactly, no row is grouped with others at random, and the work is (distinct values) x (replicates), however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 60
#: Bits that part the trie in two levels: subtrees are dealt to tasks, none holds more than its share of the values.
TOP = 12
#: Replicates that are drawn side by side.
CHUNK = 1_000
#: Sums held back by a task before it hands them on.
HELD = 2_000

# Multipliers of the splitmix64 generator.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def hashed(*parts: Column | str) -> Column:
    """60 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS // 4), 16, 10).cast("long")


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def uniforms(salt: int, fork: int, replicates: np.ndarray) -> np.ndarray:
    """One draw in (0, 1) per replicate, from 53 bits."""
    start = mixed(np.array([(salt ^ fork) & (2**64 - 1)], np.uint64))
    z = mixed(start + replicates.astype(np.uint64) * np.uint64(GAMMA))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def left_share(with_replacement: bool, u: np.ndarray, total: int, left: int, drawn: np.ndarray) -> np.ndarray:
    """How many of ``drawn`` rows fall to the left side, which holds ``left`` of ``total`` rows: least k whose probability of at most k
    reaches u.

    Probabilities are built from the ratios of neighbours and scaled by their sum, over the stretch outside which less than 1e-14 lies.
    """
    q = drawn.astype(float)
    share = left / total
    mean = q * share
    if with_replacement:
        low, high, spread = np.zeros_like(q), q, np.sqrt(mean * (1 - share))
    else:
        low, high = np.maximum(0.0, q - (total - left)), np.minimum(float(left), q)
        spread = np.sqrt(mean * (1 - share) * (total - q) / max(total - 1, 1))
    low, high = np.maximum(low, np.floor(mean - 8 * spread - 8)), np.minimum(high, np.ceil(mean + 8 * spread + 8))
    out = low.copy()
    width = (high - low).astype(int)
    order = np.argsort(width, kind="stable")[np.sort(width).searchsorted(1):]
    at = 0
    while at < len(order):
        wide = int(width[order[-1]]) if len(order) - at < 64 else int(width[order[min(len(order) - 1, at + 255)]])
        now = order[at:at + max(1, 2_000_000 // wide)]
        now = now[width[now] <= wide]
        at += len(now)
        k = low[now, None] + np.arange(wide)
        if with_replacement:
            ratio = (q[now, None] - k) / (k + 1) * (share / (1 - share))
        else:
            ratio = (left - k) * (q[now, None] - k) / ((k + 1) * (total - left - q[now, None] + k + 1))
        ratio[k >= high[now, None]] = 0
        below = np.cumsum(np.concatenate([np.ones((len(now), 1)), np.cumprod(ratio, 1)], 1), 1)
        out[now] += (below < u[now, None] * below[:, -1:]).sum(1)
    return np.minimum(out, high).astype(np.int64)


def flow(with_replacement: bool, salt: int, keys: list[int], counts: list[int], drawn: np.ndarray, replicates: np.ndarray, shift: int = 0) -> np.ndarray:
    """Weights (values x replicates) of sorted keys; ``shift`` low bits of every key are left out of them."""
    before = np.concatenate([[0], np.cumsum(np.array(counts, object))])
    weights = np.zeros((len(keys), len(drawn)), np.int64)
    forks = [(0, len(keys), drawn)]
    while forks:
        a, b, q = forks.pop()
        if b - a == 1:
            weights[a] = q
            continue
        if not q.any():
            continue
        differ = (keys[a] ^ keys[b - 1]).bit_length()
        if differ:
            middle = int(np.searchsorted(np.array(keys[a:b]), (keys[b - 1] >> (differ - 1)) << (differ - 1))) + a
            # The bits above the fork behind a leading one: no two forks of a trie share it.
            fork = 1 << (BITS - shift - differ) | keys[a] >> differ
        else:  # equal hashes of different values
            middle, fork = a + 1, 1 << 62 | (b - a) << 44 | keys[a] >> 16
        k = left_share(with_replacement, uniforms(salt, fork, replicates), int(before[b] - before[a]), int(before[middle] - before[a]), q)
        forks.append((a, middle, k))
        forks.append((middle, b, q - k))
    return weights


def _deal(with_replacement: bool, replicates: int):
    """(group, salt, drawn, subtrees, chunk) -> (group, salt, subtree, chunk, quotas)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.arange(row["chunk"] * CHUNK, min(replicates, (row["chunk"] + 1) * CHUNK))
                tops = row["subtrees"]
                weights = flow(with_replacement, row["salt"], [t["top"] for t in tops], [t["n"] for t in tops], np.full(len(ids), row["drawn"]), ids, BITS - TOP)
                yield pa.RecordBatch.from_pylist([
                    {"g": row["g"], "salt": row["salt"], "top": t["top"], "chunk": row["chunk"], "quotas": w} for t, w in zip(tops, weights.tolist())],
                    pa.schema([("g", pa.string()), ("salt", pa.int64()), ("top", pa.int64()), ("chunk", pa.int32()), ("quotas", pa.list_(pa.int64()))]))

    return run


def _weigh(with_replacement: bool, measures: Sequence[str]):
    """(group, salt, top, chunk, quotas, leaves) -> per replicate what this task's values add: drawn rows and weighted measures."""
    schema = pa.schema([("g", pa.string()), ("replicate", pa.int64()), ("drawn", pa.int64()), *((m, pa.float64()) for m in measures)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (g, chunk), s in sorted(sums.items()):
                ids = np.arange(s.shape[1]) + chunk * CHUNK
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(ids)), pa.array(ids), pa.array(s[0].astype(np.int64)), *(pa.array(x) for x in s[1:])], schema=schema)
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                leaves, q = row["leaves"], np.array(row["quotas"], np.int64)
                ids = np.arange(len(q)) + row["chunk"] * CHUNK
                w = flow(with_replacement, row["salt"], [x["key"] for x in leaves], [x["n"] for x in leaves], q, ids)
                values = np.array([[x[m] for x in leaves] for m in measures], float).reshape(len(measures), len(leaves))
                add = np.concatenate([w.sum(0)[None].astype(float), values @ w])
                at = row["g"], row["chunk"]
                sums[at] = sums[at] + add if at in sums else add
                if len(sums) > HELD:
                    yield from out()
        yield from out()

    return run


def resampled_sums(
    values: DataFrame, group: Sequence[str], value: Sequence[str], measures: Sequence[str], drawn: DataFrame, replicates: int, salt: str, with_replacement: bool,
) -> DataFrame:
    """``values``: distinct values per group with columns n (rows) and the measures of one row; ``drawn``: (group, drawn), the sample size.

    Returns (group, replicate, drawn, measures): per replicate the sample size, as requested, and the sums of the measures over the sample.
    With replacement each replicate draws independently, else without putting back.  Sums are double, exact for integers below 2^53.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    key = hashed(F.lit("value"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in value])
    leaf = F.struct(key.alias("key"), "n", *[F.col(m).cast("double").alias(m) for m in measures])
    subtrees = values.where("n > 0").groupBy(g.alias("g"), F.shiftright(key, BITS - TOP).alias("top")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(leaf)).alias("leaves"))
    roots = subtrees.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("top", "n"))).alias("subtrees")).join(
        drawn.select(g.alias("g"), F.col("drawn").cast("long").alias("drawn")), "g")
    chunks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // CHUNK)))
    dealt = roots.select("g", hashed(F.lit(salt), "g").alias("salt"), "drawn", "subtrees", chunks.alias("chunk")).repartition(tasks, "g", "chunk").mapInArrow(
        _deal(with_replacement, replicates), "g string, salt long, top long, chunk int, quotas array<long>")
    # Few bytes but much work: dealt out by number, so that adaptive execution does not gather it in one task.
    work = dealt.join(subtrees.select("g", "top", "leaves"), ["g", "top"]).repartition(tasks, "g", "top", "chunk")
    sums = work.mapInArrow(_weigh(with_replacement, measures), "g string, replicate long, drawn long, " + ", ".join(f"`{m}` double" for m in measures))
    total = sums.groupBy("g", "replicate").agg(F.sum("drawn").alias("drawn"), *[F.sum(m).alias(m) for m in measures])
    fields = ", ".join(f"`{c}` {dict(values.dtypes)[c]}" for c in group)
    back = F.from_json("g", fields) if group else None
    return total.select(*([back.alias("__g")] if group else []), "replicate", "drawn", *measures).select(
        *[F.col(f"__g.{c}").alias(c) for c in group], "replicate", "drawn", *measures)
