"""Best-fit packing into several permitted sequence lengths, on the counts of pieces per size."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.mixing import n_words
from tidemark.llm.store import stage

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces per shard, at most: a piece's number among those of its size is counted in shards.
SHARD = 20_000
#: Price of a bin: its capacity and a fixed part, so that one long bin is cheaper than several short ones as full; prices are per word held.
FIXED = 32


def cheapest(size: int, left: int, smaller: np.ndarray, spare: int, capacities: tuple[int, ...]) -> int:
    """The bin size of least price per word for ``left`` pieces of a size, with all that is still to be packed in view.

    ``smaller[r]`` are the words in smaller pieces of at most r words, ``spare`` the room in bins that are open already and take of them first.
    A bin holds as many pieces as it can and shares what smaller pieces can fill of the rest evenly with its like; its price is that
    of the permitted size it then shrinks to.  Equal prices go to the larger bin: fewer bins.
    """
    def price(c: int) -> tuple[float, int]:
        per = min(c // size, left)
        bins, rest = -(-left // per), c - per * size
        more = max(0, int(smaller[min(rest, size - 1)]) - spare) / bins
        filled = per * size + min(rest, more)
        return (min(x for x in capacities if x >= filled) + FIXED) / filled, -c

    return min((c for c in capacities if c >= size), key=price)


def plan(counts: dict[int, int], capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Best fit of ``counts[size]`` pieces per size, as counts -> runs and bins.

    Largest first, each into the open bin it leaves the least room in; where none has room the least-cost bin opens; in the end
    each bin shrinks to the least capacity that holds its contents.  A bin takes all it can of a size before the next bin gets any,
    so bins that are alike are handled as one range of bin numbers: the work grows with the distinct sizes, not with the pieces.
    runs, in order of pieces by falling size: (first piece, first bin, pieces per bin, words before, size).
    bins, in order: (first bin, capacity, filled).
    """
    runs: list[tuple] = []
    room: list[tuple[int, int, int, int]] = []  # (free, first bin, bins, filled), sorted
    full: list[tuple[int, int]] = []  # (first bin, filled) of bins without room
    opened = piece = spare = 0
    words = np.zeros(max(counts, default=0) + 1, np.float64)
    for size, n in counts.items():
        words[size] = float(size) * n
    smaller = np.cumsum(words)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(room, (size,))
            if at < len(room):
                free, first, bins, filled = room.pop(at)
                spare -= free * bins
            else:
                free = cheapest(size, left, smaller, spare, capacities)
                first, bins, filled = opened, -(-left // (free // size)), 0
                opened += bins
            each = free // size
            for n, per in ((min(bins, left // each), each), (1, left % each)):
                # Whole bins first; the rest of the pieces, where a bin is left for them, into one more.
                if n and per and bins and left:
                    runs.append((piece, first, per, filled, size))
                    piece, left = piece + n * per, left - n * per
                    rest = (free - per * size, first, n, filled + per * size)
                    if rest[0]:
                        insort(room, rest)
                        spare += rest[0] * n
                    else:
                        full.append((first, rest[3]))
                    first, bins = first + n, bins - n
            if bins:
                insort(room, (free, first, bins, filled))
                spare += free * bins
    ends = sorted(full + [(first, filled) for _, first, _, filled in room])
    shrunk = [(first, min(c for c in capacities if c >= filled), filled) for first, filled in ends]
    return np.array(runs, np.int64).reshape(-1, 5), np.array(shrunk, np.int64).reshape(-1, 3)


def places(number: np.ndarray, runs: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers of pieces, by falling size -> (bin, at, capacity, filled)."""
    first, bin0, per, before, size = runs[np.searchsorted(runs[:, 0], number, side="right") - 1].T
    index = bin0 + (number - first) // per
    _, capacity, filled = bins[np.searchsorted(bins[:, 0], index, side="right") - 1].T
    return index, before + (number - first) % per * size, capacity, filled


def best_fit(items: list[tuple], capacities: tuple[int, ...]) -> list[tuple[int, int, list[tuple]]]:
    """items (size, ...) -> bins (capacity, filled, items)."""
    ordered = sorted(items, key=lambda x: (-x[0], *map(str, x[1:])))
    index, _, capacity, filled = places(np.arange(len(ordered)), *plan(Counter(i[0] for i in ordered), capacities))
    bins: dict[int, tuple[int, int, list[tuple]]] = {}
    for item, b, c, f in zip(ordered, index.tolist(), capacity.tolist(), filled.tolist()):
        bins.setdefault(b, (c, f, []))[2].append(item)
    return [bins[b] for b in sorted(bins)]


def place(runs: np.ndarray, bins: np.ndarray, starts: dict[int, int], names: list[str]):
    """Rows (doc_id, piece, start_word, n_words, nth of its size) -> the same without the last, and their bin."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array(sorted(starts), np.int64)
        at = np.array([starts[s] for s in sizes.tolist()], np.int64)
        for batch in batches:
            number = at[np.searchsorted(sizes, batch.column(3).to_numpy())] + batch.column(4).to_numpy()
            index, *rest = places(number, runs, bins)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(map(str, index.tolist()), pa.string()), *(pa.array(r) for r in rest)], names=names)

    return run


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start_word, n_words, bin_id, bin_start, capacity, filled.

    A document longer than the largest capacity is cut into pieces of it and a rest, words in order.  Every word is in one bin; a
    bin never holds more than its capacity, and no smaller permitted capacity would hold it.  The driver packs the counts of
    pieces per size, at most as many as the largest capacity has words, over the whole table at once; tasks only number the
    pieces of a size, in shards dealt by hash, and look up their places.  So equal sizes are no group in any task, and
    nothing is lost where shards meet.  Documents without words have no piece.  Rows that share a doc_id are packed each on its own;
    a null doc_id stays null.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words("text").alias("words"), F.monotonically_increasing_id().alias("row")).where("words > 0")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / most))))
    pieces = stage(pieces.select("doc_id", "piece", (F.col("piece") * most).alias("start_word"), F.least(F.col("words") - F.col("piece") * most, F.lit(most)).cast("long").alias("n_words"), "row"), "pieces")
    # At least as many shards as tasks, so that a hot size of a small table is spread too.
    shards = max(-(-pieces.count() // shard), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    held = stage(dealt.groupBy("shard", "n_words").agg(F.count("*").alias("held")), "held")
    counts = {r["n_words"]: r["n"] for r in held.groupBy("n_words").agg(F.sum("held").alias("n")).collect()}
    starts, total = {}, 0
    for size in sorted(counts, reverse=True):
        starts[size], total = total, total + counts[size]
    before = Window.partitionBy("n_words").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    skips = held.select("shard", "n_words", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("skip"))
    inside = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "n_words").orderBy("row", "piece")) - 1)
    numbered = inside.join(skips, ["shard", "n_words"]).select("doc_id", "piece", "start_word", "n_words", (F.col("skip") + F.col("nth")).alias("nth"))
    fields = ["doc_id", "piece", "start_word", "n_words", "bin_id", "bin_start", "capacity", "filled"]
    return numbered.mapInArrow(place(*plan(counts, capacities), starts, fields), ", ".join(f"{f} {'string' if f == 'bin_id' else 'long'}" for f in fields))
