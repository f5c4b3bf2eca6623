"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.store import stage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix takes 3/2 of all words
CAP = 2  # and at most this many times a source
LEAF, FAN = 1_000, 64  # documents of a leaf, residuals that meet in a node above
EXACT = 1e-9

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """sized (source, size, n) -> src, docs, source_size, target, one row per source (src null-safe struct).

    A source's cap is ``CAP`` times its words.  What the caps leave over is reshared by weight among the others until nobody
    is above: the water level ``left / open weight`` is one small aggregate per round over the table of sources.
    """
    per = stage(sized.groupBy(F.struct("source").alias("src")).agg(F.sum("size").alias("source_size"), F.sum("n").alias("docs")), "sources")
    # Code-point order of the distinct names, in two levels so that no task sees all of them.
    ranged = stage(per.repartitionByRange(F.col("src.source").asc_nulls_last()).sortWithinPartitions(F.col("src.source").asc_nulls_last())
                   .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33)), "ranked")
    parts = ranged.groupBy("part").agg(F.count("*").alias("k"))
    before = parts.alias("a").join(parts.select(F.col("part").alias("q"), F.col("k").alias("j")).alias("b"), F.col("q") < F.col("part"), "left")
    before = before.groupBy("part").agg(F.coalesce(F.sum("j"), F.lit(0)).alias("skip"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("skip") + F.col("at"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = stage(ranged.join(before, "part").select("src", "docs", "source_size", weight.cast("long").alias("weight")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped, level = 0, None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * CAP
        taken, open_weight, n = ranked.agg(
            F.sum(F.when(above, F.col("source_size") * CAP).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.sum(above.cast("int"))).first()
        if not open_weight or (level is not None and n == capped):
            break
        capped, level = n, (SHARE[0] * total / SHARE[1] - taken) / open_weight
    target = F.least(F.col("weight") * F.lit(float(level or 0.0)), F.col("source_size") * F.lit(float(CAP)))
    return ranked.select("src", "docs", "source_size", target.alias("target"))


def _pivot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream units sorted by node: hold one fractional unit, move mass between it and the next until one is whole.

    A move keeps the words taken, ``sum(size * frac)``, and each unit's expected copies; the draw is a hash of both
    identities, so reruns agree.  The unit left over at a node's end stays fractional and goes up the tree.
    """
    held = None  # node, ident, size, frac
    for batch in batches:
        nodes, ids, sizes, fracs = (batch.column(n).to_pylist() for n in ("node", "ident", "size", "frac"))
        done_id, done_copy, left = [], [], []
        for node, ident, size, frac in zip(nodes, ids, sizes, fracs):
            if held is not None and held[0] != node:
                left.append(held)
                held = None
            if held is None:
                held = (node, ident, size, frac)
                continue
            _, hid, hsize, hfrac = held
            # Up: the held unit gains a, the new one pays a * hsize / size.  Down: the other way round.
            up = min(1 - hfrac, frac * size / hsize)
            down = min(hfrac, (1 - frac) * size / hsize)
            draw = xxhash.xxh64_intdigest(f"{hid} {ident}".encode()) / 2.0**64
            move = up if draw * (up + down) < down else -down
            hfrac, frac = hfrac + move, frac - move * hsize / size
            for uid, f in ((hid, hfrac), (ident, frac)):
                if f < EXACT or f > 1 - EXACT:
                    done_id.append(uid), done_copy.append(int(f > 0.5))
            h_open, f_open = EXACT <= hfrac <= 1 - EXACT, EXACT <= frac <= 1 - EXACT
            held = (node, hid, hsize, hfrac) if h_open else (node, ident, size, frac) if f_open else None
        yield _units(done_id, done_copy, left)
    if held is not None:
        yield _units([], [], [held])


def _units(ids: list, copies: list, left: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([*ids, *(x[1] for x in left)], pa.string()), pa.array([None] * len(ids) + [x[2] for x in left], pa.int64()),
        pa.array([None] * len(ids) + [x[3] for x in left], pa.float64()), pa.array([None] * len(ids) + [x[0] for x in left], pa.string()),
        pa.array([*copies, *[None] * len(left)], pa.int32())], names=["ident", "size", "frac", "node", "copies"])


def pivotal_rounding(units: DataFrame, widest: int) -> DataFrame:
    """units (ident, group, shard, size, frac) with 0 < frac < 1 -> (ident, copies 0 or 1), exact in each group's words to half a unit.

    Leaves are shards of a group; each sends one residual up and ``FAN`` residuals meet in the node above, ``log(widest)``
    levels in all.  Within a node the largest come first, so that many small units settle the large ones.
    """
    done = []
    while True:
        node = F.concat_ws("/", F.col("shard").cast("string"), F.hex(F.xxhash64("group")), F.hex(F.hash("group")))
        dealt = units.withColumn("node", node).repartition("node").sortWithinPartitions("node", F.desc("size"), "ident")
        out = dealt.select("node", "ident", "size", "frac").mapInArrow(_pivot, "ident string, size long, frac double, node string, copies int")
        out = stage(out, "pivotal")
        done.append(out.where("copies is not null").select("ident", "copies"))
        rest = out.where("copies is null")
        if widest <= 1:
            # One unit per group is left: to the nearer side, half a document off at most.
            done.append(rest.select("ident", (F.col("frac") >= 0.5).cast("int").alias("copies")))
            break
        back = units.select("ident", "group", "shard")
        units = rest.select("ident", "size", "frac").join(back, "ident").withColumn("shard", F.floor(F.col("shard") / FAN))
        widest = -(-widest // FAN)
    every = done[0]
    for part in done[1:]:
        every = every.union(part)
    return every


def mix_sources(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs (doc_id, source, text) -> decisions (doc_id, source, size, source_size, target, copies), and their key columns.

    ``size`` is the number of words.  A source's target divided by its words is the expected copies of each of its documents;
    the whole part is certain, the fraction is rounded by the pivotal method, so that a source's taken words
    miss the target by half a document at most.  Rows equal in the key are one unit and share a decision; documents without
    words are never taken; a null source is a source, the last one.  An empty table gives an empty one.
    """
    keys = ["doc_id", "source", "size"]
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"))
                  .groupBy(*keys).agg(F.count("*").alias("n")), "sized")
    targets = stage(source_targets(sized.select("source", (F.col("size") * F.col("n")).alias("size"), F.col("n"))), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = sized.join(targets, F.struct(sized["source"]) == targets["src"]).select(
        *keys, "n", "source_size", "target", F.floor(rate + EXACT).cast("int").alias("whole"), "docs",
        F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", F.hex(F.xxhash64("source")), F.isnull("source").cast("string")).alias("ident"),
        rate.alias("rate"))
    known = stage(known.withColumn("frac", F.col("rate") - F.col("whole")), "known")
    shards = F.ceil(F.col("docs") / LEAF)
    units = known.where((F.col("size") > 0) & (F.col("frac") > EXACT)).select(
        "ident", F.struct("source").alias("group"), F.pmod(F.xxhash64("ident"), shards).cast("long").alias("shard"), (F.col("size") * F.col("n")).alias("size"), "frac")
    widest = -(-(targets.agg(F.max("docs")).first()[0] or 0) // LEAF)
    drawn = pivotal_rounding(units, int(widest))
    decided = known.join(drawn.withColumnRenamed("copies", "drawn"), "ident", "left").select(
        *keys, "n", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("drawn", F.lit(0))).otherwise(0).cast("int").alias("copies"))
    return decided, keys


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, each row as often as the mix takes it."""
    decided, keys = mix_sources(docs)
    names = docs.columns
    lookup = stage(decided.where("copies > 0").select(F.struct(*keys).alias("__key"), F.col("copies").alias("__copies")), "decisions")
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size")))
    joined = keyed.join(lookup.hint("shuffle_hash"), "__key")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*names)
