"""Isotonic regression of binary labels: pools of adjacent violators as block lists that merge range by range."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.pin import pin

#: Block lists that one task of the tree merges.
FAN = 8
#: Slices of the score range in which rows meet their block.
SLICES = 4_096
BLOCK = "part bigint, lo double, hi double, positives bigint, n bigint"


def pool(blocks: Iterable[tuple]) -> list[tuple]:
    """(lo, hi, positives, n) in order of score -> blocks of strictly rising rates.  Rates are compared as integers, so nothing is rounded."""
    done: list[tuple] = []
    for lo, hi, positives, n in blocks:
        while done and done[-1][2] * n >= positives * done[-1][3]:
            first, _, p, m = done.pop()
            lo, positives, n = first, positives + p, n + m
        done.append((lo, hi, positives, n))
    return done


def _table(part: int, blocks: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*blocks)) or [[]] * 4
    kinds = pa.float64(), pa.float64(), pa.int64(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["part", "lo", "hi", "positives", "n"])


def _pooled_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    for batch in batches:
        p, positives, n = (batch.column(i).to_pylist() for i in range(3))
        done = pool([*done, *zip(p, p, positives, n)])
    yield _table(TaskContext.get().partitionId(), done)


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = sorted((r["lo"], r["hi"], r["positives"], r["n"], r["part"]) for r in table.to_pylist())
    return pa.Table.from_batches([_table(rows[0][4] // FAN, pool([r[:4] for r in rows]))])


def isotonic_blocks(scored: DataFrame) -> DataFrame:
    """scored (label 0 or 1, p) -> lo, hi, positives, n, value: stretches of scores with their pooled rate, rising.

    Rows collapse to distinct scores; ranges of scores are pooled by themselves, then neighbouring lists in a tree.  Pooled rates are distinct
    fractions, so n rows leave at most some n^(2/3) blocks, however many scores there are.  Rows without a score or label are left out.
    """
    known = scored.where(F.col("p").isNotNull() & F.col("label").isNotNull())
    counts = known.groupBy((F.col("p").cast("double") + F.lit(0.0)).alias("p")).agg(F.sum("label").cast("long").alias("positives"), F.count(F.lit(1)).alias("n"))
    level = pin(counts.repartitionByRange("p").sortWithinPartitions("p").mapInArrow(_pooled_range, BLOCK))
    while level.select("part").distinct().count() > 1:
        level = pin(level.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_merged, BLOCK))
    return level.select("lo", "hi", "positives", "n", (F.col("positives") / F.col("n")).alias("value"))


def isotonic_scores(scored: DataFrame, blocks: DataFrame, out: str = "q") -> DataFrame:
    """``scored`` with the fitted rate of each score: a block's own inside it, on the line between two blocks, the outermost beyond them.

    Blocks unfold to the slices of the score range they reach over; rows meet theirs by an equi-join on the slice.  Scores lie in [0, 1].
    """
    slice_of = lambda c: F.least(F.greatest(F.floor(c * SLICES), F.lit(0)), F.lit(SLICES)).cast("int")
    # Sublinear in the rows that were fitted, as said above.
    order = Window.orderBy("lo")
    spans = blocks.select("lo", "hi", "value", F.lead("lo").over(order).alias("next_lo"), F.lead("value").over(order).alias("next_value"), F.lag("lo").over(order).isNull().alias("first"))
    from_at = F.when(F.col("first"), F.lit(0)).otherwise(slice_of(F.col("lo")))
    until = F.when(F.col("next_lo").isNull(), F.lit(SLICES)).otherwise(slice_of(F.col("next_lo")))
    sliced = spans.withColumn("__slice", F.explode(F.sequence(from_at, until)))
    p = F.col("p")
    rows = scored.withColumn("__slice", slice_of(p))
    inside = (F.col("first") | (p >= F.col("lo"))) & (F.col("next_lo").isNull() | (p < F.col("next_lo")))
    line = F.col("value") + (F.col("next_value") - F.col("value")) * F.try_divide(p - F.col("hi"), F.col("next_lo") - F.col("hi"))
    fitted = F.when((p > F.col("hi")) & F.col("next_lo").isNotNull(), line).otherwise(F.col("value"))
    joined = rows.alias("r").join(sliced.alias("b"), (F.col("r.__slice") == F.col("b.__slice")) & inside, "left")
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in scored.columns], fitted.alias(out))
