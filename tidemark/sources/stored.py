"""Layers written once, each table with a tree of digests, and the comparison of two layers through their trees.

A row's key deals it to one of ``LEAVES`` leaves.  A leaf's digest is the number of its rows and two order-free sums over the hashes of
their stamps; a node above has the sums of its leaves.  Two layers are compared from the root down: where digests agree nothing below is
looked at, and rows are read only of leaves whose digests differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.pin import checkpoint_dir

LEAVES, FAN = 4_096, 64
# Hashes never repeat, so a dictionary of them is built in vain; ids and texts are packed closer by zstd than by snappy.
PARQUET = {"compression": "zstd", "parquet.enable.dictionary#row_hash": "false"}
BATCH_COLUMN = "ingestion_batch_id"


def leaf_of(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(LEAVES)).cast("int")


def leaf_digests(df: DataFrame, stamp: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(batch, leaf, n, total, parity, repeats) from rows with a ``leaf``; repeats: rows beyond the first of their key.

    The sums collapse to leaves before their shuffle; the keys are shuffled as 64 bits each, without stamps.  Two keys of equal bits count as
    repeated, which only has their leaf compared by row.
    """
    bits, of_key = F.xxhash64(*stamp), F.xxhash64(*dict.fromkeys([BATCH_COLUMN, *key]))
    sums = df.groupBy(BATCH_COLUMN, "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(bits.cast("decimal(38,0)")).alias("total"), F.bit_xor(bits).alias("parity"))
    per_key = df.groupBy(BATCH_COLUMN, "leaf", of_key.alias("__key")).agg((F.count(F.lit(1)) - 1).alias("more"))
    more = per_key.where("more > 0").groupBy(F.col(BATCH_COLUMN).alias("__batch"), F.col("leaf").alias("__leaf")).agg(F.sum("more").alias("repeats"))
    mine = F.col(BATCH_COLUMN).eqNullSafe(F.col("__batch")) & (F.col("leaf") == F.col("__leaf"))
    return sums.join(more, mine, "left").select(BATCH_COLUMN, "leaf", "n", "total", "parity", F.coalesce("repeats", F.lit(0).cast("long")).alias("repeats"))


def upper(digests: DataFrame, width: int, by: Sequence[str]) -> DataFrame:
    """Digests of the nodes that hold ``width`` leaves each."""
    return digests.groupBy(*by, F.expr(f"leaf div {width}").alias("node")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("parity").alias("parity"))


def differing_leaves(left: DataFrame, right: DataFrame, by: Sequence[str] = ("dataset_name", BATCH_COLUMN)) -> DataFrame:
    """(by, leaf) where the two layers' digests differ or one has none; found from the roots down, for all trees at once."""

    def unlike(a: DataFrame, b: DataFrame, node: str) -> DataFrame:
        keys = [*by, node]
        a, b = (x.select(*keys, F.struct("n", "total", "parity").alias(side)) for x, side in ((a, "a"), (b, "b")))
        return a.join(b, keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)

    def within(digests: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
        return digests.withColumn("node", F.expr(f"leaf div {width}")).join(nodes, [*by, "node"], "left_semi").drop("node")

    for width in (LEAVES, FAN):
        nodes = unlike(upper(left, width, by), upper(right, width, by), "node")
        left, right = within(left, nodes, width), within(right, nodes, width)
    return unlike(left, right, "leaf")


class StoredTables(Mapping[str, DataFrame]):
    """Tables of one layer, each written when it is first read and read from its files ever after.

    A table is written to a folder of its own and becomes visible by one rename; whoever comes second uses what is there.  Every table
    carries ``leaf`` where ``keys`` names its key, its rows ordered by it within files, and has its digests stored beside it when they are
    first asked for.  With ``shared`` the frames are selections of rows that another layer has stored, leaves included: they are read from
    there and only their digests are written.
    """

    def __init__(self, spark: SparkSession, root: str, build: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], stamp: Sequence[str], shared: bool = False):
        self.spark, self.root, self._build, self._keys, self._stamp, self._shared = spark, root, build, keys, stamp, shared
        self._read: dict[str, DataFrame] = {}
        self._digests: dict[str, DataFrame] = {}

    def _stored(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        java = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        final = java.Path(path)
        files = final.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        df = None
        if not files.exists(final):
            df = rows()
            draft = java.Path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
            df.write.options(**PARQUET).parquet(draft.toString())
            files.mkdirs(final.getParent())
            if not files.exists(final):
                files.rename(draft, final)
        return self.spark.read.parquet(path) if df is None else self.spark.read.schema(df.schema).parquet(path)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            key = self._keys.get(name)
            leafed = lambda: self._build[name].withColumn("leaf", leaf_of(*key)).sortWithinPartitions("leaf") if key else self._build[name]
            self._read[name] = self._build[name] if self._shared else self._stored(name, leafed)
        return self._read[name]

    def digests(self, name: str) -> DataFrame:
        if name not in self._digests:
            self._digests[name] = self._stored(f"{name}.digests", lambda: leaf_digests(self[name], self._stamp, self._keys[name]))
        return self._digests[name]

    def all_digests(self, named: Mapping[str, str] | None = None) -> DataFrame:
        """The digests of all tables that have them, with ``dataset_name``; ``named`` gives tables other names."""
        parts = [self.digests(t).withColumn("dataset_name", F.lit((named or {}).get(t, t))) for t in self if t in self._keys]
        return reduce(DataFrame.unionByName, parts)

    def counts(self, alias: str, named: Mapping[str, str] | None = None) -> DataFrame:
        """Rows per batch and dataset of the stored tables, counted per file; no key is shuffled for it."""
        parts = [self[t].groupBy(BATCH_COLUMN).agg(F.count(F.lit(1)).alias(alias)).select(BATCH_COLUMN, F.lit((named or {}).get(t, t)).alias("dataset_name"), alias)
                 for t in self if t in self._keys]
        return reduce(DataFrame.unionByName, parts)

    def __iter__(self) -> Iterator[str]:
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)


def input_stamp(spark: SparkSession, folder: str) -> str:
    """A name for the files of a folder as they are now: changes with any path, size or time.  No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    bits = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(bits), F.lit(0)).alias("x"), F.coalesce(F.sum(bits.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{row.n}-{row.x & (2**64 - 1):016x}-{int(row.s) & (2**64 - 1):016x}"


def store_root(spark: SparkSession, folder: str) -> str:
    """Where the layers of a folder's tables are kept: in this application's part of the shared checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return f"{context.getCheckpointDir()}/layers/{input_stamp(spark, folder)}"
