"""Tables that become visible by one file: a load is written beside them, checked, and published by a numbered manifest.

``root/_manifest/<n>.json`` is complete or absent: it is written under another name and renamed, and a number that exists is never replaced, so
of two writers one is told to start again.  Readers take the highest number and read exactly the folders it lists.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

AUDIT = "ingestion_batch_id long, snapshot_id string, dataset_name string, accepted_row_count long, rejected_row_count long, status string"
FIRST = {"version": 0, "tables": {}, "audit": []}


class Conflict(RuntimeError):
    """Somebody else published in the meantime."""


def _files(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = java.Path(path)
    return java, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict:
    """The newest manifest; before the first load an empty one."""
    _, folder, files = _files(spark, f"{root}/_manifest")
    if not files.exists(folder):
        return FIRST
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit() and n.endswith(".json")]
    if not numbers:
        return FIRST
    text = spark.read.text(f"{root}/_manifest/{max(numbers):012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def publish(spark: SparkSession, root: str, base: dict, tables: dict[str, list[dict]], audit: list[dict]) -> dict:
    """A manifest after ``base`` with more loads: ``tables`` lists {batch, path} per table, replacing the batches they name.

    Raises ``Conflict`` where another manifest has taken the number.
    """
    merged = {n: [p for p in parts if p["batch"] not in {x["batch"] for x in tables.get(n, [])}] for n, parts in base["tables"].items()}
    for n, parts in tables.items():
        merged[n] = merged.get(n, []) + parts
    new = {"version": base["version"] + 1, "tables": merged, "audit": base["audit"] + audit}
    java, draft, files = _files(spark, f"{root}/_manifest/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(json.dumps(new).encode())
    out.close()
    final = java.Path(f"{root}/_manifest/{new['version']:012d}.json")
    if files.exists(final) or not files.rename(draft, final):
        raise Conflict(f"version {new['version']} of {root} is taken")
    return new


def published(spark: SparkSession, root: str, table: str, manifest: dict | None = None) -> DataFrame | None:
    """The visible rows of a table with their ``ingestion_batch_id``; None before its first load."""
    parts = (manifest or current(spark, root))["tables"].get(table, [])
    return spark.read.parquet(*[f"{root}/{p['path']}" for p in parts]) if parts else None


def audit_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row per load that was published."""
    rows = current(spark, root)["audit"]
    return spark.createDataFrame([tuple(r.values()) for r in rows], AUDIT)


def unpublished(spark: SparkSession, root: str) -> DataFrame:
    """(table, path) of folders that no manifest lists: what attempts that died have left."""
    _, folder, files = _files(spark, f"{root}/tables")
    listed = {f"{root}/{p['path']}" for parts in current(spark, root)["tables"].values() for p in parts}
    found = []
    if files.exists(folder):
        for table in files.listStatus(folder):
            for load in files.listStatus(table.getPath()):
                name = f"tables/{table.getPath().getName()}/{load.getPath().getName()}"
                if f"{root}/{name}" not in listed:
                    found.append((table.getPath().getName(), name))
    return spark.createDataFrame(found, "table_name string, path string")

