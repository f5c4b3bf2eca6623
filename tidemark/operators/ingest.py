"""Typed parsing with error codes, quarantine, fingerprints, and idempotent batch loading."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.canonical import fingerprint_bits, row_hash
from tidemark.functions.pin import pin
from tidemark.sources import commits
from tidemark.sources.contracts import Contract, Field
from tidemark.sources.csv_contract import MALFORMED

# Accepted number and time formats.
INTEGER = r"^-?(0|[1-9][0-9]*)$"
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]{1,18})?$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def typed(field: Field, raw: Column) -> Column:
    """The typed value of contract text, NULL when it does not parse."""
    if field.kind == "timestamp":
        return F.when(raw.rlike(TIMESTAMP), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))).cast("timestamp_ntz")
    if field.kind == "date":
        return F.when(raw.rlike(DATE), raw.try_cast("date"))
    if field.kind == "integer":
        return F.when(raw.rlike(INTEGER), raw.try_cast("long"))
    if field.kind == "decimal":
        return F.when(raw.rlike(DECIMAL), raw.try_cast("decimal(38,18)"))
    if field.kind == "boolean":
        return F.when(raw == "true", True).when(raw == "false", False)
    return F.when(raw != "", raw)


def error_code(field: Field, raw: Column, value: Column) -> Column:
    """First rule the text breaks, or NULL; ``value`` is its typed value."""
    code = F.when(raw == "", F.lit(None if field.nullable else "NULL_NOT_ALLOWED").cast("string"))
    code = code.when(raw != F.btrim(raw, F.lit(WHITESPACE)), "SURROUNDING_WHITESPACE")
    if field.kind != "string":
        code = code.when(value.isNull(), f"INVALID_{field.kind.upper()}")
    if field.allowed is not None:
        code = code.when(~value.isin(*field.allowed), "INVALID_DOMAIN")
    if field.low is not None:
        code = code.when(value < field.low, "OUT_OF_RANGE")
    if field.high is not None:
        code = code.when(value > field.high, "OUT_OF_RANGE")
    return code


def parse_rows(raw: DataFrame, contract: Contract) -> DataFrame:
    """Add the typed value (``t_<column>``) and error code (``c_<column>``) of every field, and both joined per row.

    Three narrow projections, so each typed value and each code is computed once; no shuffle, no Python.
    """
    text = {f.name: F.coalesce(F.col(f.name), F.lit("")) for f in contract.fields}
    values = raw.withColumns({f"t_{f.name}": typed(f, text[f.name]) for f in contract.fields})
    coded = values.withColumns({f"c_{f.name}": error_code(f, text[f.name], F.col(f"t_{f.name}")) for f in contract.fields})
    codes = F.concat_ws("|", *[F.col(f"c_{f.name}") for f in contract.fields])
    details = F.concat_ws("|", *[F.concat(F.lit(f"{f.name}:"), F.col(f"c_{f.name}")) for f in contract.fields])
    if MALFORMED in raw.columns:
        arity = F.col(MALFORMED).isNotNull()
        codes, details = (F.when(arity, "COLUMN_COUNT_MISMATCH").otherwise(c) for c in (codes, details))
    out = coded.withColumns({"error_codes": codes, "error_details": details})
    # Observed metrics report accepted and rejected rows of any action.  They also keep filters on the verdict above
    # this point: pushed down, a filter would spell out and evaluate every rule a second time.
    ok = F.col("error_codes") == ""
    return out.observe(f"parsed_{contract.dataset}_{uuid.uuid4().hex}", F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def _typed_columns(contract: Contract) -> list[Column]:
    return [F.col(f"t_{c}").alias(c) for c in contract.columns]


def typed_cast(parsed: DataFrame, contract: Contract) -> DataFrame:
    """Typed columns beside the joined error codes of each row."""
    return parsed.select(*_typed_columns(contract), "error_codes")


def accepted_rows(parsed: DataFrame, contract: Contract) -> DataFrame:
    return parsed.where(F.col("error_codes") == "").select(*_typed_columns(contract))


def quarantine_rows(parsed: DataFrame, contract: Contract) -> DataFrame:
    """Rejected rows with joined codes, details and the raw record as JSON with sorted keys."""
    record = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in sorted(contract.columns)]))
    if MALFORMED in parsed.columns:
        record = F.when(F.col(MALFORMED).isNotNull(), F.to_json(F.struct(F.col(MALFORMED).alias("values")))).otherwise(record)
    origin = [c for c in ("source_file", "source_row_number") if c in parsed.columns]
    return parsed.where(F.col("error_codes") != "").select(
        F.lit(contract.dataset).alias("dataset_name"), *origin, "error_codes", "error_details", record.alias("raw_record_json"))


class RejectedRows(ValueError):
    """A load with ``on_reject='fail'`` met rejected rows."""


def table_digest(df: DataFrame, dataset: str) -> DataFrame:
    """Row count and two order-free digests of the canonical row hashes: one row per table."""
    bits = fingerprint_bits(row_hash(df, dataset))
    return df.select(bits.alias("b")).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor("b"), F.lit(0)).cast("string").alias("hash_xor")).withColumn("dataset", F.lit(dataset))


def snapshot_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """Snapshot id over the digests of a fixed set of datasets, independent of row and file order."""
    digests = reduce(DataFrame.unionByName, [table_digest(df, name) for name, df in tables.items()])
    line = F.concat_ws(":", "dataset", F.col("row_count").cast("string"), "hash_sum", "hash_xor")
    return digests.agg(F.count(F.lit(1)).alias("dataset_count"), F.sum("row_count").alias("row_count"),
                       F.concat(F.lit("raw_"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)).alias("snapshot_id"))


def load_reconciliation(parsed: DataFrame, loaded: DataFrame, dataset: str) -> DataFrame:
    """Accepted + rejected = read, and the table holds what was accepted."""
    ok = F.col("error_codes") == ""
    read = parsed.agg(F.count(F.lit(1)).alias("read_row_count"), F.count_if(ok).alias("accepted_row_count"), F.count_if(~ok).alias("rejected_row_count"))
    both = read.withColumn("loaded_row_count", loaded.agg(F.count(F.lit(1))).scalar())
    return both.select(F.lit(dataset).alias("dataset_name"), "*", (
        (F.col("accepted_row_count") + F.col("rejected_row_count") == F.col("read_row_count"))
        & (F.col("accepted_row_count") == F.col("loaded_row_count"))).alias("reconciled"))


# --- batches ---------------------------------------------------------------------------------------------

def new_batches_only(incoming: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows of batches without a successful load; a failed attempt does not count."""
    done = audit.where(F.col("status") == "succeeded").select("ingestion_batch_id").distinct()
    return incoming.join(done, "ingestion_batch_id", "left_anti")


def promotion_gate(parsed: DataFrame, validations: DataFrame, batch: str = "ingestion_batch_id") -> DataFrame:
    """One verdict per batch: promoted whole, or refused whole with the reason.

    ``validations`` (batch, validation_run_id, status) are the runs of the quality catalogue; the latest succeeded one counts.  A batch with a
    rejected row is refused whatever its validation says.
    """
    counts = parsed.groupBy(batch).agg(
        F.count(F.lit(1)).alias("read_row_count"), F.count_if(F.col("error_codes") == "").alias("accepted_row_count"),
        F.count_if(F.col("error_codes") != "").alias("rejected_row_count"))
    runs = validations.groupBy(batch).agg(F.max(F.when(F.col("status") == "succeeded", F.col("validation_run_id"))).alias("validation_run_id"), F.count(F.lit(1)).alias("__runs"))
    reason = (F.when(F.col("rejected_row_count") > 0, "rejected_rows").when(F.col("__runs").isNull(), "not_validated")
              .when(F.col("validation_run_id").isNull(), "validation_failed"))
    joined = counts.join(runs, batch, "left")
    return joined.select(batch, "read_row_count", "accepted_row_count", "rejected_row_count", "validation_run_id", reason.isNull().alias("promoted"),
                         reason.alias("refused_because"), F.when(reason.isNull(), F.col("accepted_row_count")).otherwise(0).alias("promoted_row_count"))


def promote_whole(parsed: DataFrame, contract: Contract, gate: DataFrame, batch: str = "ingestion_batch_id") -> DataFrame:
    """Business columns and lineage of the batches that the gate lets through, stamped with their validation run; nothing of the others."""
    open_ = gate.where("promoted").select(batch, "validation_run_id")
    kept = [c for c in (batch, "source_file", "source_row_number") if c in parsed.columns]
    return parsed.join(open_, batch).select(*_typed_columns(contract), *kept, "validation_run_id")


def promote_batch(validated: DataFrame, validation_run_id: Column) -> DataFrame:
    """Business and lineage columns of a validated batch, stamped with the validation run."""
    return validated.select("*", validation_run_id.cast("long").alias("validation_run_id"))


def orphan_partitions(table: DataFrame, runs: DataFrame) -> DataFrame:
    """Partitions holding rows without a successful run: leftovers that must not be built upon."""
    done = runs.where(F.col("status") == "succeeded").select("ingestion_batch_id").distinct()
    return table.groupBy("ingestion_batch_id").agg(F.count(F.lit(1)).alias("row_count")).join(done, "ingestion_batch_id", "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _loaded(spark: SparkSession, audit_path: str, snapshot_id: str, dataset: str | None = None) -> set[str]:
    """Datasets of the snapshot with a successful load; the names are bounded by the contracts."""
    if not _exists(spark, audit_path):
        return set()
    done = spark.read.parquet(audit_path).where((F.col("snapshot_id") == snapshot_id) & (F.col("status") == "succeeded"))
    if dataset:
        done = done.where(F.col("dataset_name") == dataset)
    return {r.dataset_name for r in done.select("dataset_name").distinct().collect()}


def load_batch(parsed: DataFrame, contract: Contract, table_path: str, audit_path: str, batch_id: int, snapshot_id: str,
               on_reject: str = "fail", quarantine_path: str | None = None) -> str:
    """Load one dataset of one snapshot once.  Returns ``loaded`` or ``already_loaded``."""
    if _loaded(parsed.sparkSession, audit_path, snapshot_id, contract.dataset):
        return "already_loaded"
    quarantines = {contract.dataset: quarantine_path} if quarantine_path else {}
    _load({contract.dataset: (parsed, contract, table_path)}, audit_path, batch_id, snapshot_id, on_reject, quarantines)
    return "loaded"


def load_snapshot(parsed: dict[str, DataFrame], contracts: dict[str, Contract], root: str, batch_id: int, snapshot_id: str, on_reject: str = "fail") -> str:
    """Load every dataset of a snapshot as one unit under ``root``; returns ``loaded`` or ``already_loaded``.

    Rows and rejects of all datasets are written beside the tables, read back and reconciled with the delivery; only then one manifest
    makes them visible together.  With ``on_reject='fail'`` a single rejected row refuses the snapshot; with ``'quarantine'`` rejects are kept
    beside the accepted rows.  A refused, failed or interrupted load leaves no visible row; another load of the same batch replaces it.
    ``sources.commits`` reads the tables and the audit.
    """
    spark = next(iter(parsed.values())).sparkSession
    base = commits.current(spark, root)
    if {a["dataset_name"] for a in base["audit"] if a["snapshot_id"] == snapshot_id and a["status"] == "succeeded"} >= set(parsed):
        return "already_loaded"
    stored = {n: pin(df) for n, df in parsed.items()}
    if on_reject == "fail":
        _refuse_rejects(stored)
    load = uuid.uuid4().hex
    tables, recon = {}, []
    for n, df in stored.items():
        rows = accepted_rows(df, contracts[n])
        stamped = rows.select("*", row_hash(rows, n, contracts[n].columns).alias("row_hash"), F.lit(batch_id).cast("long").alias("ingestion_batch_id"))
        stamped.write.parquet(f"{root}/tables/{n}/{load}")
        tables[n] = [{"batch": batch_id, "path": f"tables/{n}/{load}"}]
        recon.append(load_reconciliation(df, spark.read.schema(stamped.schema).parquet(f"{root}/tables/{n}/{load}"), n))
        if on_reject != "fail":
            rejects = quarantine_rows(df, contracts[n]).withColumn("ingestion_batch_id", F.lit(batch_id).cast("long"))
            rejects.write.parquet(f"{root}/tables/quarantine_{n}/{load}")
            tables[f"quarantine_{n}"] = [{"batch": batch_id, "path": f"tables/quarantine_{n}/{load}"}]
    # One row per dataset, bounded by the contracts.
    verdicts = {r.dataset_name: r for r in reduce(DataFrame.unionByName, recon).collect()}
    wrong = sorted(n for n, r in verdicts.items() if not r.reconciled)
    if wrong:
        raise RuntimeError(f"loaded rows do not reconcile: {', '.join(wrong)}")
    audit = [{"ingestion_batch_id": batch_id, "snapshot_id": snapshot_id, "dataset_name": n, "accepted_row_count": r.accepted_row_count,
              "rejected_row_count": r.rejected_row_count, "status": "succeeded"} for n, r in sorted(verdicts.items())]
    commits.publish(spark, root, base, tables, audit)
    return "loaded"


def _refuse_rejects(stored: dict[str, DataFrame]) -> None:
    broken = [n for n, df in stored.items() if not df.where(F.col("error_codes") != "").isEmpty()]
    if broken:
        raise RejectedRows(", ".join(sorted(broken)))


def _load(jobs: dict[str, tuple[DataFrame, Contract, str]], audit_path: str, batch_id: int, snapshot_id: str, on_reject: str, quarantines: dict[str, str]) -> None:
    """A batch's rows are written to a draft folder, reconciled there, moved into place, and the audit is appended last, so a load that
    fails its reconciliation leaves no row, and an attempt that died half-way is replaced by the next.

    Each input is parsed once: the stored verdicts feed the rejection test, the quarantine, the table and the reconciliation.
    """
    stored = {n: (pin(df), contract, table) for n, (df, contract, table) in jobs.items()}
    if on_reject == "fail":
        _refuse_rejects({n: df for n, (df, _, _) in stored.items()})
    audits, drafts = [], []
    for n, (df, contract, table) in stored.items():
        rows = accepted_rows(df, contract)
        stamped = rows.select("*", row_hash(rows, n, contract.columns).alias("row_hash"))
        draft = f"{table}/_draft_{uuid.uuid4().hex}"
        stamped.write.parquet(draft)
        drafts.append((df.sparkSession, draft, f"{table}/ingestion_batch_id={batch_id}"))
        audits.append(load_reconciliation(df, df.sparkSession.read.schema(stamped.schema).parquet(draft), n))
    audit = pin(reduce(DataFrame.unionByName, audits).select(
        F.lit(batch_id).cast("long").alias("ingestion_batch_id"), F.lit(snapshot_id).alias("snapshot_id"), "dataset_name",
        "accepted_row_count", "rejected_row_count", F.when(F.col("reconciled"), "succeeded").otherwise("failed").alias("status")))
    wrong = [r.dataset_name for r in audit.where("status = 'failed'").select("dataset_name").collect()]
    if wrong:
        raise RuntimeError(f"loaded rows do not reconcile: {', '.join(sorted(wrong))}")
    for n, path in quarantines.items() if on_reject != "fail" else ():
        quarantine_rows(*stored[n][:2]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    for spark, draft, final in drafts:
        _replace(spark, draft, final)
    audit.coalesce(1).write.mode("append").parquet(audit_path)


def _replace(spark: SparkSession, draft: str, final: str) -> None:
    """The draft folder in place of what an attempt without an audit row may have left there."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, new = java.Path(final), java.Path(draft)
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(old):
        files.delete(old, True)
    if not files.rename(new, old):
        raise RuntimeError(f"{draft} could not be moved to {final}")


def result_manifest(results: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every named result, one line each, with the line as JSON."""
    rows = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("dataset"), F.array_join(F.array(*[F.lit(c) for c in sorted(df.columns)]), ",").alias("columns"), "row_count")
        for name, df in results.items()]
    manifest = reduce(DataFrame.unionByName, rows)
    return manifest.withColumn("manifest_json", F.to_json(F.struct("dataset", "row_count")))


def write_results(results: dict[str, DataFrame], path: str) -> DataFrame:
    """One CSV folder per result and a JSON manifest beside them."""
    for name, df in results.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    manifest = result_manifest(results)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
