"""Ingestion operators bound to contract text derived from the order and line-item tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.canonical import row_hash
from tidemark.functions.pin import checkpoint_dir, pin
from tidemark.operators import ingest, reports
from tidemark.plans import mart_queries as mq
from tidemark.sources import Warehouse, commits
from tidemark.sources.contracts import CONTRACTS, Contract, Field
from tidemark.sources.csv_contract import canonical_text, scan_contract, snapshot_audit, write_csv

TRANSACTIONS = CONTRACTS["subscription_transactions"]


def raw_transactions(w: Warehouse) -> DataFrame:
    """Line items as contract text, with the defects that the contract has codes for."""
    o = w.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    line = F.col("l_linenumber")
    text = lambda prefix, *c: F.concat_ws("_", F.lit(prefix), *[F.col(x).cast("string") for x in c])
    # What is asked of a line item is answered before the join, which then moves flags instead of amounts.
    items = w.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        ((F.col("l_linestatus") == "F") & (line == 7)).alias("late"), (F.col("l_tax") == 0.08).alias("unpriced"), (F.col("l_discount") == 0.05).alias("padded"),
        (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_quantity") > 45).alias("third"))
    moment = F.when(F.col("late"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    amount = F.col("price").cast("string")
    return items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        text("txn", "l_orderkey", "l_linenumber", "l_partkey").alias("transaction_id"), text("sub", "l_orderkey").alias("subscription_id"),
        text("usr", "o_custkey").alias("user_id"), text("ins", "o_custkey").alias("installation_id"),
        F.when(line == 1, "initial_charge").otherwise("renewal").alias("transaction_type"), moment.alias("attempted_at"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "annual").when(F.col("o_orderpriority") == "5-LOW", "weekly")
        .otherwise("monthly").alias("billing_period"),
        F.when(F.col("unpriced"), "").when(F.col("padded"), F.concat(F.lit(" "), amount)).otherwise(amount).alias("amount_gbp"),
        F.lit("GBP").alias("currency"), F.when(F.col("failed"), "failed").otherwise("succeeded").alias("payment_status"),
        F.when(line == 3, "03").otherwise(line.cast("string")).alias("billing_cycle_number"),
        F.when(F.col("third"), "3").otherwise("1").alias("attempt_number"))


def parsed(w: Warehouse) -> DataFrame:
    return ingest.parse_rows(raw_transactions(w), TRANSACTIONS)


def folder(w: Warehouse) -> str:
    return f"{checkpoint_dir(w.spark)}/snapshot-{uuid.uuid4().hex}"


def scanned(w: Warehouse) -> DataFrame:
    """Write the text as contract CSV and read it back through the contract."""
    path = f"{folder(w)}/{TRANSACTIONS.dataset}.csv"
    write_csv(raw_transactions(w), path)
    return scan_contract(w.spark, path, TRANSACTIONS)


NOTES = Contract("notes", "note_id", (Field("note_id", "integer"), Field("body", nullable=True), Field("source", nullable=True)))


def scanned_notes(w: Warehouse) -> DataFrame:
    """Texts with line breaks, quotes and commas written as CSV and read back record by record."""
    path = f"{folder(w)}/{NOTES.dataset}.csv"
    write_csv(w.table("documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("body"), "source"), path)
    rows = scan_contract(w.spark, path, NOTES)
    last = rows.groupBy("source_file").agg((F.count(F.lit(1)) == F.max("source_row_number") - 1).alias("numbered")).agg(F.min("numbered")).scalar()
    return rows.select(F.col("note_id").cast("long").alias("note_id"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_sha256"), "source",
                       F.col("_malformed").isNotNull().alias("malformed"), (F.col("source_row_number") > 1).alias("after_header")).withColumn("numbers_complete", last)


def audited(w: Warehouse) -> DataFrame:
    """A snapshot with one present, one missing and one unexpected dataset."""
    path = folder(w)
    write_csv(raw_transactions(w), f"{path}/{TRANSACTIONS.dataset}.csv")
    write_csv(w.table("nation"), f"{path}/regions.csv")
    return snapshot_audit(w.spark, path, [TRANSACTIONS, CONTRACTS["users"]])


def snapshot_load(w: Warehouse) -> DataFrame:
    """Two datasets of one snapshot loaded as a unit, then offered again; the audit beside what the tables hold."""
    root, names = folder(w), ("subscription_transactions", "users")
    text = {"subscription_transactions": raw_transactions(w), "users": canonical_text(w.users)}
    frames = {n: ingest.parse_rows(text[n], CONTRACTS[n]) for n in names}
    contracts = {n: CONTRACTS[n] for n in names}
    ingest.load_snapshot(frames, contracts, root, 20240131, "snapshot_a", on_reject="quarantine")
    again = ingest.load_snapshot(frames, contracts, root, 20240131, "snapshot_a", on_reject="quarantine")
    stored = [commits.published(w.spark, root, n).groupBy("ingestion_batch_id").agg(F.count(F.lit(1)).alias("stored_row_count"), F.count_distinct("row_hash").alias("distinct_row_hashes"))
              .withColumn("dataset_name", F.lit(n)) for n in names]
    audit = commits.audit_rows(w.spark, root)
    return audit.join(stored[0].unionByName(stored[1]), ["ingestion_batch_id", "dataset_name"]).withColumn("second_attempt", F.lit(again))


def stored_reconciliation(w: Warehouse) -> DataFrame:
    """The accepted rows written as a table, and the counts of the delivery against what the table then holds."""
    path = f"{folder(w)}/{TRANSACTIONS.dataset}"
    ingest.accepted_rows(parsed(w), TRANSACTIONS).write.option("compression", "zstd").parquet(path)
    return ingest.load_reconciliation(parsed(w), w.spark.read.parquet(path), TRANSACTIONS.dataset)


def order_batches(w: Warehouse) -> DataFrame:
    """Orders by year of their date: every year is one delivered batch."""
    return w.paid_subscriptions.withColumn("ingestion_batch_id", F.year("subscription_started_at").cast("long"))


def batch_audit(w: Warehouse) -> DataFrame:
    """Earlier loads: the last two years never succeeded."""
    per = order_batches(w).groupBy("ingestion_batch_id").agg(F.count(F.lit(1)).alias("n"))
    last = per.agg(F.max("ingestion_batch_id")).scalar()
    return per.select("ingestion_batch_id", F.when(F.col("ingestion_batch_id") < last - 1, "succeeded").otherwise("failed").alias("status"))


def batch_counts(w: Warehouse) -> DataFrame:
    new = ingest.new_batches_only(order_batches(w), batch_audit(w))
    return new.groupBy("ingestion_batch_id").agg(F.count(F.lit(1)).alias("row_count"), F.max("subscription_started_at").alias("last_started_at"))


def results(w: Warehouse) -> dict[str, DataFrame]:
    return {"country_funnel": reports.install_totals(mq.install_funnel(w), "country_code"),
            "platform_funnel": reports.install_totals(mq.install_funnel(w), "platform"),
            "retention_by_billing": reports.retention_totals(mq.retention(w), "billing_period"),
            "daily_feature_engagement": mq.features(w)}


def hashed(w: Warehouse) -> DataFrame:
    rows = ingest.accepted_rows(parsed(w), TRANSACTIONS)
    return rows.select("transaction_id", row_hash(rows, TRANSACTIONS.dataset).alias("row_hash"))


def promoted(w: Warehouse) -> DataFrame:
    rows = ingest.accepted_rows(parsed(w), TRANSACTIONS)
    batch = rows.withColumn("ingestion_batch_id", F.year("attempted_at").cast("long"))
    return ingest.promote_batch(batch, F.col("ingestion_batch_id") * 10).select(
        "transaction_id", "ingestion_batch_id", "validation_run_id", F.col("amount_gbp").cast("double").alias("amount_gbp"))


def deliveries(w: Warehouse) -> DataFrame:
    """The parsed transactions, each order a delivery of its own."""
    return parsed(w).withColumn("ingestion_batch_id", F.substring("subscription_id", 5, 20).cast("long"))


def validations(w: Warehouse) -> DataFrame:
    """Two runs of each delivery's checks: every tenth was never validated, the one after it failed twice, the others passed the second run."""
    order, k = F.col("o_orderkey"), F.col("k")
    runs = w.table("orders").where(order % 10 != 0).select(order, F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return runs.select(order.cast("long").alias("ingestion_batch_id"), (order * 10 + k).cast("long").alias("validation_run_id"),
                       F.when((k == 2) & (order % 10 != 1), "succeeded").otherwise("failed").alias("status"))


def gate(w: Warehouse) -> DataFrame:
    return ingest.promotion_gate(deliveries(w), validations(w))


def promoted_whole(w: Warehouse) -> DataFrame:
    """Rows of the deliveries that were let through, none of the others."""
    rows = pin(deliveries(w))
    return ingest.promote_whole(rows, TRANSACTIONS, ingest.promotion_gate(rows, validations(w))).select(
        "transaction_id", "ingestion_batch_id", "validation_run_id", F.col("amount_gbp").cast("double").alias("amount_gbp"))


def typed_text(w: Warehouse) -> DataFrame:
    return ingest.typed_cast(parsed(w), TRANSACTIONS).withColumn("amount_gbp", F.col("amount_gbp").cast("double"))


QUERIES = {
    "scan_contract": lambda w: scanned(w).select(*TRANSACTIONS.columns),
    "scan_records": scanned_notes,
    "snapshot_audit": audited,
    "table_fingerprint": lambda w: ingest.snapshot_fingerprint({
        "subscription_transactions": ingest.accepted_rows(parsed(w), TRANSACTIONS), "users": w.users}),
    "typed_cast": typed_text,
    "accepted_rows": lambda w: ingest.accepted_rows(parsed(w), TRANSACTIONS).withColumn("amount_gbp", F.col("amount_gbp").cast("double")),
    "quarantine_rows": lambda w: ingest.quarantine_rows(parsed(w), TRANSACTIONS),
    "row_hash": hashed,
    "new_batches_only": batch_counts,
    "load_snapshot": snapshot_load,
    "load_reconciliation": stored_reconciliation,
    "promote_batch": promoted,
    "promotion_gate": gate,
    "staging_promotion": promoted_whole,
    "orphan_partitions": lambda w: ingest.orphan_partitions(order_batches(w), batch_audit(w)),
    "canonical_csv": lambda w: canonical_text(w.users.withColumn("onboarded", F.col("onboarding_completed_at").isNotNull())),
    "result_manifest": lambda w: ingest.result_manifest(results(w)),
}
