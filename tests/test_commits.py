"""Loads become visible whole or not at all; batches are promoted whole or refused whole."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.sources import commits
from tidemark.sources.contracts import CONTRACTS
from test_ingest import GOOD, TXN, text_frame

USERS = CONTRACTS["users"]


def frames(spark, *rows):
    return {"subscription_transactions": ingest.parse_rows(text_frame(spark, TXN, [tuple(r) for r in rows]), TXN)}


def bad_row():
    bad = list(GOOD)
    bad[TXN.columns.index("amount_gbp")] = "x"
    bad[0] = "txn_bad"
    return bad


CONTRACT = {"subscription_transactions": TXN}


def test_a_load_is_visible_once_and_only_once(spark, tmp_path):
    root = str(tmp_path / "a")
    assert commits.published(spark, root, "subscription_transactions") is None and commits.audit_rows(spark, root).count() == 0
    assert ingest.load_snapshot(frames(spark, GOOD), CONTRACT, root, 7, "one") == "loaded"
    assert ingest.load_snapshot(frames(spark, GOOD), CONTRACT, root, 7, "one") == "already_loaded"
    assert commits.current(spark, root)["version"] == 1
    second = list(GOOD)
    second[0] = "txn_2"
    assert ingest.load_snapshot(frames(spark, GOOD, second), CONTRACT, root, 8, "two") == "loaded"
    rows = commits.published(spark, root, "subscription_transactions")
    assert {(r.ingestion_batch_id, r["count"]) for r in rows.groupBy("ingestion_batch_id").count().collect()} == {(7, 1), (8, 2)}
    # The same batch delivered anew replaces its rows.
    assert ingest.load_snapshot(frames(spark, second), CONTRACT, root, 8, "two again") == "loaded"
    assert commits.published(spark, root, "subscription_transactions").where("ingestion_batch_id = 8").count() == 1


def test_a_batch_with_a_reject_is_refused_whole(spark, tmp_path):
    root = str(tmp_path / "b")
    with pytest.raises(ingest.RejectedRows):
        ingest.load_snapshot(frames(spark, GOOD, bad_row()), CONTRACT, root, 7, "one")
    assert commits.published(spark, root, "subscription_transactions") is None
    assert ingest.load_snapshot(frames(spark, GOOD, bad_row()), CONTRACT, root, 7, "one", on_reject="quarantine") == "loaded"
    assert commits.published(spark, root, "quarantine_subscription_transactions").select("error_codes").first()[0] == "INVALID_DECIMAL"


def test_a_failed_reconciliation_leaves_no_visible_row(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    assert ingest.load_snapshot(frames(spark, GOOD), CONTRACT, root, 6, "zero") == "loaded"
    real = ingest.load_reconciliation
    monkeypatch.setattr(ingest, "load_reconciliation", lambda *a: real(*a).withColumn("reconciled", F.lit(False)))
    with pytest.raises(RuntimeError):
        ingest.load_snapshot(frames(spark, GOOD), CONTRACT, root, 7, "one")
    table, audit = str(tmp_path / "t"), str(tmp_path / "audit")
    with pytest.raises(RuntimeError):
        ingest.load_batch(frames(spark, GOOD)["subscription_transactions"], TXN, table, audit, 7, "one")
    monkeypatch.undo()
    assert commits.published(spark, root, "subscription_transactions").select("ingestion_batch_id").first()[0] == 6
    assert commits.audit_rows(spark, root).count() == 1
    # What the attempt left is known by name, and the next load does not mind it.
    assert commits.unpublished(spark, root).count() == 1
    assert ingest.load_snapshot(frames(spark, GOOD), CONTRACT, root, 7, "one") == "loaded"
    assert ingest.load_batch(frames(spark, GOOD)["subscription_transactions"], TXN, table, audit, 7, "one") == "loaded"
    assert spark.read.parquet(table).count() == 1


def test_of_two_writers_one_is_told(spark, tmp_path):
    root = str(tmp_path / "d")
    base = commits.current(spark, root)
    commits.publish(spark, root, base, {"t": [{"batch": 1, "path": "tables/t/x"}]}, [])
    with pytest.raises(commits.Conflict):
        commits.publish(spark, root, base, {"t": [{"batch": 2, "path": "tables/t/y"}]}, [])
    assert [p["batch"] for p in commits.current(spark, root)["tables"]["t"]] == [1]


def test_readers_keep_the_manifest_they_started_with(spark, tmp_path):
    root = str(tmp_path / "e")
    ingest.load_snapshot(frames(spark, GOOD), CONTRACT, root, 7, "one")
    seen = commits.current(spark, root)
    other = list(GOOD)
    other[0] = "txn_9"
    ingest.load_snapshot(frames(spark, other), CONTRACT, root, 7, "two")
    assert commits.published(spark, root, "subscription_transactions", seen).first().transaction_id == GOOD[0]
    assert commits.published(spark, root, "subscription_transactions").first().transaction_id == "txn_9"


def test_the_gate(spark):
    rows = [(*GOOD, 1), (*bad_row(), 1), (*GOOD, 2), (*GOOD, 3), (*GOOD, 4), (*GOOD, 5)]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TXN.columns) + ", ingestion_batch_id long")
    parsed = ingest.parse_rows(raw, TXN)
    runs = spark.createDataFrame([(1, 10, "succeeded"), (2, 20, "failed"), (2, 21, "succeeded"), (2, 22, "failed"), (3, 30, "failed"), (5, None, "succeeded")],
                                 "ingestion_batch_id long, validation_run_id long, status string")
    gate = ingest.promotion_gate(parsed, runs)
    got = {r.ingestion_batch_id: (r.promoted, r.refused_because, r.validation_run_id, r.promoted_row_count) for r in gate.collect()}
    assert got == {1: (False, "rejected_rows", 10, 0), 2: (True, None, 21, 1), 3: (False, "validation_failed", None, 0), 4: (False, "not_validated", None, 0), 5: (False, "validation_failed", None, 0)}
    promoted = ingest.promote_whole(parsed, TXN, gate).collect()
    assert [(r.transaction_id, r.ingestion_batch_id, r.validation_run_id) for r in promoted] == [(GOOD[0], 2, 21)]
    assert ingest.promotion_gate(parsed.where("false"), runs).count() == 0
