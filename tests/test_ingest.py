import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_payload, canonical_value, row_hash
from tidemark.operators import ingest
from tidemark.sources.contracts import CONTRACTS, Contract, Field
from tidemark.sources.csv_contract import canonical_text, scan_contract, snapshot_audit, split_records, text_lines, write_csv

TXN = CONTRACTS["subscription_transactions"]
GOOD = ["t1", "s1", "u1", "i1", "renewal", "2024-01-02T03:04:05Z", "monthly", "9.99", "GBP", "succeeded", "1", "1"]


def text_frame(spark, contract, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in contract.columns))


def codes(spark, **changes):
    row = dict(zip(TXN.columns, GOOD)) | changes
    out = ingest.parse_rows(text_frame(spark, TXN, [tuple(row[c] for c in TXN.columns)]), TXN).first()
    return [tuple(d.split(":")) for d in out.error_details.split("|") if d]


@pytest.mark.parametrize("change, expected", [
    ({}, []),
    ({"transaction_id": ""}, [("transaction_id", "NULL_NOT_ALLOWED")]),
    ({"user_id": " u1"}, [("user_id", "SURROUNDING_WHITESPACE")]),
    ({"attempted_at": "2024-01-02 03:04:05"}, [("attempted_at", "INVALID_TIMESTAMP")]),
    ({"attempted_at": "2024-02-30T03:04:05Z"}, [("attempted_at", "INVALID_TIMESTAMP")]),
    ({"billing_period": "weekly"}, [("billing_period", "INVALID_DOMAIN")]),
    ({"amount_gbp": "1e3"}, [("amount_gbp", "INVALID_DECIMAL")]),
    ({"amount_gbp": "-0.01"}, [("amount_gbp", "OUT_OF_RANGE")]),
    ({"billing_cycle_number": "01"}, [("billing_cycle_number", "INVALID_INTEGER")]),
    ({"attempt_number": "3"}, [("attempt_number", "OUT_OF_RANGE")]),
    ({"amount_gbp": "x", "attempt_number": "0"}, [("amount_gbp", "INVALID_DECIMAL"), ("attempt_number", "OUT_OF_RANGE")]),
])
def test_first_failing_rule_per_field(spark, change, expected):
    assert codes(spark, **change) == expected


def test_boolean_and_date_cells(spark):
    c = Contract("x", "k", (Field("k"), Field("flag", "boolean"), Field("day", "date", nullable=True)))
    rows = [("a", "true", "2024-02-29"), ("b", "TRUE", ""), ("c", "false", "2023-02-29"), ("d", "false", "2024-1-01")]
    out = {r.k: (r.flag, r.day, r.error_codes) for r in ingest.typed_cast(ingest.parse_rows(text_frame(spark, c, rows), c), c).collect()}
    assert out["a"] == (True, dt.date(2024, 2, 29), "")
    assert out["b"][2] == "INVALID_BOOLEAN" and out["c"][2] == "INVALID_DATE" and out["d"][2] == "INVALID_DATE"


def test_golden_row_hash(spark):
    df = spark.createDataFrame(
        [("sub_000001", Decimal("9.9900"), True, dt.datetime(2026, 1, 2, 3, 4, 5), None)],
        "subscription_id string, price_gbp decimal(18,4), auto_renew boolean, subscription_started_at timestamp_ntz, expired_at timestamp_ntz")
    row = df.select(canonical_payload(df, "subscriptions").alias("p"), row_hash(df, "subscriptions").alias("h")).first()
    assert row.h == "91d4c7e012af37acf2e153492daa07e5c44d845c91139dfb498aa497d6d3c9e3"
    assert row.h == hashlib.sha256(row.p.encode()).hexdigest()


def test_row_hash_escapes_text_and_normalises_decimals(spark):
    df = spark.createDataFrame([('a"b\\', Decimal("100.000")), ("é", Decimal("0.00"))], "s string, d decimal(10,3)")
    out = [r[0] for r in df.select(canonical_payload(df, "x")).collect()]
    assert out[0] == '{"dataset":"x","fields":[["s",["string","a\\"b\\\\"]],["d",["decimal","100"]]]}'
    assert out[1] == '{"dataset":"x","fields":[["s",["string","é"]],["d",["decimal","0"]]]}'


SMALL = Contract("notes", "id", (Field("id"), Field("body", nullable=True), Field("n", "integer")))


@pytest.mark.parametrize("kind", ["decimal(18,2)", "decimal(9,6)", "decimal(20,0)", "decimal(26,6)", "decimal(38,18)", "decimal(10,7)"])
def test_decimals_have_the_text_of_eighteen_digits_at_their_own_scale(spark, kind):
    precision, scale = map(int, kind[8:-1].split(","))
    whole = "9" * (precision - scale)
    texts = ["0", "-0", "1", "-100", "0.01", "-0.5", "0.000001", "0.0000001", "12.340000", whole, f"-{whole}", f"{whole}.{'9' * scale}" if scale else "10", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr(f"try_cast(t AS {kind})").alias("d"))
    plain = """CASE WHEN d IS NULL THEN '["null",null]' ELSE concat('["decimal","', CASE WHEN d = 0 THEN '0'
               ELSE trim(TRAILING '.' FROM trim(TRAILING '0' FROM CAST(CAST(d AS DECIMAL(38,18)) AS STRING))) END, '"]') END"""
    for got, want in df.select(F.expr(canonical_value("d", kind)), F.expr(plain)).collect():
        assert got == want
    # Casting to 18 digits first costs five times as much.
    assert ("38,18" in canonical_value("d", kind)) == (scale > 6)


def test_scan_numbers_records_with_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,body,n\n1,"two\nlines",1\n2,"say ""hi""",2\n3,,3\n4,short\n')
    (tmp_path / "b.csv").write_text("id,body,n\n9,x,1\n")
    rows = scan_contract(spark, str(tmp_path), SMALL).collect()
    got = {r.id: (r.source_row_number, r.body, r._malformed is not None) for r in rows}
    assert got["1"] == (2, "two\nlines", False) and got["2"] == (3, 'say "hi"', False) and got["3"] == (4, None, False)
    assert got["4"][0] == 5 and got["4"][2] and got["9"][0] == 2
    parsed = ingest.parse_rows(scan_contract(spark, str(tmp_path), SMALL), SMALL)
    bad = ingest.quarantine_rows(parsed, SMALL).collect()
    assert [(r.error_codes, r.source_row_number) for r in bad] == [("COLUMN_COUNT_MISMATCH", 5)]


def test_record_numbers_hold_across_file_blocks(spark, tmp_path):
    lines = ["id,body,n"] + [f"{i},{'x' * 50},{i}" for i in range(5000)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        df = scan_contract(spark, str(tmp_path), SMALL, multiline=False)
        assert df.rdd.getNumPartitions() >= 1
        assert df.where(F.col("source_row_number") != F.col("id").cast("long") + 2).count() == 0 and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_blank_records_are_rejects_with_their_number(spark, tmp_path):
    """Header, a record, a blank one, another: numbers 2, 3 and 4, the blank one with the wrong number of values."""
    (tmp_path / "a.csv").write_bytes(b"id,body,n\r\n1,x,1\r\n\r\n2,y,2\r\n")
    parsed = ingest.parse_rows(scan_contract(spark, str(tmp_path), SMALL), SMALL)
    assert {r.source_row_number: (r.id, r.error_codes) for r in parsed.collect()} == {2: ("1", ""), 3: (None, "COLUMN_COUNT_MISMATCH"), 4: ("2", "")}


@pytest.mark.parametrize("size", [64, 1_000, 1_000_000])
def test_quoted_line_breaks_across_file_blocks(spark, tmp_path, size):
    """As Python's csv reader has it, however the file is cut."""
    import csv
    import io
    import random

    r = random.Random(4)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "body", "n"])
    for i in range(300):
        writer.writerow([i, "".join(r.choice(["a", '"', "\n", ",", " ", "é"]) for _ in range(r.randint(0, 12))), i])
    (tmp_path / "a.csv").write_text(out.getvalue(), newline="")
    wanted = {n: row for n, row in enumerate(csv.reader(io.StringIO(out.getvalue())), start=1) if n > 1}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = scan_contract(spark, str(tmp_path), SMALL)
        if size == 64:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {x.source_row_number: [x.id, x.body or "", x.n] for x in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == wanted


def test_quotes_that_do_not_close_fail_the_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,body,n\n1,"x,1\n2,y,2\n')
    with pytest.raises(Exception, match="quotes do not close"):
        scan_contract(spark, str(tmp_path), SMALL).collect()


def test_header_must_equal_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,body\n1,2,x\n")
    with pytest.raises(Exception, match="header|Header"):
        scan_contract(spark, str(tmp_path), SMALL).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"uote, comma', 1), ("b", None, 2), ("c", " kept ", 3)], "id string, body string, n int")
    write_csv(df, str(tmp_path / "notes.csv"))
    back = scan_contract(spark, str(tmp_path / "notes.csv"), SMALL)
    assert {(r.id, r.body, r.n) for r in back.collect()} == {("a", 'q"uote, comma', "1"), ("b", None, "2"), ("c", " kept ", "3")}
    audit = {r.dataset: (r.status, r.row_count) for r in snapshot_audit(spark, str(tmp_path), [SMALL, TXN]).collect()}
    assert audit == {"notes": ("present", 3), "subscription_transactions": ("missing", 0)}


def test_canonical_text(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), None, True)], "t timestamp_ntz, d date, b boolean")
    assert tuple(canonical_text(df).first()) == ("2024-01-02T03:04:05Z", "", "true")


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "cast(id as string) s")
    a = ingest.snapshot_fingerprint({"x": df, "y": df.limit(5)}).first()
    b = ingest.snapshot_fingerprint({"y": df.limit(5), "x": df.orderBy(F.desc("id")).repartition(7)}).first()
    c = ingest.snapshot_fingerprint({"x": df.where("id <> 3"), "y": df.limit(5)}).first()
    assert a == b and a.snapshot_id != c.snapshot_id


def test_batch_is_loaded_once_and_bad_rows_block_or_go_aside(spark, tmp_path):
    table, audit, aside = (str(tmp_path / n) for n in ("table", "audit", "aside"))
    bad = list(GOOD)
    bad[0], bad[6] = "t2", "weekly"
    parsed = ingest.parse_rows(text_frame(spark, TXN, [tuple(GOOD), tuple(bad)]), TXN)
    with pytest.raises(ingest.RejectedRows):
        ingest.load_batch(parsed, TXN, table, audit, 7, "raw_a")
    assert ingest.load_batch(parsed, TXN, table, audit, 7, "raw_a", "quarantine", aside) == "loaded"
    assert ingest.load_batch(parsed, TXN, table, audit, 7, "raw_a", "quarantine", aside) == "already_loaded"
    assert spark.read.parquet(table).count() == 1 and spark.read.parquet(audit).count() == 1
    # A batch left behind by a dead attempt is an orphan until its own load replaces it.
    spark.read.parquet(table).withColumn("ingestion_batch_id", F.lit(8).cast("long")).write.mode("append").partitionBy("ingestion_batch_id").parquet(table)
    runs = spark.read.parquet(audit)
    assert [r.ingestion_batch_id for r in ingest.orphan_partitions(spark.read.parquet(table), runs).collect()] == [8]
    assert ingest.load_batch(parsed, TXN, table, audit, 8, "raw_b", "quarantine", aside) == "loaded"
    assert spark.read.parquet(table).groupBy("ingestion_batch_id").count().where("count <> 1").count() == 0


def test_lines_are_not_shuffled_again_after_their_quotes_are_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    whole = split_records(text_lines(spark, str(tmp_path / "t.csv")), multiline=False)
    assert [r.record for r in whole.orderBy("source_row_number").collect()] == ["a,b", '1,"x', 'y"', "2,z"]
    plan = whole._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Sort [" in line]
    assert not any("value#" in line or " id#" in line for line in moved) and "SortMergeJoin [source_file" not in plan
