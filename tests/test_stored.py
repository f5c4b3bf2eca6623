"""Stored layers: digest trees find what was planted, and read nothing where layers agree."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.functions.lazy import LazyFrames
from tidemark.operators import quality, star
from tidemark.plans import warehouse_queries
from tidemark.sources.layers import RULES, layers
from tidemark.operators.quality import row_violation
from tidemark.sources.stored import LEAVES, StoredTables, differing_leaves, input_stamp, leaf_digests, leaf_of, store_root
from tidemark.sources.tables import Warehouse

STAMP = ["source_row_number", "row_hash"]


def rows(spark, n=5_000):
    return spark.range(n).selectExpr("id AS user_id", "1L AS ingestion_batch_id", "id + 2 AS source_row_number", "sha2(cast(id AS string), 256) AS row_hash", "7L AS validation_run_id")


def stored(spark, tmp_path, name, frames):
    return StoredTables(spark, f"{tmp_path}/{name}", LazyFrames({k: (lambda v=v: v) for k, v in frames.items()}), {k: ["ingestion_batch_id", "user_id"] for k in frames}, STAMP)


def test_a_planted_hash_and_row_number_are_found_and_only_their_leaves_differ(spark, tmp_path):
    good = rows(spark)
    bad = (good.withColumn("row_hash", F.when(F.col("user_id") == 1234, "wrong").otherwise(F.col("row_hash")))
           .withColumn("source_row_number", F.when(F.col("user_id") == 77, 1).otherwise(F.col("source_row_number"))).where("user_id <> 4000"))
    staging, analytics = stored(spark, tmp_path, "s", {"users": good}), stored(spark, tmp_path, "a", {"dim_user": bad})
    s, a = staging.all_digests(), analytics.all_digests(star.DATASET_OF)
    apart = {r.leaf for r in differing_leaves(s, a).collect()}
    wanted = {r[0] for r in good.where("user_id IN (1234, 77, 4000)").select(leaf_of("ingestion_batch_id", "user_id")).collect()}
    assert apart == wanted
    got = star.lineage_by_digest(staging, analytics, {"users": "user_id"}).first()
    assert (got.staging_row_count, got.matched_analytics_rows, got.missing_analytics_rows, got.lineage_mismatches) == (5_000, 4_999, 1, 2)
    whole = star.lineage_reconciliation({"users": staging["users"]}, {"users": analytics["dim_user"]}, {"users": "user_id"}).first()
    assert {c: got[c] for c in whole.asDict()} == whole.asDict()


def test_equal_layers_are_settled_by_their_roots(spark, tmp_path):
    staging, analytics = stored(spark, tmp_path, "s", {"users": rows(spark)}), stored(spark, tmp_path, "a", {"dim_user": rows(spark).repartition(3)})
    assert differing_leaves(staging.all_digests(), analytics.all_digests(star.DATASET_OF)).isEmpty()
    result = star.lineage_by_digest(staging, analytics, {"users": "user_id"})
    assert not any(f.endswith("/dim_user") or "/dim_user/" in f for f in result.inputFiles())  # digests only
    assert result.first().matched_analytics_rows == 5_000


def test_two_batches_differ_in_one(spark, tmp_path):
    good = rows(spark, 500).unionByName(rows(spark, 500).withColumn("ingestion_batch_id", F.lit(2).cast("long")))
    bad = good.withColumn("row_hash", F.when((F.col("user_id") == 9) & (F.col("ingestion_batch_id") == 2), "wrong").otherwise(F.col("row_hash")))
    found = star.lineage_by_digest(stored(spark, tmp_path, "s", {"users": good}), stored(spark, tmp_path, "a", {"dim_user": bad}), {"users": "user_id"})
    assert {r.ingestion_batch_id: (r.staging_row_count, r.lineage_mismatches) for r in found.collect()} == {1: (500, 0), 2: (500, 1)}


def test_repeated_keys_are_compared_by_row(spark, tmp_path):
    twice = rows(spark, 50).unionByName(rows(spark, 1).withColumn("row_hash", F.lit("second")))
    frames = stored(spark, tmp_path, "s", {"users": twice}), stored(spark, tmp_path, "a", {"dim_user": twice})
    got = star.lineage_by_digest(*frames, {"users": "user_id"}).first()
    whole = star.lineage_reconciliation({"users": twice}, {"users": twice}, {"users": "user_id"}).first()
    assert {c: got[c] for c in whole.asDict()} == whole.asDict() and got.lineage_mismatches == 2


def test_tables_are_written_once_and_rows_of_a_leaf_lie_together(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return rows(spark)

    make = lambda: StoredTables(spark, f"{tmp_path}/once", LazyFrames({"users": build}), {"users": ["user_id"]}, STAMP)
    first, second = make(), make()
    assert first["users"].count() == second["users"].count() == first["users"].count() == 5_000 and len(calls) == 1
    assert first["users"].agg(F.max("leaf")).first()[0] < LEAVES
    plan = first["users"].where("leaf = 5").select("user_id")._jdf.queryExecution().toString()
    assert "EqualTo(leaf,5)" in plan


def test_the_store_follows_the_input_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    one = input_stamp(spark, folder)
    assert input_stamp(spark, folder) == one and store_root(spark, folder).endswith(one)
    spark.range(3).write.mode("append").parquet(f"{folder}/t.parquet")
    assert input_stamp(spark, folder) != one


def test_empty_tables(spark, tmp_path):
    none = rows(spark).where("false")
    staging, analytics = stored(spark, tmp_path, "s", {"users": none}), stored(spark, tmp_path, "a", {"dim_user": none})
    assert star.lineage_by_digest(staging, analytics, {"users": "user_id"}).count() == 0 and staging.counts("n").count() == 0


@pytest.mark.parametrize("name", list(RULES))
def test_raw_and_staging_of_the_warehouse(spark, sf_dir, name):
    own = layers(Warehouse(spark, sf_dir))
    assert own.staging[name].where("leaf IS NULL OR validation_run_id IS NULL").isEmpty()
    assert own.raw.digests(name).agg(F.sum("n")).first()[0] == own.raw[name].count()


def exchanged(df):
    """The columns that each exchange of the plan moves."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return [line for line in final.splitlines() if "Exchange hashpartitioning" in line], final


def test_counts_shuffle_no_key_and_staged_rows_are_not_written_twice(spark, sf_dir, tmp_path):
    own = layers(Warehouse(spark, sf_dir))
    counts = own.staging.counts("n")
    rows, plan = exchanged(counts)
    assert "subscription_id" not in "".join(rows) and "transaction_id" not in "".join(rows)
    assert {r.dataset_name for r in counts.collect()} <= set(RULES)
    for n in ("users", "subscriptions"):
        assert set(own.staging[n].inputFiles()) == set(own.raw[n].inputFiles())
        broken = own.raw[n].where(~F.col("accepted")).count()
        assert own.staging[n].count() == own.raw[n].count() - broken
        assert own.raw[n].where(F.col("accepted") == row_violation(RULES[n])).isEmpty()


def test_digests_count_repeated_keys_without_moving_stamps(spark, tmp_path):
    twice = rows(spark, 50).unionByName(rows(spark, 2)).unionByName(rows(spark, 1))
    tables = stored(spark, tmp_path, "s", {"users": twice})
    got = tables.digests("users").agg(F.sum("n"), F.sum("repeats")).first()
    assert tuple(got) == (53, 3)
    moved, _ = exchanged(leaf_digests(tables["users"], STAMP, ["ingestion_batch_id", "user_id"]))
    assert moved and not any("user_id" in m for m in moved)


def one_by_one(s, installation, user, how, subscription=None):
    """Every dimension joined to the whole rows."""
    b = "ingestion_batch_id"
    out = s.join(installation.select(b, "installation_id", "installation_key"), [b, "installation_id"]).join(user.select(b, "user_id", "user_key"), [b, "user_id"], how)
    return out if subscription is None else out.join(subscription.select(b, "subscription_id", "subscription_key"), [b, "subscription_id"])


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("subscribed", [False, True])
def test_keys_resolved_for_distinct_ids_equal_joins_of_whole_rows(spark, how, subscribed):
    """Unknown, null and repeated ids on both sides."""
    fact = spark.createDataFrame([(1, i, u, s, f"r{n}") for n, (i, u, s) in enumerate(
        [(1, 1, 1), (1, 1, 1), (1, None, 1), (2, 2, 2), (2, 9, 2), (9, 2, 2), (None, 1, 1), (3, 3, None), (3, 3, 3), (None, None, 3)])] + [(None, 1, 1, 1, "r")],
        "ingestion_batch_id long, installation_id long, user_id long, subscription_id long, place string")
    one = lambda name: spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 2, 21), (1, 3, 30), (1, None, 40), (None, 1, 50)],
                                             f"ingestion_batch_id long, {name}_id long, {name}_key long")
    dims = [one("installation"), one("user")], one("subscription") if subscribed else None
    got, wanted = star._resolved(fact, *dims[0], how, dims[1]), one_by_one(fact, *dims[0], how, dims[1])
    as_rows = lambda df: sorted(map(str, df.select(*sorted(wanted.columns)).collect()))
    assert as_rows(got) == as_rows(wanted)


def test_relationships_move_no_hash_and_find_what_is_planted(spark):
    """A fact row under another user's key, one under an unknown key, one without user; repeated facts count by their greatest id."""
    wide = "ingestion_batch_id long, event_id long, row_hash string, installation_id long, user_id long"
    staged = spark.createDataFrame([(1, k, f"h{k}", k, None if k == 4 else k) for k in range(1, 8)], wide)
    fact = spark.createDataFrame([(1, k, f"h{k}", 100 + k, {3: 201, 4: None, 5: 999}.get(k, 200 + k)) for k in range(1, 8)] + [(1, 6, "h6", 106, 201), (1, 7, "h7", 106, 207)],
                                 "ingestion_batch_id long, event_id long, row_hash string, installation_key long, user_key long")
    none = lambda df, *c: df.where("false").select(*df.columns, *[F.lit(None).cast(t).alias(n) for n, t in c])
    dim = lambda name, base: spark.range(1, 8).select(F.lit(1).cast("long").alias("ingestion_batch_id"), F.col("id").alias(f"{name}_id"), (F.col("id") + base).alias(f"{name}_key"))
    keys = {"users": "user_id", "product_events": "event_id", "subscriptions": "subscription_id", "subscription_transactions": "transaction_id", "experiment_assignments": "assignment_id"}
    extra = [("subscription_id", "long"), ("transaction_id", "string"), ("assignment_id", "string")]
    s = {n: none(staged, *extra) for n in keys} | {"product_events": staged}
    empty = none(fact, *extra, ("subscription_key", "long"))
    built = {"dim_installation": dim("installation", 100), "dim_user": dim("user", 200).select("*", F.lit("x").alias("row_hash"), F.lit(101).cast("long").alias("installation_key")),
             "fact_product_event": fact, "fact_subscription": empty, "fact_subscription_transaction": empty, "fact_experiment_assignment": empty}
    result = star.relationship_checks(s, built, keys)
    got = {r.dataset_name: r.violation_count for r in result.collect()}
    assert got == {n: 0 for n in keys} | {"product_events": 2}
    moved, _ = exchanged(result)
    assert not any("row_hash" in m for m in moved)


def test_snapshot_bounds_stores_the_raw_tables_it_reads_and_no_other(spark, sf_dir, tmp_path):
    folder = shutil.copytree(sf_dir, tmp_path / "tables")
    w = Warehouse(spark, str(folder))
    assert warehouse_queries.bounds(w).count() == 2 * len(warehouse_queries.DATED_COLUMNS)
    raw = layers(w).raw.root.removeprefix("file:")
    assert {n for n in os.listdir(raw) if n != "_drafts"} == set(warehouse_queries.DATED_COLUMNS)


def test_event_entity_counts_stores_no_raw_table_and_equals_the_check_of_the_stored_ones(spark, sf_dir, tmp_path):
    folder = shutil.copytree(sf_dir, tmp_path / "tables")
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "user_id")):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # Keys that occur twice, and keys that are null.
        odd = df.unionByName(df.where(F.col(key) % 5 == 0)).unionByName(df.where(F.col(key) % 11 == 0).withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
        os.chmod(folder, 0o755)
        os.remove(folder / f"{name}.parquet")
        odd.write.parquet(str(folder / f"{name}.parquet"))
    w = Warehouse(spark, str(folder))
    got = sorted(map(tuple, warehouse_queries.QUERIES["dq_event_entity_counts"](w).collect()))
    assert not os.path.exists(layers(w).raw.root.removeprefix("file:"))
    assert got == sorted(map(tuple, quality.event_entity_counts(layers(w).raw).collect()))
    assert len(got) == 6 and any(r[3] for r in got)
