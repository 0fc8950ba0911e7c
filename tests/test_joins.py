import pathlib
import re

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from parcela.operators import cleaning, joins
from parcela.session import shared_dir
from parcela.sources import sinks


def test_stored_rows_win(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "_id string, n int, OPERATION_TYPE string")
    sinks.insert_if_absent(first, path, order=[F.asc("n")])
    again = spark.createDataFrame([("a", 9, "x"), ("c", 3, "x")], first.schema)
    for _ in range(2):
        sinks.insert_if_absent(again, path, order=[F.asc("n")])
    stored = spark.read.parquet(path)
    assert sorted((r["_id"], r["n"]) for r in stored.collect()) == [("a", 1), ("b", 1), ("c", 3)]


@pytest.mark.parametrize("bound", [1, 1000])
def test_sides_beyond_the_bound(spark, monkeypatch, bound):
    small = joins.small_or_stored
    monkeypatch.setattr(joins, "small_or_stored", lambda side: small(side, bound))
    target = spark.range(50).selectExpr("cast(id as string) _id", "id AS n")
    batch = spark.range(40, 60).selectExpr("cast(id as string) _id", "-id AS n")
    assert sorted(int(r["_id"]) for r in joins.unseen_rows(batch, target).collect()) == list(range(50, 60))
    merged = {r["_id"]: r["n"] for r in joins.upsert(target, batch, "_id").collect()}
    assert len(merged) == 60 and merged["45"] == -45 and merged["3"] == 3
    assert joins.cascade_delete(target, batch).count() == 40


def test_hot_key_in_a_batch(spark):
    batch = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id as string) END AS _id", "id AS n")
    empty = spark.createDataFrame([], batch.schema)
    found = joins.unseen_rows(batch, empty, order=[F.desc("n")])
    assert found.count() == 6001
    assert found.filter("_id = 'hot'").first()["n"] == 8997


def test_append_and_union(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.createDataFrame([("Casa", 1)], "PROPERTY_TYPE string, PRICE int")
    sinks.append_rows(one, path)
    sinks.append_rows(one.unionAll(one), path)
    assert spark.read.parquet(path).count() == 3
    wide = joins.union_listings(one, one.withColumn("CITY", F.lit("x")))
    assert wide.columns == ["PROPERTY_TYPE", "PRICE", "CITY"] and wide.filter("CITY IS NULL").count() == 1


def test_first_per_key_prunes_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = plan_of(cleaning.dedup_latest(df, ["o_custkey"], "o_orderdate", "o_orderkey"))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_insert_reads_only_the_prefixes_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(500).selectExpr("cast(id as string) _id", "id AS n", "'x' AS OPERATION_TYPE")
    sinks.insert_if_absent(rows, path)
    batch = spark.createDataFrame([("7", 0, "x"), ("new", 1, "x"), (None, 2, "x")], "_id string, n bigint, OPERATION_TYPE string")
    plan = plan_of(sinks.keys_in_reach(spark.read.parquet(path), batch, "_id").select("_id"))
    line = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "key_prefix_of_64" in line and (" IN (" in line or "INSET" in line)
    before = len(list(pathlib.Path(shared_dir(spark)).iterdir()))
    for _ in range(3):
        sinks.insert_if_absent(batch, path)
        assert len(list(pathlib.Path(shared_dir(spark)).iterdir())) == before
    stored = sinks.read_keyed(spark, path)
    assert stored.count() == 502 and stored.columns == ["_id", "n", "OPERATION_TYPE"]
    assert {r["n"] for r in stored.filter("_id IS NULL OR _id IN ('7', 'new')").collect()} == {7, 1, 2}


def test_insert_continues_a_table_without_prefixes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "_id string, n int, OPERATION_TYPE string")
    rows.write.partitionBy("OPERATION_TYPE").parquet(path)
    sinks.insert_if_absent(spark.createDataFrame([("a", 9, "x"), ("c", 3, "x")], rows.schema), path)
    assert sorted((r["_id"], r["n"]) for r in sinks.read_keyed(spark, path).collect()) == [("a", 1), ("b", 1), ("c", 3)]


@pytest.mark.parametrize("bound", [0, 1000])
def test_hashes_beyond_the_bounds(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "MAX_SMALL_ROWS", bound)
    monkeypatch.setattr(joins, "MAX_BROADCAST_HASHES", bound)
    # Keys of one hash are still told apart.
    monkeypatch.setattr(joins, "key_hash", lambda key: F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(7)))
    batch = spark.range(60).selectExpr("if(id = 59, null, cast(id % 50 as string)) AS _id", "id AS n")
    target = spark.range(45, 99).selectExpr("cast(id as string) _id")
    found = {r["_id"]: r["n"] for r in joins.unseen_rows(batch, target, order=[F.desc("n")]).collect()}
    assert found == {None: 59} | {str(i): i + 50 if i < 9 else i for i in range(45)}
    numbers = spark.range(5).selectExpr("cast(id as int) _id")
    assert joins.unseen_rows(numbers, spark.range(3).selectExpr("id AS _id")).count() == 2


def test_many_keys_do_not_shuffle_the_target(spark, monkeypatch):
    plans, small = [], joins.small_or_stored
    monkeypatch.setattr(joins, "small_or_stored", lambda df: plans.append(plan_of(df)) or small(df))
    batch = spark.range(25_000).selectExpr("cast(id as string) _id")
    target = spark.range(24_990, 30_000).selectExpr("cast(id as string) _id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert joins.unseen_rows(batch, target).count() == 24_990
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[-1] and "SortMergeJoin" not in plans[-1]


@pytest.mark.parametrize("prefixes", [64, 3, None])
def test_more_hashes_than_a_broadcast_holds_do_not_shuffle_the_target(spark, tmp_path, monkeypatch, prefixes):
    path = str(tmp_path / "t")
    rows = spark.range(2000, 6000).selectExpr("if(id = 2000, null, cast(id as string)) _id", "id AS n", "'x' AS OPERATION_TYPE")
    rows.write.partitionBy("OPERATION_TYPE").parquet(path) if prefixes is None else sinks.insert_if_absent(rows, path, prefixes=prefixes)
    plans, finished, small = [], [], joins.small_or_stored
    monkeypatch.setattr(joins, "small_or_stored", lambda df: plans.append((plan_of(df), df._jdf.queryExecution().optimizedPlan().toString())) or small(df))
    monkeypatch.setattr(joins, "MAX_BROADCAST_HASHES", 1000)
    batch = spark.range(3000).selectExpr("if(id = 0, null, cast(id as string)) _id", "-id AS n", "'x' AS OPERATION_TYPE")
    sinks.insert_if_absent(batch, path, finish=lambda df: finished.append(plan_of(df)) or df)
    assert len(plans) == 4 and all("BroadcastHashJoin" in p and "ShuffledHashJoin" not in p for p, _ in plans)
    # Each slice reads its own partitions, if the prefixes can be told apart by slices.
    slices = [re.findall(r"key_prefix_of_64#\d+ % 4\) = (\d)", p) for _, p in plans]
    assert slices == ([["0"], ["1"], ["2"], ["3"]] if prefixes == 64 else [[]] * 4)
    assert ("Sort [" in finished[0]) == (prefixes is not None)
    stored = {r["_id"]: r["n"] for r in sinks.read_keyed(spark, path).collect()}
    assert sinks.read_keyed(spark, path).count() == len(stored) == 6000
    assert stored[None] == 2000 and stored["1999"] == -1999 and stored["2001"] == 2001 and "2000" in stored


def test_an_insert_counts_its_hashes_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(500).selectExpr("cast(id as string) _id", "id AS n", "'x' AS OPERATION_TYPE")
    sinks.insert_if_absent(rows, path)
    batch = spark.range(400, 900).selectExpr("cast(id % 600 as string) _id", "-id AS n", "'x' AS OPERATION_TYPE")
    spark.sparkContext.setJobGroup("one-insert", "")
    try:
        sinks.insert_if_absent(batch, path, order=[F.asc("n")])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-insert"))
    # Hashes, repeats and prefixes are counted in one job: 13 in all, 16 with a job for each.
    assert 0 < jobs <= 14
    stored = {r["_id"]: r["n"] for r in sinks.read_keyed(spark, path).collect()}
    assert stored == {str(i): i if i < 500 else -i for i in range(600)}
