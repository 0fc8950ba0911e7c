import os

from parcela.schema import LISTING
from parcela.session import materialize, shared_dir, small_or_stored
from parcela.sources import tables


def test_fallback_order(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / "fixed.csv").write_text("PRICE;AREA\n1;2\n")
    find = lambda: tables.load_listings(spark, f"{base}/table", f"{base}/properties_*.csv", f"{base}/fixed.csv")
    df, used = find()
    assert used == "fallback" and df.first()["PRICE"] == 1
    for i, name in enumerate(["properties_b.csv", "properties_a.csv"]):
        (tmp_path / name).write_text(f"PRICE,AREA\n{i + 5},2\n")
        os.utime(tmp_path / name, (1_700_000_000 + i * 60,) * 2)
    df, used = find()
    assert used == "properties_a.csv" and df.first()["PRICE"] == 6
    spark.range(3).selectExpr("id AS PRICE", "id AS _id", "id AS batch_id").write.parquet(f"{base}/table")
    df, used = find()
    assert used == "table" and df.columns == ["PRICE"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 1.5), (None, None)], "t string, v double")
    tables.write_csv(df, str(tmp_path / "c"), sep=";")
    assert sorted(tables.read_csv(spark, str(tmp_path / "c"), df.schema, sep=";").collect(), key=str) == sorted(df.collect(), key=str)


def test_catalogue(spark):
    spark.range(1).createOrReplaceTempView("parcela_seen")
    assert tables.list_tables(spark).filter("name = 'parcela_seen' AND temporary").count() == 1


def test_stored_copy_keeps_types(spark):
    df = spark.createDataFrame([], LISTING)
    assert materialize(df).dtypes == df.dtypes
    assert shared_dir(spark)


def test_small_side_is_a_local_relation(spark):
    small = small_or_stored(spark.range(5).selectExpr("id", "cast(id as string) s"))
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString()
    stored = small_or_stored(spark.range(50), max_rows=10)
    assert "parquet" in stored._jdf.queryExecution().executedPlan().toString() and stored.count() == 50
