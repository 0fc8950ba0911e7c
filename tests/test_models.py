import math

import pytest

from plan_text import plan_of
from parcela.fixtures import listings
from parcela.operators import models
from parcela.plans.clean import clean_listings
from parcela.sources import tables


@pytest.fixture(scope="module")
def trained(spark, sf):
    rows = clean_listings(listings(spark, sf))
    return models.train_price_model(rows, "random_forest", key="row_id", params={"numTrees": 5, "maxDepth": 4})


def test_training_reports_both_sets(trained):
    rows = {r["Set"]: r for r in trained.metrics.collect()}
    assert set(rows) == {"Training", "Test"}
    assert all(r["model"] == "random_forest" and r["n"] > 50 and math.isfinite(r["MDAPE"]) for r in rows.values())


def test_versions(spark, sf, trained, tmp_path):
    root = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        models.load_latest(spark, root)
    assert [models.save_model(trained, root), models.save_model(trained, root)] == [1, 2]
    version, loaded = models.load_latest(spark, root)
    assert version == 2 and models.registered_models(spark, root).count() == 4
    rows = models.prepare_scoring_input(listings(spark, sf))
    a = models.score_prices(trained.model, rows).select("row_id", "predicted_price").orderBy("row_id").collect()
    b = models.score_prices(loaded, rows).select("row_id", "predicted_price").orderBy("row_id").collect()
    assert a == b and all(r["predicted_price"] > 0 for r in a)
    # An unregistered folder is not picked; without a registry the newest folder is.
    trained.model.write().save(f"{root}/v=0009")
    assert models.load_latest(spark, root)[0] == 2
    bare = str(tmp_path / "bare")
    trained.model.write().save(f"{bare}/v=0003")
    assert models.load_latest(spark, bare)[0] == 3


def test_search_keeps_the_lowest_score(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 10 as double) a", "cast(id % 10 * 2 + 1 as double) label")
    from pyspark.ml.feature import VectorAssembler

    prepared = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    space = {"regParam": ("log", 1e-4, 10.0), "elasticNetParam": ("float", 0.1, 0.9)}
    one, two = (models.random_search(prepared, "elastic_net", 4, 3, key="id", space=space) for _ in range(2))
    assert one.params == two.params and len(one.trials) == 4
    assert one.score == min(s for _, s in one.trials)


def noisy_line(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(400).selectExpr("id", "cast(id % 10 as double) a", "cast(id % 10 * 2 + 1 + id % 7 / 10 as double) label")
    return VectorAssembler(inputCols=["a"], outputCol="features").transform(df)


def test_search_equals_cross_validation(spark):
    from pyspark.ml.tuning import CrossValidator
    from pyspark.sql import functions as F

    space = {"regParam": ("log", 1e-3, 10.0), "elasticNetParam": ("float", 0.1, 0.9)}
    prepared = noisy_line(spark)
    found = models.random_search(prepared, "elastic_net", 4, 3, key="id", space=space)
    estimator = models.make_regressor("elastic_net")
    grid = [{estimator.getParam(n): v for n, v in d.items()} for d in models.draw_params(space, 4)]
    fold = F.pmod(F.xxhash64("id", F.lit(43)), F.lit(3)).cast("int")
    exact = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=models.MedianApeEvaluator(), numFolds=3,
                           foldCol="_fold").fit(prepared.withColumn("_fold", fold)).avgMetrics
    assert [s for _, s in found.trials] == pytest.approx(exact, rel=1e-9) and found.seen == [3] * 4
    assert found.params == models.draw_params(space, 4)[exact.index(min(exact))]


def test_search_stops_poor_draws(spark):
    space = {"regParam": ("log", 1e-3, 10.0)}
    prepared = noisy_line(spark)
    every = models.random_search(prepared, "elastic_net", 8, 3, key="id", space=space)
    half = models.random_search(prepared, "elastic_net", 8, 3, key="id", space=space, keep=0.5)
    assert sorted(half.seen) == [1, 1, 1, 1, 2, 2, 3, 3] and every.seen == [3] * 8
    assert half.params == every.params and half.score == pytest.approx(every.score)
    with pytest.raises(ValueError):
        models.random_search(prepared, "elastic_net", 2, 3, keep=0)


def test_folds_are_partitions_of_one_stored_table(spark):
    folds = models.stored_folds(noisy_line(spark), 4, key="id")
    assert folds.count() == 400 and folds.select("_fold").distinct().count() == 4
    plan = plan_of(folds.filter("_fold <> 2").select("label"))
    assert "PartitionFilters: [isnotnull(_fold" in plan and "Filter (" not in plan


def test_draws_stay_in_the_space():
    for kind, space in models.SEARCH_SPACES.items():
        for draw in models.draw_params(space, 20):
            assert set(draw) == set(space)
            assert all(space[n][1] <= float(v) <= space[n][2] for n, v in draw.items())
            models.make_regressor(kind, draw)
    assert models.draw_params(models.SEARCH_SPACES["xgboost"], 3) == models.draw_params(models.SEARCH_SPACES["xgboost"], 3)
    with pytest.raises(ValueError):
        models.make_regressor("svm")


def test_evaluator(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 2.0)], "label double, prediction double")
    found = models.MedianApeEvaluator()
    assert found.evaluate(df) == 0.5 and not found.isLargerBetter()


def test_scoring_input(spark):
    df = spark.createDataFrame([("50", 4.6, -74.0, "3.0", 2, 3, 2, "x", "Casa", None), ("no", 4.6, -74.0, "3", 2, 3, 2, "x", "Casa", 1.0),
                                ("50", 4.6, -74.0, "3.5", 2, 3, 2, "x", "Casa", 1.0), ("50", 4.6, -74.0, "3", 2, 3, 2, None, "Casa", 1.0)],
                               "AREA string, LATITUDE double, LONGITUDE double, ROOMS string, BATHROOMS int, STRATUM int, BEDROOMS int, "
                               "ANTIQUITY string, PROPERTY_TYPE string, GARAGE double")
    rows = models.prepare_scoring_input(df).collect()
    assert len(rows) == 1
    assert (rows[0]["AREA"], rows[0]["ROOMS"], rows[0]["GARAGE"], rows[0]["FLOOR"]) == (50.0, 3, 0.0, 0.0)
    assert models.prepare_scoring_input(df, fill_null=False).first()["GARAGE"] is None
    with pytest.raises(ValueError):
        models.prepare_scoring_input(df.drop("AREA"))


def test_bundle(spark, tmp_path, sf):
    from parcela.operators import features, filters

    rows = filters.training_rows(listings(spark, sf))
    fitted = features.feature_pipeline().fit(rows)
    tables.save_bundle(rows, rows.limit(0), fitted, str(tmp_path / "b"))
    train, test, again = tables.load_bundle(spark, str(tmp_path / "b"))
    assert train.count() == rows.count() and test.count() == 0
    assert again.transform(train).select("features").first() is not None


def test_refused_requests_carry_their_reasons(spark, tmp_path):
    schema = ("AREA string, LATITUDE double, LONGITUDE double, ROOMS string, BATHROOMS int, STRATUM int, BEDROOMS int, ANTIQUITY string, "
              "PROPERTY_TYPE string, extra string")
    good = ("50", 4.6, -74.0, "3.0", 2, 3, 2, "x", "Casa", "a")
    rows = [good, ("no", *good[1:]), (*good[:3], "3.5", None, *good[5:]), ("NaN", float("nan"), *good[2:]), good]
    ready, refused = models.split_scoring_input(spark.createDataFrame(rows, schema), str(tmp_path / "r"))
    assert ready.count() == 2 and ready.first()["ROOMS"] == 3 and ready.first()["GARAGE"] == 0.0
    got = {(r["AREA"], r["ROOMS"]): r["reasons"] for r in refused.collect()}
    assert got["no", "3.0"] == ["AREA is not a number: no"]
    assert got["50", "3.5"] == ["ROOMS is not a whole number: 3.5", "BATHROOMS is missing"]
    assert got["NaN", "3.0"] == ["AREA is not a number: NaN", "LATITUDE is not a number: NaN"] and len(got) == 3
    none, all_rows = models.split_scoring_input(spark.createDataFrame(rows, schema).drop("STRATUM"), str(tmp_path / "s"))
    assert none.count() == 0 and all("STRATUM is missing" in r["reasons"] for r in all_rows.collect())
    empty, nothing = models.split_scoring_input(spark.createDataFrame([], schema), str(tmp_path / "e"))
    assert empty.count() == nothing.count() == 0


def test_two_writers_claim_two_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "models")
    assert models.claim_version(spark, root) == 1
    # Both writers saw the same folders: neither has stored a model yet.
    assert models.claim_version(spark, root) == 2
    monkeypatch.setattr(models, "_stored_versions", lambda *a: [(1, 0)])
    assert models.claim_version(spark, root) == 3
    monkeypatch.undo()
    # A claim without a registered model is not picked.
    with pytest.raises(FileNotFoundError):
        models.load_latest(spark, root)
