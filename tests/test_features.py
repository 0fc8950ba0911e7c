from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from parcela.operators import features
from parcela.schema import FeatureSpec
from parcela.session import materialize


def numpy_scores(train, x, percentile=95, knots=1000):
    """Cap, log1p, quantile-to-normal, written with numpy."""
    cap = np.percentile(train, percentile)
    logs, v = np.log1p(np.minimum(train, cap)), np.log1p(np.minimum(x, cap))
    n = min(knots, len(train))
    refs = np.linspace(0, 1, n)
    levels = np.maximum.accumulate(np.percentile(logs, refs * 100))
    p = 0.5 * (np.interp(v, levels, refs) - np.interp(-v, -levels[::-1], -refs[::-1]))
    p[v + 1e-7 > levels[-1]] = 1
    p[v - 1e-7 < levels[0]] = 0
    nd = NormalDist()
    low, high = nd.inv_cdf(1e-7 - np.spacing(1)), nd.inv_cdf(1 - (1e-7 - np.spacing(1)))
    return np.array([low if q <= 0 else high if q >= 1 else min(max(nd.inv_cdf(q), low), high) for q in p])


@pytest.mark.parametrize("n,whole", [(50, False), (3000, False), (3000, True)])
def test_target_scores_equal_numpy(spark, n, whole):
    rng = np.random.default_rng(n)
    y = rng.lognormal(13, 1, n)
    y = np.round(y / 2e5) * 2e5 if whole else y
    df = materialize(spark.createDataFrame(pd.DataFrame({"i": range(n), "PRICE": y})))
    model = features.TargetTransform().fit(df)
    new = np.concatenate([y, [0.0, y.max() * 3, float(np.median(y)) + 0.123]])
    ndf = spark.createDataFrame(pd.DataFrame({"i": range(len(new)), "PRICE": new}))
    out = model.transform(ndf).orderBy("i").toPandas()
    np.testing.assert_allclose(out["label"], numpy_scores(y, new), rtol=1e-8, atol=1e-8)
    assert list(out.columns) == ["i", "PRICE", "label"]
    back = model.inverse(model.transform(df), "label", "back").toPandas()
    inside = (back.PRICE > y.min()) & (back.PRICE < np.percentile(y, 95) * (1 - 1e-6))
    np.testing.assert_allclose(back["back"][inside], back["PRICE"][inside], rtol=1e-6)


def test_target_of_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "PRICE double")
    model = features.TargetTransform().fit(df)
    labels = [r["label"] for r in model.transform(df).collect()]
    assert labels[0] == labels[1] < -5 and labels[2] is None


def test_inverse_of_extremes(spark):
    df = spark.range(200).selectExpr("cast(id + 1 as double) PRICE")
    model = features.TargetTransform().fit(df)
    scores = spark.createDataFrame([(-30.0,), (30.0,), (None,)], "z double")
    found = [r["p"] for r in model.inverse(scores, "z", "p").collect()]
    assert found[0] == pytest.approx(1.0) and found[1] == pytest.approx(np.percentile(range(1, 201), 95)) and found[2] is None


def test_trim_learns_all_limits_at_fit(spark):
    pdf = pd.DataFrame({"a": np.arange(101.0), "b": np.arange(101.0)[::-1]})
    df = spark.createDataFrame(pdf)
    model = features.TrimColumns(columns=["a", "zz", "b"], quantile=[0.1, 0.3, 0.2], tail=["both", "upper", "lower"]).fit(df)
    kept = model.transform(df).toPandas()
    expected = pdf[(pdf.a >= 10) & (pdf.a <= 90) & (pdf.b >= 20)]
    assert sorted(kept.a) == sorted(expected.a)
    assert features.TrimColumns(columns=["a"], quantile=0.25, tail="upper").fit(df).transform(df).count() == 76
    with pytest.raises(ValueError):
        features.TrimColumns(columns=["a"], tail="left")


def test_drop_null_columns_is_strict(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 3.0)], "id int, empty string, half double")
    model = features.DropNullColumns(threshold=0.5).fit(df)
    assert model.transform(df).columns == ["id", "half"]


def test_clip(spark):
    df = spark.range(101).selectExpr("id", "cast(id as double) v")
    assert features.clip_above(df, "v", 95).agg({"v": "max"}).first()[0] == 95.0


def test_scaler_uses_median_and_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (None, 7.0), (9.0, None)], "a double, c double")
    model = features.NumericScaler(columns=["a", "c"]).fit(df)
    rows = model.transform(df).toPandas()
    filled = np.array([1.0, 2.0, 2.0, 9.0])
    np.testing.assert_allclose(rows["a_scaled"], (filled - filled.mean()) / filled.std())
    assert list(rows["c_scaled"]) == [0.0] * 4


def test_unknown_category_is_all_zero_and_survives_saving(spark, tmp_path):
    spec = FeatureSpec(numeric=("n",), categorical=("c",))
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None)], "n double, c string")
    model = features.feature_pipeline(spec).fit(df)
    model.write().save(str(tmp_path / "m"))
    new = spark.createDataFrame([(2.0, "a"), (2.0, "b"), (2.0, "zz"), (2.0, None)], df.schema)
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        vectors = [list(r[0])[1:] for r in m.transform(new).select(vector_to_array("features")).collect()]
        assert vectors == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_estimators_can_be_saved(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id as double) PRICE", "cast(null as string) gone")
    for i, model in enumerate([features.TargetTransform().fit(df), features.DropNullColumns().fit(df),
                               features.TrimColumns(columns=["PRICE"], quantile=0.1).fit(df)]):
        path = str(tmp_path / str(i))
        model.write().save(path)
        again = type(model).load(path)
        assert again.transform(df).collect() == model.transform(df).collect()


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5000)
    train, test = features.hash_split(df, "id")
    again, _ = features.hash_split(df.repartition(13), "id")
    assert sorted(r[0] for r in train.collect()) == sorted(r[0] for r in again.collect())
    assert train.count() + test.count() == 5000 and 900 < test.count() < 1100


def test_target_scores_from_a_sketch(spark):
    rng = np.random.default_rng(9)
    y = rng.lognormal(13, 1, 4000)
    df = materialize(spark.createDataFrame(pd.DataFrame({"i": range(4000), "PRICE": y})))
    model = features.TargetTransform(method="approx").fit(df)
    out = model.inverse(model.transform(df), "label", "back").orderBy("i").toPandas()
    inside = (y > np.quantile(y, 0.01)) & (y < np.quantile(y, 0.94))
    np.testing.assert_allclose(out["label"][inside], numpy_scores(y, y)[inside], atol=0.02)
    np.testing.assert_allclose(out["back"], np.minimum(y, np.percentile(y, 95)), rtol=1e-6)
