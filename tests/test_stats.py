import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcela.operators import models, stats


def test_market_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "OPERATION_TYPE string, PRICE double, AREA double")
    assert sorted(map(tuple, stats.market_stats(empty).collect())) == [("Arriendo", 0, 0.0, 0.0), ("Venta", 0, 0.0, 0.0)]
    unpriced = spark.createDataFrame([("Venta", None, None)], empty.schema)
    assert ("Venta", 1, None, None) in list(map(tuple, stats.market_stats(unpriced).collect()))
    assert tuple(stats.dashboard_summary(empty).first()) == (0, 0, 0, 0)


def test_dashboard_rounds_halves_up(spark):
    df = spark.createDataFrame([("Venta", 2_500_000.0, 10.5), ("Arriendo", 1_500.0, 1.0)], "OPERATION_TYPE string, PRICE double, AREA double")
    assert tuple(stats.dashboard_summary(df).first()) == (2, 3, 2, 11)


def signature_by_loop(requests, pages, items):
    """The rule in plain Python: figures over all items of the operation so far."""
    out = {}
    for operation in dict.fromkeys(o for o, _ in requests):
        seen = []
        for op, prop in requests:
            if op != operation:
                continue
            ok = sum(1 for o, p, good in pages if (o, p) == (op, prop) and good)
            bad = sum(1 for o, p, good in pages if (o, p) == (op, prop) and not good)
            seen += [(kind, price) for o, p, kind, price in items if (o, p) == (op, prop)]
            if seen:
                own = [price for kind, price in seen if kind == prop]
                priced = [x for x in own if x is not None]
                out[op, prop] = (ok, bad, 100 * ok / (ok + bad) if ok + bad else None, len(own), sum(priced) / len(priced) if priced else None)
    return out


def test_signature(spark):
    requests = [("Arriendo", "Casa"), ("Arriendo", "Lote"), ("Arriendo", "Finca"), ("Venta", "Casa"), ("Venta", "Lote"), ("Venta", "Finca")]
    pages = [("Arriendo", "Casa", True), ("Arriendo", "Casa", False), ("Arriendo", "Lote", True), ("Venta", "Lote", True), ("Venta", "Casa", False)]
    items = [("Arriendo", "Casa", "Casa", 10.0), ("Arriendo", "Casa", "Lote", 4.0), ("Arriendo", "Lote", "Lote", None),
             ("Venta", "Lote", "Casa", 7.0), ("Venta", "Lote", "Lote", 8.0), ("Venta", "Lote", None, 9.0)]
    order = {"Casa": 0, "Lote": 1, "Finca": 2}
    found = stats.scrape_signature(
        spark.createDataFrame([(o, p, order[p]) for o, p in requests], "operation string, property string, position int"),
        spark.createDataFrame(pages, "operation string, property string, ok boolean"),
        spark.createDataFrame(items, "operation string, property string, PROPERTY_TYPE string, PRICE double"), "t")
    got = {(r["operation"], r["property"]): tuple(r)[3:] for r in found.collect()}
    assert got == signature_by_loop(requests, pages, items)
    assert ("Venta", "Casa") not in got


def test_first_run_has_no_change(spark):
    df = spark.createDataFrame([("b", "Casa", "Venta", 5, 2.0, 100.0), ("a", "Casa", "Venta", 3, None, 50.0)],
                               "timestamp string, property string, operation string, total_properties long, mean_price double, success_rate double")
    rows = {r["timestamp"]: r for r in stats.compare_signatures(df).collect()}
    assert rows["a"]["total_properties_change"] is None
    assert (rows["b"]["previous_timestamp"], rows["b"]["total_properties_change"], rows["b"]["mean_price_change"], rows["b"]["success_rate_change"]) == ("a", 2, None, 50.0)


def numpy_metrics(y, z):
    r = y - z
    with np.errstate(divide="ignore", invalid="ignore"):
        mdape = np.median(np.abs(r / y))
    sst = np.sum((y - y.mean()) ** 2)
    return {"MAPE": np.mean(np.abs(r) / np.maximum(np.abs(y), np.finfo(float).eps)), "MDAPE": mdape, "R2": 1 - np.sum(r ** 2) / sst,
            "explained_variance": 1 - np.var(r) / np.var(y), "MAE": np.mean(np.abs(r)), "RMSE": np.sqrt(np.mean(r ** 2)),
            "mean_residual": r.mean(), "std_residual": r.std(), "max_error": np.abs(r).max()}


@pytest.mark.parametrize("zeros", [0, 3])
def test_metrics_equal_numpy(spark, zeros):
    rng = np.random.default_rng(1)
    y = rng.lognormal(12, 1, 501)
    z = y * rng.normal(1, 0.2, 501)
    y[:zeros] = 0.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, z)], "y_true double, y_pred double")
    row = stats.regression_metrics(df).first()
    assert (row["n"], row["zero_truth"]) == (501, zeros)
    for name, value in numpy_metrics(y, z).items():
        assert row[name] == pytest.approx(value, rel=1e-9), name


def test_metrics_of_a_constant_target(spark):
    df = spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 2.0), ("b", 2.0, 3.0), ("b", 0.0, 0.0)], "m string, y_true double, y_pred double")
    rows = {r["m"]: r for r in stats.regression_metrics(df, by=["m"]).collect()}
    assert rows["a"]["R2"] == 1.0 and rows["a"]["MDAPE"] == 0.0
    assert np.isnan(rows["b"]["MDAPE"])


def test_best_model_is_the_lowest(spark):
    df = spark.createDataFrame([("a", 0.3), ("b", 0.1), ("c", None)], "model string, MDAPE double")
    assert stats.best_model(df).first()["model"] == "b"


@pytest.mark.parametrize("values", [list(range(100)), [1.0] * 5 + [2.0, 100.0], [3.0, 3.0], [0.0, 0.0, 0.0, 0.0, 9.0]])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    counts, edges = np.histogram(np.array(values, float), "auto")
    rows = stats.histogram(df, "v").orderBy("bin").collect()
    assert [r["count"] for r in rows] == list(counts)
    np.testing.assert_allclose([r["lower"] for r in rows] + [rows[-1]["upper"]], edges)


def test_histogram_of_nothing(spark):
    assert stats.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_profile_equals_pandas(spark):
    rng = np.random.default_rng(3)
    import pandas as pd

    pdf = pd.DataFrame({"a": rng.normal(0, 5, 200), "b": rng.integers(0, 9, 200).astype(float)})
    pdf.loc[:9, "a"] = np.nan
    described = pdf.describe(percentiles=stats.PROFILE_PROBABILITIES).T
    for r in stats.numeric_profile(spark.createDataFrame(pdf), ["a", "b"]).collect():
        np.testing.assert_allclose(np.array(list(r)[1:], float), described.loc[r["field"]].to_numpy())


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (None, "y"), (2.0, "z")], "a double, b string")
    assert {r["field"]: (r["nulls"], r["null_pct"]) for r in stats.null_profile(df).collect()} == {"a": (2, 50.0), "b": (1, 25.0)}


def test_extremes_skip_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0), (4, 5.0), (5, 1.0)], "id int, v double")
    assert tuple(stats.extreme_rows(df, "v", "id").first()) == (1.0, 3, 5.0, 4)


def test_removal(spark):
    a = spark.range(8)
    assert tuple(stats.removal_report(a, a.filter("id < 6")).first()) == (2, 25.0)
    assert tuple(stats.removal_report(a.filter("id > 9"), a.filter("id > 9")).first()) == (0, None)


def test_compare_models(spark):
    one = spark.createDataFrame([("m", "Test", 2.0, 1.0)], "model string, Set string, y_true double, y_pred double")
    found = models.compare_models([one, one.withColumn("model", F.lit("k"))])
    assert sorted(r["model"] for r in found.collect()) == ["k", "m"]


def test_metrics_scan_the_rows_twice_and_equal_a_direct_computation(spark):
    rng = np.random.default_rng(4)
    y = rng.lognormal(12, 1, 6000)
    z = y * rng.normal(1.0, 0.2, 6000) + 1e6
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    df = spark.createDataFrame(pd.DataFrame({"m": ["a", "b", "a"] * 2000, "y_true": y, "y_pred": z}))
    read = df.mapInPandas(count, df.schema)
    rows = {r["m"]: r for r in stats.regression_metrics(read, by=["m"]).collect()}
    # Once for the sums and first counts, once for the values of the chosen cells.
    assert seen.value == 2 * 6000
    direct = {r["m"]: r for r in stats.regression_metrics(df, by=["m"], method="hash").collect()}
    for m in "ab":
        for c, want in direct[m].asDict().items():
            assert rows[m][c] == want or rows[m][c] == pytest.approx(want, rel=1e-9)
    flat = spark.createDataFrame([(5e9 + 1, 5e9), (5e9 + 1, 5e9 + 2)], "y_true double, y_pred double")
    one = stats.regression_metrics(flat).first()
    assert (one["n"], one["MAE"], one["R2"]) == (2, 1.0, 0.0)
    assert stats.regression_metrics(flat.limit(0)).first()["n"] == 0
