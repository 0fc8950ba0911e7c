import numpy as np
import pandas as pd
import pytest

import parcela.operators.quantiles as q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.73, 0.99, 1.0]


def collected(df, by=("g",)):
    return {tuple(r[b] for b in by) + (r["field"],): (r["n"], list(r["quantiles"])) for r in df.collect()}


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 20_000
    pdf = pd.DataFrame({
        # A third of the rows share one group; null is a group of its own.
        "g": np.where(rng.random(n) < 0.34, "hot", np.where(rng.random(n) < 0.5, "b", None)),
        "x": np.round(rng.lognormal(14, 1.5, n), 2) * np.where(rng.random(n) < 0.02, -1, 1),
        "y": rng.integers(-2, 6, n).astype(float),
        "z": np.where(rng.random(n) < 0.9, 5.0, rng.normal(0, 1e-9, n)),
    })
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    pdf.loc[[3, 4], "x"] = [1e-310, -0.0]
    return pdf


@pytest.mark.parametrize("method", ["hash", "cells"])
def test_equals_numpy(spark, skewed, method):
    df = spark.createDataFrame(skewed)
    found = collected(q.quantiles(df, ["x", "y", "z"], PROBS, ["g"], method))
    assert len(found) == 9
    for (g, field), (n, values) in found.items():
        v = skewed[skewed.g.isna() if g is None else skewed.g == g][field].dropna()
        assert n == len(v)
        np.testing.assert_allclose(values, np.percentile(v, np.array(PROBS) * 100), rtol=1e-12)


@pytest.mark.parametrize("rows_to_sort", [1, 500])
def test_splitting_cells_changes_nothing(spark, skewed, monkeypatch, rows_to_sort):
    df = spark.createDataFrame(skewed)
    expected = collected(q.quantiles(df, ["x", "z"], PROBS, ["g"], "hash"))
    monkeypatch.setattr(q, "ROWS_TO_SORT", rows_to_sort)
    assert collected(q.quantiles(df, ["x", "z"], PROBS, ["g"], "cells")) == expected


def test_large_side_is_stored_instead_of_broadcast(spark, skewed, monkeypatch):
    df = spark.createDataFrame(skewed)
    expected = collected(q.quantiles(df, ["x"], [0.5], ["g"], "hash"))
    look = q.looked_at
    monkeypatch.setattr(q, "looked_at", lambda side: look(side, max_rows=1))
    assert collected(q.quantiles(df, ["x"], [0.5], ["g"], "cells")) == expected


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),)], "v double")
    for method in ("hash", "cells"):
        row = q.quantiles(df, ["v"], [0.0, 0.5, 1.0], method=method).first()
        assert list(row["quantiles"]) == [float("-inf"), 1.0, float("inf")]


def test_thousand_probabilities(spark):
    df = spark.range(5000).selectExpr("cast(id * id % 7919 as double) v")
    probs = [i / 999 for i in range(1000)]
    a = q.one_row_quantiles(df, ["v"], probs, "hash")["v"]
    b = q.one_row_quantiles(df, ["v"], probs, "cells")["v"]
    assert a == b


def test_empty_and_null_only(spark):
    empty = spark.createDataFrame([], "g string, v double")
    nulls = spark.createDataFrame([("a", None), ("b", float("nan"))], "g string, v double")
    for method in ("hash", "cells"):
        assert q.quantiles(empty, ["v"], [0.5], ["g"], method).count() == 0
        assert q.quantiles(nulls, ["v"], [0.5], ["g"], method).count() == 0


def test_counting_at_every_size(spark, monkeypatch):
    df = spark.range(100).selectExpr("cast(id as double) v")
    called = []
    monkeypatch.setattr(q, "_by_cells", lambda values, *a: called.append(1) or values)
    q.quantiles(df, ["v"], [0.5])
    assert called
    q.quantiles(df, ["v"], [0.5], method="hash")
    assert len(called) == 1


def test_approx_is_close(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) v")
    assert abs(q.one_row_quantiles(df, ["v"], [0.5], "approx")["v"][0] - 5000) < 20


@pytest.mark.parametrize("probs", [[0.5], [0.0, 1.0], [i / 999 for i in range(1000)], [0.5, 0.5 + 1e-15, 0.5000001, 0.3, 1.0], [i / 70 for i in range(35, 71)]])
def test_looking_up_ranks_equals_trying_all(spark, probs):
    rng = np.random.default_rng(5)
    total = np.concatenate([[1, 1, 2, 10**15], rng.integers(1, 60, 300), rng.integers(1, 10**9, 300)])
    before = (rng.random(len(total)) * total).astype(int)
    n = 1 + (rng.random(len(total)) ** 3 * (total - before)).astype(int)
    ranks = q._Ranks(probs)
    first, end = ranks.span("before", "n")
    df = spark.createDataFrame(pd.DataFrame({"total": total, "before": before, "n": np.minimum(n, total - before)}))
    for r in df.selectExpr("*", f"{first} AS p0", f"{end} AS p1").collect():
        at = (r["total"] - 1) * np.array(ranks.probs)
        assert r["p0"] == np.sum(np.ceil(at) < r["before"]) and r["p1"] == np.sum(np.floor(at) < r["before"] + r["n"])
