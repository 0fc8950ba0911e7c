import numpy as np
import pytest
from plan_text import plan_of

from parcela.operators import search, vector_index


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (12, 8))
    rows = [(i, (centre[i % 12] + rng.normal(0, 0.3, 8)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "_id bigint, embedding array<double>")
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.learn_cells(df, path, cells=12, sample_rows=600)
    vector_index.add_rows(df.filter("_id < 1000"), path)
    odd = spark.createDataFrame([(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [None] * 8)], df.schema)
    vector_index.add_rows(df.filter("_id >= 1000").unionByName(odd), path)
    return df, path


def test_all_rows_with_a_direction_are_stored_once(spark, stored):
    df, path = stored
    kept = vector_index.stored_rows(spark, path)
    assert sorted(r["_id"] for r in kept.collect()) == list(range(1200))


def test_only_probed_cells_are_read(spark, stored):
    df, path = stored
    query = df.filter("_id = 5").first()["embedding"]
    found = vector_index.indexed_topk(spark, path, query, 10, probes=2)
    plan = plan_of(found)
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "vector_cell" in filters and " IN (" in filters
    assert found.first()["_id"] == 5


def test_all_cells_probed_is_exact(spark, stored):
    df, path = stored
    query = df.filter("_id = 77").first()["embedding"]
    exact = [r["_id"] for r in search.vector_topk(df, query, 10).collect()]
    assert [r["_id"] for r in vector_index.indexed_topk(spark, path, query, 10, probes=12).collect()] == exact


def test_recall_of_many_searches(spark, stored):
    df, path = stored
    asked = df.filter("_id % 20 = 0").selectExpr("_id AS query_id", "embedding AS query_vector")
    found = {(r["query_id"], r["_id"]) for r in vector_index.indexed_topk_batch(spark, path, asked, 10, probes=4).collect()}
    exact = {(r["query_id"], r["_id"]) for r in search.vector_topk_batch(df, asked, 10).collect()}
    assert len(exact) == 600 and len(found & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("per_pass", [16_384, 25])
def test_many_searches_are_matrices_not_a_join_of_pairs(spark, stored, monkeypatch, per_pass):
    monkeypatch.setattr(vector_index, "QUERIES_PER_PASS", per_pass, raising=False)
    df, path = stored
    odd = spark.createDataFrame([(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [1.0] * 7)], df.schema)
    asked = df.filter("_id % 20 = 0").unionByName(odd).selectExpr("_id AS query_id", "embedding AS query_vector")
    found = vector_index.indexed_topk_batch(spark, path, asked, 10, probes=12)
    if per_pass > 60:
        assert plan_of(found).count("MapInArrow") == 1
    exact = search.vector_topk_batch(df, asked.filter("query_id < 5000"), 10)
    rows = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    assert rows == [tuple(r) for r in exact.orderBy("query_id", "rank").collect()] and len(rows) == 600


def test_five_thousand_queries_take_one_scan(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 4).tolist()) for i in range(300)], "_id int, embedding array<double>")
    asked = spark.range(5000).selectExpr("id AS query_id", "array(cos(id), sin(id), 1.0D, id / 5000.0D) AS query_vector")
    found = search.vector_topk_batch(df, asked, 3)
    plan = plan_of(found)
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert found.count() == 15_000
    matrix = np.array([r["embedding"] for r in df.orderBy("_id").collect()])
    one = np.array([np.cos(4321), np.sin(4321), 1.0, 4321 / 5000])
    order = np.argsort(-(matrix @ one) / np.linalg.norm(matrix, axis=1))[:3]
    assert [r["_id"] for r in found.filter("query_id = 4321").orderBy("rank").collect()] == order.tolist()
