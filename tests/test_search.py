import numpy as np
import pyarrow as pa
import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from parcela.operators import embedding, filters, search


def brute(vectors, ids, query, k, metric="cosine"):
    v, q = np.array(vectors, float), np.array(query, float)
    scores = v @ q
    if metric == "cosine":
        size = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
        scores = np.where(size > 0, scores / np.where(size > 0, size, 1), -np.inf)
    order = sorted(range(len(ids)), key=lambda i: (-round(scores[i], 9), ids[i]))[:k]
    return [ids[i] for i in order]


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (300, 6)).astype(float)
    vectors[::3] = [1, 2, 0, -1, 3, 1]  # a third of all rows are copies
    vectors[7] = 0
    ids = [int(i) for i in rng.permutation(300)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "_id long, embedding array<float>").repartition(5)
    extra = spark.createDataFrame([(1000, [1.0]), (1001, None)], df.schema)
    return df.unionAll(extra), vectors, ids


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_topk(spark, store, metric):
    df, vectors, ids = store
    query = [1, 2, 0, -1, 3, 2]
    found = [r["_id"] for r in search.vector_topk(df, query, 9, metric=metric).collect()]
    assert found == brute(vectors, ids, query, 9, metric)


@pytest.mark.parametrize("metric,per_pass", [("cosine", 1024), ("dot", 1024), ("cosine", 7)])
def test_batch_equals_brute_force(spark, store, metric, per_pass):
    df, vectors, ids = store
    queries = np.random.default_rng(6).integers(-3, 4, (20, 6)).astype(float)
    queries[0] = [1, 2, 0, -1, 3, 1]
    qdf = spark.createDataFrame([(f"q{i}", [float(x) for x in q]) for i, q in enumerate(queries)], "query_id string, query_vector array<float>")
    found = search.vector_topk_batch(df, qdf, 8, metric=metric, per_pass=per_pass).orderBy("query_id", "rank").collect()
    for i, q in enumerate(queries):
        mine = [r for r in found if r["query_id"] == f"q{i}"]
        assert [r["rank"] for r in mine] == list(range(1, 9))
        # Equal scores may differ in the last bit between the two computations.
        scores = [r["score"] for r in mine]
        v = vectors @ q
        if metric == "cosine":
            size = np.linalg.norm(vectors, axis=1) * np.linalg.norm(q)
            v = np.where(size > 0, v / np.where(size > 0, size, 1), -np.inf)
        np.testing.assert_allclose(scores, np.sort(v)[::-1][:8], atol=1e-9)
    if metric == "dot":
        return
    copies = [r["_id"] for r in found if r["query_id"] == "q0"]
    assert copies == sorted(ids[::3])[:8]


def test_batch_passes_on_k_rows_per_block_even_if_all_tie():
    scores = np.zeros((1000, 3))
    assert search._best_of_block(scores, 4).sum(axis=0).tolist() == [4, 4, 4]
    scores[:, 1] = np.nan
    assert search._best_of_block(scores, 4).sum(axis=0).tolist() == [4, 4, 4]


@pytest.mark.parametrize("blocks", [1, 40])
def test_a_task_passes_on_k_rows_per_query_whatever_its_blocks(monkeypatch, blocks):
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 30)
    rng = np.random.default_rng(8)
    ids, vectors = rng.permutation(400), rng.integers(-2, 3, (400, 4)).astype(float)
    vectors[5] = np.nan
    queries = rng.integers(-2, 3, (3, 4)).astype(float)
    asked = pa.table({"kind": pa.array([0] * 3, pa.int32()), "query": ["a", "b", "c"], "id": pa.array([None] * 3, pa.int64()),
                      "vector": pa.array(queries.tolist(), pa.list_(pa.float64())), "place": pa.array([1] * 3, pa.int32())})
    again = asked.set_column(4, "place", pa.array([2] * 3, pa.int32()))
    rows = pa.table({"kind": pa.array([1] * 400, pa.int32()), "query": pa.array([None] * 400, pa.string()), "id": pa.array(ids),
                     "vector": pa.array(vectors.tolist(), pa.list_(pa.float64())), "place": pa.array([1] * 400, pa.int32())})
    table = pa.concat_tables([asked, again, rows]).combine_chunks()
    schema = pa.schema([("query_id", pa.string()), ("_id", pa.int64()), ("score", pa.float64())])
    fn = search._task_topk(6, "dot", schema)
    found = pa.Table.from_batches(list(fn(iter(table.to_batches(max_chunksize=-(-406 // blocks))))), schema).to_pylist()
    for name, q in zip("abc", queries):
        scores = np.where(np.isnan(vectors @ q), -np.inf, vectors @ q)
        order = sorted(range(400), key=lambda i: (-scores[i], ids[i]))[:6]
        assert [(r["_id"], r["score"]) for r in found if r["query_id"] == name] == [(ids[i], scores[i]) for i in order]


def test_no_queries(spark, store):
    df, *_ = store
    none = spark.createDataFrame([], "query_id int, query_vector array<float>")
    assert search.vector_topk_batch(df, none).columns == ["query_id", "_id", "score", "rank"]


def test_zero_query_scores_null(spark, store):
    df, *_ = store
    assert [r["score"] for r in search.vector_topk(df, [0] * 6, 2).collect()] == [None, None]


def test_lsh_finds_the_copies(spark, store):
    df, vectors, ids = store
    found = search.vector_topk_lsh(df, [1, 2, 0, -1, 3, 1], 5)
    assert [round(r["score"], 9) for r in found.collect()] == [1.0] * 5


def test_filters_of_a_request(spark):
    df = spark.createDataFrame([(1, "Casa", 0.0, 10.0), (2, "Casa", 5.0, None), (3, "Local", 9.0, 30.0), (4, None, None, 50.0)],
                               "_id int, PROPERTY_TYPE string, PRICE double, AREA double")
    pick = lambda **kw: sorted(r["_id"] for r in filters.search_filter(df, **kw).collect())
    assert pick() == [1, 2, 3, 4]
    assert pick(property_type="") == [1, 2, 3, 4]
    assert pick(min_price=0) == [1, 2, 3]
    assert pick(max_price=0) == [1]
    assert pick(property_type="Casa", min_area=0) == [1]
    assert search.filtered_first(df, "_id", 2).count() == 2


def test_vector_report(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([None, 1.0],)], "embedding array<float>")
    assert tuple(search.validate_vectors(df, 2).first()) == (5, 1, 1, 1, 1, 1)


def test_default_embedding(spark):
    df = spark.createDataFrame([(1, "Casa  grande, con jardín"), (2, "casa grande con JARDÍN"), (3, "bodega"), (4, None)], "_id int, DESCRIPTION string")
    rows = embedding.embed_text(df)
    assert rows.columns == ["_id", "DESCRIPTION", "embedding"]
    query = embedding.embed_query(spark, "casa con jardín grande")
    assert len(query) == embedding.DEFAULT_WIDTH
    best = search.vector_topk(rows, query, 2).collect()
    assert [r["_id"] for r in best] == [1, 2] and round(best[0]["score"], 6) == 1.0


def test_own_embedder_runs_in_batches(spark):
    def load():
        def embed(texts):
            assert len(texts) <= 8
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return embed

    df = spark.range(30).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("DESCRIPTION"))
    rows = embedding.embed_text(df, make_model=load).collect()
    assert all(r["embedding"] == [float(r["id"]), 1.0] for r in rows)


@pytest.mark.parametrize("copies", [False, True])
def test_scores_below_the_best_so_far_are_not_ranked(monkeypatch, copies):
    ranked, rank = [], search._best_of_block
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 2000)
    monkeypatch.setattr(search, "_best_of_block", lambda scores, k: ranked.append(scores.size) or rank(scores, k))
    rng = np.random.default_rng(9)
    ids, vectors, queries = rng.permutation(4000), rng.integers(-9, 10, (4000, 5)).astype(float), rng.integers(-9, 10, (20, 5)).astype(float)
    if copies:
        vectors[::4], queries[0] = [9, 9, -9, 9, 9], [9, 9, -9, 9, 9]
    vectors[3], queries[7] = np.nan, 0
    schema = pa.schema([("query_id", pa.int64()), ("_id", pa.int64()), ("score", pa.float64())])
    best = search._BestRows(queries, pa.array(range(20)), 6, "dot", schema)
    best.offer(pa.array(ids), pa.array(vectors.tolist(), pa.list_(pa.float64())))
    found = pa.Table.from_batches(best.batches(), schema).to_pylist()
    for i, q in enumerate(queries):
        scores = np.where(np.isnan(vectors @ q), -np.inf, vectors @ q)
        order = sorted(range(4000), key=lambda j: (-scores[j], ids[j]))[:6]
        assert [r["_id"] for r in found if r["query_id"] == i] == [ids[j] for j in order]
    # The query of zeros ties with every row.
    assert sum(ranked) < 80_000 * 0.25


def test_equal_vectors_tie_whatever_the_block(monkeypatch):
    rng = np.random.default_rng(11)
    kinds, queries = rng.normal(0, 1, (40, 64)), rng.normal(0, 1, (200, 64))
    vectors, ids = kinds[np.arange(1200) % 40], rng.permutation(1200)
    schema = pa.schema([("query_id", pa.int64()), ("_id", pa.int64()), ("score", pa.float64())])
    found = []
    for at_once in (200 * 7, 200 * 33, 200 * 1200):
        monkeypatch.setattr(search, "SCORES_AT_ONCE", at_once)
        best = search._BestRows(queries, pa.array(range(200)), 10, "cosine", schema)
        best.offer(pa.array(ids), pa.array(vectors.tolist(), pa.list_(pa.float64())))
        found.append(pa.Table.from_batches(best.batches(), schema).to_pylist())
    assert found[0] == found[1] == found[2]
    for i in range(200):
        kind = int(np.argmax(kinds / np.linalg.norm(kinds, axis=1, keepdims=True) @ queries[i]))
        assert [r["_id"] for r in found[0] if r["query_id"] == i] == sorted(ids[kind::40].tolist())[:10]


def test_tasks_are_fewer_if_the_queries_are_many(spark, store, monkeypatch):
    df, vectors, ids = store
    qdf = df.filter("size(embedding) = 6").selectExpr("_id AS query_id", "embedding AS query_vector")
    same = [search.vector_topk_batch(df, qdf, 3).orderBy("query_id", "rank").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for copies, tasks in ((1, 16), (9000, 30)):
            monkeypatch.setattr(search, "QUERY_COPIES", copies)
            found = search.vector_topk_batch(df, qdf, 3)
            assert f", {tasks})" in plan_of(found) or f"{tasks}), REPARTITION" in plan_of(found)
            same.append(found.orderBy("query_id", "rank").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert same[0] == same[1] == same[2] and len(same[0]) == 900
