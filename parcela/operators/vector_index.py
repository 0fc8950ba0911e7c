"""A stored index for approximate vector search.

Centroids are learnt once, from a bounded sample. Rows are then stored by the
cell of their nearest centroid, which is a partition column, also those that come
later. A search looks at the cells nearest to its query and reads no other
partitions; within them the ranking is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.vectors import dot, norm
from ..session import materialize
from .search import QUERIES_PER_PASS, task_topk, vector_topk

# Rows the centroids are learnt from, at most about this many.
SAMPLE_ROWS = 200_000
CELL = "vector_cell"
# Tasks per core that a batch of searches is dealt to.
TASKS_A_CORE = 4


def _unit(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a usable vector, with ``_unit``, the vector at length 1."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = df.filter(F.col(vector).isNotNull() & finite & (dot(vector, vector) > 0.0))
    # Spark may evaluate this before the filter, so it must take any row.
    scale = F.coalesce(F.try_divide(F.lit(1.0), norm(vector)), F.lit(0.0))
    # Bound once for a row: inside the inner function it would be worked out for each component.
    scaled = F.transform(F.array(scale), lambda one: F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) * one))
    return usable.withColumn("_unit", scaled[0])


def learn_cells(df: DataFrame, path: str, cells: int = 64, vector: str = "embedding",
                sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> None:
    """Learn the index's centroids. Only this step looks at a sample: all rows if
    there are ``sample_rows`` at most, else a random share of them."""
    unit = materialize(_unit(df, vector).select("_unit"), "unit")
    share = sample_rows / max(1, unit.count())
    sample = unit if share >= 1.0 else unit.sample(share, seed)
    model = KMeans(k=cells, seed=seed, featuresCol="_features", maxIter=15).fit(sample.select(array_to_vector("_unit").alias("_features")))
    model.save(f"{path}/centroids")


def add_rows(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """Store rows in the cell of their nearest centroid. Rows whose vector is
    missing, zero or not finite have no direction and are left out."""
    model = KMeansModel.load(f"{path}/centroids").setFeaturesCol("_features").setPredictionCol(CELL)
    placed = model.transform(_unit(df, vector).withColumn("_features", array_to_vector("_unit")))
    placed.drop("_unit", "_features").write.mode("append").partitionBy(CELL).parquet(f"{path}/rows")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def _centroids(path: str) -> list[list[float]]:
    return [c.tolist() for c in KMeansModel.load(f"{path}/centroids").clusterCenters()]


def nearest_cells(path: str, query: Sequence[float], probes: int) -> list[int]:
    """The cells whose centroids are nearest to the query's direction."""
    size = math.sqrt(sum(x * x for x in query)) or 1.0
    unit = [x / size for x in query]
    gaps = [(sum((a - b) ** 2 for a, b in zip(c, unit)), i) for i, c in enumerate(_centroids(path))]
    return [i for _, i in sorted(gaps)[:probes]]


def indexed_topk(spark: SparkSession, path: str, query: Sequence[float], k: int = 10, probes: int = 8,
                 vector: str = "embedding", id_col: str = "_id") -> DataFrame:
    """The ``k`` nearest rows by cosine among those of the ``probes`` nearest
    cells, with ``score``. Only the partitions of these cells are read; all
    cells probed, the answer is exact."""
    rows = stored_rows(spark, path)
    return vector_topk(rows.filter(F.col(CELL).isin(nearest_cells(path, query, probes))), query, k, vector, id_col)


def indexed_topk_batch(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8,
                       vector: str = "embedding", id_col: str = "_id", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """``indexed_topk`` for every query: query and row id, ``score`` and ``rank``.
    A query meets the rows of its cells only, as matrices in tasks that hold the
    queries of one cell. Queries that are not as wide as the centroids take no
    part, nor do those without a direction."""
    learnt = _centroids(path)
    # As many rows as the index has cells.
    centroids = F.broadcast(spark.createDataFrame(list(enumerate(learnt)), f"{CELL} int, _c array<double>"))
    asked = _unit(queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_qv")), "_qv").filter(F.size("_qv") == len(learnt[0]))
    gap = dot("_c", "_c") - 2 * dot("_unit", "_c")
    closest = Window.partitionBy("_q").orderBy("_gap", CELL)
    near = asked.crossJoin(centroids).select("_q", "_qv", CELL, gap.alias("_gap"))
    near = near.withColumn("_nth", F.row_number().over(closest)).filter(F.col("_nth") <= probes).drop("_gap", "_nth")
    near = materialize(near, "near")
    met = {r[CELL]: r["n"] for r in near.groupBy(CELL).agg(F.count("*").alias("n")).collect()}
    rows = stored_rows(spark, path).filter(F.col(CELL).isin(list(met)))
    held = {r[CELL]: r["n"] for r in rows.groupBy(CELL).agg(F.count("*").alias("n")).collect()}
    # Places of a cell follow its pairs, so that no task has much more than others.
    pairs = sum(n * met[c] for c, n in held.items())
    wanted = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    dealt, places = [], 0
    for c, n in held.items():
        slices = min(n, max(1, round(wanted * n * met[c] / pairs)))
        dealt.append((c, places, slices))
        places += slices
    out = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(id_col, rows.schema[id_col].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    if not places:
        return spark.createDataFrame([], out.add("rank", T.IntegerType()))
    dealt = F.broadcast(spark.createDataFrame(dealt, f"{CELL} int, _first int, _slices int"))
    single = {rows.schema[vector].dataType, near.schema["_qv"].dataType} <= {T.ArrayType(T.FloatType()), T.ArrayType(T.FloatType(), False)}
    kind = "array<float>" if single else "array<double>"
    listed = rows.select(F.col(id_col).alias("_r"), F.col(vector).alias("_v"), CELL).join(dealt, CELL).select(
        F.lit(1).alias("kind"), F.lit(None).cast(out[query_id].dataType).alias("query"), F.col("_r").alias("id"), F.col("_v").cast(kind).alias("vector"),
        (F.col("_first") + F.pmod(F.xxhash64("_r", "_v"), F.col("_slices"))).cast("int").alias("place"))
    passes = max(1, math.ceil(max(met.values()) / QUERIES_PER_PASS))
    order = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("score"), F.asc(id_col))

    def one_pass(some: DataFrame) -> DataFrame:
        everywhere = some.join(dealt, CELL).select(
            F.lit(0).alias("kind"), F.col("_q").alias("query"), F.lit(None).cast(out[id_col].dataType).alias("id"), F.col("_qv").cast(kind).alias("vector"),
            F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_slices") - 1)).alias("place"))
        together = everywhere.unionByName(listed).repartitionById(places, "place").sortWithinPartitions("kind")
        found = together.mapInArrow(task_topk(k, "cosine", out), out)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    if passes == 1:
        return one_pass(near)
    share = F.pmod(F.xxhash64("_q"), F.lit(passes))
    return reduce(DataFrame.unionAll, [materialize(one_pass(near.filter(share == p)), "topk") for p in range(passes)])
