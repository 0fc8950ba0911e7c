"""Ranking of listings by vector similarity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.vectors import dot, norm, vector_literal
from ..session import materialize

# Queries answered together in one pass over the listings.
QUERIES_PER_PASS = 16_384
# Scores a task holds in memory at a time.
SCORES_AT_ONCE = 2_000_000
# Query copies a pass deals out, one to each task; the tasks are fewer if the queries are many.
QUERY_COPIES = 1 << 19


def similarity(metric: str, vector: Column | str, query: Sequence[float]) -> Column:
    """Score of a vector column against one query. The query's length is taken
    out here, so a row costs two passes over its vector."""
    if metric == "dot":
        return dot(vector, vector_literal(query))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}")
    length = math.sqrt(sum(x * x for x in query))
    if length == 0.0:
        return F.lit(None).cast("double")
    return F.try_divide(dot(vector, vector_literal([x / length for x in query])), norm(vector))


def vector_topk(df: DataFrame, query: Sequence[float], k: int = 10, vector: str = "embedding",
                id_col: str = "_id", metric: str = "cosine") -> DataFrame:
    """The ``k`` rows nearest to one query vector, with ``score``. Filter
    ``df`` first; vectors of another width than the query do not compete."""
    query = [float(x) for x in query]
    score = similarity(metric, vector, query)
    # A NaN score ranks like a missing one, not above all.
    scored = df.filter(F.size(vector) == len(query)).withColumn("score", F.when(~F.isnan(score), score))
    return scored.orderBy(F.desc_nulls_last("score"), F.asc(id_col)).limit(k)


def filtered_first(df: DataFrame, order: str, k: int = 10) -> DataFrame:
    """Rows without ranking: the first ``k`` by a key column."""
    return df.orderBy(order).limit(k)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.full_like(matrix, np.nan), where=size > 0)


def _best_of_block(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the ``k`` best rows per column; earlier rows win ties."""
    k = min(k, len(scores))
    rank = np.where(np.isnan(scores), -np.inf, scores)
    kth = np.partition(rank, len(rank) - k, axis=0)[len(rank) - k]
    above, level = rank > kth, rank == kth
    return above | (level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0)))


def _best_so_far(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each query, missing scores last, ties by id."""
    keys = [("query", "ascending"), ("score", "descending"), ("id", "ascending")]
    found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_end"))
    query = found["query"].to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))


def _first_of_equals(matrix: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``matrix`` without those that have ``k`` equal rows before them."""
    whole = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.itemsize * matrix.shape[1]))).ravel()
    kind = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    nth = np.arange(len(kind)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[nth < k])


def _pair_scores(rows: np.ndarray, queries: np.ndarray, at: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Products of single pairs. A matrix product's last bits depend on the shape
    of the block; these do not, so equal vectors tie wherever they are met."""
    step = max(1, SCORES_AT_ONCE // max(1, rows.shape[1]))
    parts = [(rows[at[i:i + step]] * queries[asked[i:i + step]]).sum(axis=1) for i in range(0, len(at), step)]
    return np.concatenate(parts) if parts else np.empty(0)


class _BestRows:
    """The ``k`` best rows of each query among the blocks offered so far."""

    def __init__(self, queries: np.ndarray, query_ids: pa.Array, k: int, metric: str, schema: pa.Schema):
        self.queries = _unit_rows(queries) if metric == "cosine" else queries
        self.query_ids, self.k, self.metric, self.schema = query_ids, k, metric, schema
        self.step = max(k, SCORES_AT_ONCE // len(queries))
        # Between prunings a task holds a few times what it passes on.
        self.most = 4 * k * len(queries)
        self.held: list[pa.Table] = []
        # Per query the k-th best score at the last pruning: a lower one is of no
        # use. Queries without k scores yet are open to any.
        self.least = np.full(len(queries), -np.inf)
        self.open = np.arange(len(queries))
        self.sizes = np.nan_to_num(np.linalg.norm(self.queries, axis=1), posinf=0.0)

    def _slack(self, rows: np.ndarray) -> np.ndarray:
        """Per query, more than a matrix product and ``_pair_scores`` can differ by."""
        sizes = np.linalg.norm(rows, axis=1)
        return 4 * np.finfo(float).eps * rows.shape[1] * self.sizes * sizes[np.isfinite(sizes)].max(initial=0.0)

    def _best(self, scores: np.ndarray, slack: np.ndarray) -> np.ndarray:
        mask = _best_of_block(scores, self.k)
        return mask | (scores >= np.where(mask, scores, np.inf).min(axis=0) - slack)

    def _wanted(self, scores: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Mask of the scores that may be among the best, ``k`` per query and what
        is as good as the last of them."""
        mask = scores >= self.least - slack
        if np.count_nonzero(mask) > len(self.least):
            crowded = np.flatnonzero(np.count_nonzero(mask, axis=0) > self.k)
            mask[:, crowded] = self._best(scores[:, crowded], slack[crowded])
        if self.open.size:
            mask[:, self.open] = self._best(scores[:, self.open], slack[self.open])
        return mask

    def _prune(self) -> None:
        best = _best_so_far(pa.concat_tables(self.held), self.k)
        query = best["query"].to_numpy()
        last = np.searchsorted(query, np.arange(len(self.least)), "right") - 1
        full = np.bincount(query, minlength=len(self.least)) >= self.k
        found = best["score"].to_numpy()
        self.least[full] = np.where(np.isnan(found[last[full]]), -np.inf, found[last[full]])
        self.open = np.flatnonzero(np.isneginf(self.least))
        self.held = [best]

    def offer(self, ids: pa.Array, vectors: pa.ListArray) -> None:
        for start in range(0, len(ids), self.step):
            some = ids.slice(start, self.step)
            order = pc.sort_indices(some)
            some = some.take(order)
            flat = vectors.slice(start, self.step).take(order).flatten().to_numpy(zero_copy_only=False)
            matrix = flat.astype(np.float64).reshape(-1, self.queries.shape[1])
            kept = _first_of_equals(matrix, self.k)
            some, matrix = some.take(pa.array(kept)), matrix[kept]
            matrix = _unit_rows(matrix) if self.metric == "cosine" else matrix
            scores = matrix @ self.queries.T
            rows, cols = np.divmod(np.flatnonzero(self._wanted(scores, self._slack(matrix))), scores.shape[1])
            found = _pair_scores(matrix, self.queries, rows, cols)
            first = not self.held
            self.held.append(pa.table({
                "query": pa.array(cols), "id": some.take(pa.array(rows)).cast(self.schema.field(1).type),
                "score": pa.array(found, type=pa.float64(), mask=np.isnan(found)),
            }))
            if first or sum(t.num_rows for t in self.held) > self.most:
                self._prune()

    def batches(self) -> list[pa.RecordBatch]:
        if not self.held:
            return []
        kept = _best_so_far(pa.concat_tables(self.held), self.k).combine_chunks()
        asked = self.query_ids.take(kept["query"].combine_chunks())
        return pa.table([asked, kept["id"], kept["score"]], schema=self.schema).to_batches()


def _task_topk(k: int, metric: str, schema: pa.Schema) -> Callable:
    """A task's rows are queries first, then listings. Queries become a matrix,
    listings stream past it in Arrow blocks, and per query ``k`` rows go on."""
    def best(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.Table] = []
        rows: _BestRows | None = None
        for block in blocks:
            table = pa.Table.from_batches([block])
            queries = table.filter(pc.equal(table["kind"], 0))
            if queries.num_rows:
                asked.append(queries)
            listings = table.filter(pc.equal(table["kind"], 1)).combine_chunks()
            # A place that nobody asks about has no queries.
            if not listings.num_rows or not asked:
                continue
            if rows is None:
                known = pa.concat_tables(asked)
                # A task that holds several places got the queries once for each.
                known = known.filter(pc.equal(known["place"], known["place"][0])).combine_chunks()
                matrix = known["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                rows = _BestRows(matrix.astype(np.float64).reshape(known.num_rows, -1), known["query"].combine_chunks(), k, metric, schema)
            rows.offer(listings["id"].combine_chunks(), listings["vector"].combine_chunks())
        if rows is not None:
            yield from rows.batches()

    return best


def task_topk(k: int, metric: str, out: T.StructType) -> Callable:
    """A task's work on rows (kind, query, id, vector, place): queries (kind 0)
    first, then listings; for ``mapInArrow``."""
    return _task_topk(k, metric, _arrow_schema(out))


def vector_topk_batch(df: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding",
                      id_col: str = "_id", query_id: str = "query_id", query_vector: str = "query_vector",
                      metric: str = "cosine", per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """Exact top ``k`` listings for every query, with ``score`` and ``rank``.

    Listings are spread over the tasks; every task also gets all queries, sorted
    before its listings, and passes on ``k`` rows per query. So pairs are never
    shuffled, and neither queries nor listings visit the driver. Up to
    ``per_pass`` queries take one scan; more take further passes, each storing
    its result. Vectors that are missing or not as wide as the widest query take
    no part. Every query meets every listing, so the work is that of all pairs.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = df.sparkSession
    out = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    number, width = queries.agg(F.count("*"), F.max(F.size(query_vector))).first()
    if not number:
        return spark.createDataFrame([], out.add("rank", T.IntegerType()))
    fits = lambda c: F.coalesce(F.size(c) == width, F.lit(False))
    # Floats stay floats on the way; the tasks reckon in doubles.
    single = {df.schema[vector].dataType, queries.schema[query_vector].dataType} <= {T.ArrayType(T.FloatType()), T.ArrayType(T.FloatType(), False)}
    kind = "array<float>" if single else "array<double>"
    asked = queries.filter(fits(query_vector)).select(
        F.lit(0).alias("kind"), F.col(query_id).alias("query"), F.lit(None).cast(out[id_col].dataType).alias("id"),
        F.col(query_vector).cast(kind).alias("vector"))
    passes = max(1, math.ceil(number / per_pass))
    if passes > 1:
        # Dealt in turn, so that passes are of equal size.
        asked = materialize(asked.repartition(passes).withColumn("pass", F.spark_partition_id()), "queries")
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = max(min(places, 2 * spark.sparkContext.defaultParallelism), min(places, QUERY_COPIES // min(number, per_pass)))
    rows = df.filter(fits(vector)).select(
        F.lit(1).alias("kind"), F.lit(None).cast(out[query_id].dataType).alias("query"), F.col(id_col).alias("id"),
        F.col(vector).cast(kind).alias("vector"), F.pmod(F.xxhash64(id_col, vector), F.lit(places)).cast("int").alias("place"))
    order = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("score"), F.asc(id_col))

    def one_pass(some: DataFrame) -> DataFrame:
        everywhere = some.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
        met = everywhere.unionByName(rows).repartitionById(places, "place").sortWithinPartitions("kind")
        found = met.mapInArrow(task_topk(k, metric, out), out)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    if passes == 1:
        return one_pass(asked)
    parts = [materialize(one_pass(asked.filter(F.col("pass") == p).drop("pass")), "topk") for p in range(passes)]
    return reduce(DataFrame.unionAll, parts)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def vector_topk_lsh(df: DataFrame, query: Sequence[float], k: int = 10, vector: str = "embedding",
                    id_col: str = "_id", tables: int = 8, bucket_length: float = 0.5) -> DataFrame:
    """Nearest rows by random projection; approximate, so opt-in. Candidates are
    ranked by exact cosine. Fewer than ``k`` rows come back if the buckets hold
    fewer; the exact search is ``vector_topk``."""
    from pyspark.ml.linalg import Vectors

    query = [float(x) for x in query]
    length = math.sqrt(sum(x * x for x in query))
    if length == 0.0:
        return vector_topk(df, query, k, vector, id_col)
    right = F.size(vector) == len(query)
    usable = df.filter(right & (dot(vector, vector) > 0.0))
    # Spark may evaluate the hash before the filter, so it must take any row.
    scale = F.coalesce(F.try_divide(F.lit(1.0), norm(vector)), F.lit(0.0))
    scaled = F.when(right, F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) * scale))
    unit = usable.withColumn("_unit", array_to_vector(F.coalesce(scaled, vector_literal([0.0] * len(query)))))
    model = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_hashes", numHashTables=tables, bucketLength=bucket_length, seed=42
    ).fit(unit)
    target = Vectors.dense([x / length for x in query])
    near = model.approxNearestNeighbors(unit, target, 10 * k, distCol="_distance").select(*df.columns)
    return vector_topk(near, query, k, vector, id_col)


def validate_vectors(df: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """Counts of vectors that are fine, missing, of wrong width, with null
    entries or all zeros. A vector with NaN is not valid."""
    v = F.col(vector)
    right = F.coalesce(F.size(v) == width, F.lit(False))
    holes = right & F.exists(v, lambda x: x.isNull())
    zeros = right & ~F.exists(v, lambda x: x.isNull() | (x != 0))
    nans = right & ~holes & F.coalesce(F.exists(v, lambda x: F.isnan(x)), F.lit(False))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(v.isNotNull() & ~right).alias("wrong_width"),
        F.count_if(holes).alias("null_entries"),
        F.count_if(zeros).alias("all_zero"),
        F.count_if(right & ~holes & ~zeros & ~nans).alias("valid"),
    )
