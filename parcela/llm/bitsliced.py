"""Exact top-k inner products with a bit-sliced index.

The vectors are stored in blocks of rows. Of each dimension a block holds one
bitmap per bit of the quantised values ("slices"). A query adds up slices with
bitmap arithmetic: the bits of its own components say which slices enter at
which weight, negative components take the complement. The score of all rows of
the block is then itself a set of slices, and the top rows are chosen from the
most significant slice downward; rows that tie at the boundary go by their id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

BLOCK_ROWS = 16_384
# Queries that are worth a task of their own, and tasks per core they are dealt to.
QUERY_BLOCK = 64
TASKS_A_CORE = 4
# Bytes of slices that one task holds; it holds their complements too.
SPAN_BYTES = 32 << 20


def quantised(vector: str = "embedding", scale: int = 64) -> Column:
    """floor(scale * component); null if a component is null or not finite."""
    v = F.col(vector)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Slices of ``values`` (rows x dims) as packed bitmaps, dims x bits x bytes,
    after subtracting each dimension's least value."""
    least = values.min(axis=0) if len(values) else np.zeros(values.shape[1], np.int64)
    shifted = (values - least).astype(np.uint64)
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    rows = shifted.T
    slices = np.stack([np.packbits(((rows >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(bits)], axis=1)
    return slices, least, bits


def build_index(vectors: DataFrame, vec_id: str = "vec_id", values: str = "values", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Stored index over every row: ``block``, ``ids``, ``slices`` and what is
    needed to read them. One block is one partition of at most about
    ``block_rows`` rows. Returns the index and its number of blocks."""
    stored = materialize(vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(values).alias("values")), "vectors")
    rows, width = stored.agg(F.count("*"), F.coalesce(F.max(F.size("values")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / block_rows))

    def sliced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [p for p in parts if len(p)]
        if not frames:
            return
        rows = pd.concat(frames).sort_values("vec_id", kind="stable")
        matrix = np.zeros((len(rows), width), np.int64)
        for i, v in enumerate(rows["values"]):
            matrix[i, :len(v)] = v
        slices, least, bits = _pack(matrix)
        yield pd.DataFrame({
            "block": [int(rows["part"].iloc[0])], "rows": [len(rows)], "bits": [bits],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "least": [least.astype(np.int64).tobytes()],
            "slices": [slices.tobytes()],
        })

    dealt = stored.repartition(blocks).withColumn("part", F.spark_partition_id())
    index = dealt.mapInPandas(sliced, "block int, rows int, bits int, ids binary, least binary, slices binary")
    return materialize(index, "slices"), blocks


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry bitmaps of three bitmaps."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _sum_slices(columns: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Add bitmaps, listed by weight as matrices of bitmaps, until one is left
    per weight."""
    out: list[np.ndarray] = []
    w = 0
    while w < len(columns):
        level = np.concatenate(columns[w]) if columns[w] else np.zeros((1, width), np.uint8)
        while len(level) > 1:
            if w + 1 == len(columns):
                columns.append([])
            third = len(level) // 3
            if third:
                s, c = _full_add(level[:third], level[third:2 * third], level[2 * third:3 * third])
                level = np.concatenate([level[3 * third:], s])
            else:
                c, level = level[:1] & level[1:], level[:1] ^ level[1:]
            columns[w + 1].append(c)
        out.append(level[0])
        w += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap.view(np.uint64)).sum())


def _rows_of(bitmap: np.ndarray, rows: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap)[:rows])


def _digits(q: int) -> Iterator[tuple[int, int]]:
    """The non-adjacent form of ``q``: weights and signs with fewest digits, so
    fewest slices enter a sum."""
    j = 0
    while q:
        if q & 1:
            sign = 2 - (q & 3)
            yield j, sign
            q -= sign
        q, j = q >> 1, j + 1


def block_topk(query: np.ndarray, both: np.ndarray, bits: int, least: np.ndarray, allowed: np.ndarray,
               rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the ``k`` best allowed rows of a block; of equal ones
    the first rows, which have the smaller ids. ``both`` holds the slices of all
    dimensions, then their complements, one bitmap a row."""
    digits = [(d * bits, j, sign) for d in np.flatnonzero(query) for j, sign in _digits(int(query[d]))]
    top, half = (1 << bits) - 1, len(both) // 2
    # -v = (top - v) - top, and the complement is top - v.
    offset = int(query @ least) - sum(top << j for _, j, sign in digits if sign < 0)
    first = np.array([d if sign > 0 else d + half for d, _, sign in digits], np.int64)
    weight = np.array([j for _, j, _ in digits], np.int64)
    columns: list[list[np.ndarray]] = []
    for w in range(int(weight.max(initial=-bits)) + bits):
        bit = w - weight
        here = (bit >= 0) & (bit < bits)
        columns.append([both[first[here] + bit[here]]] if here.any() else [])
    score = _sum_slices(columns, both.shape[1]) if digits else []
    sure, maybe = np.zeros_like(allowed), allowed
    missing = min(k, _count(allowed))
    for one in reversed(score):
        here = maybe & one
        n = _count(here)
        if n > missing:
            maybe = here
        else:
            sure, missing, maybe = sure | here, missing - n, maybe & ~one
        if not missing:
            break
    found = np.concatenate([_rows_of(sure, rows), _rows_of(maybe, rows)[:missing]]).astype(np.int64)
    total = np.full(len(found), offset, np.int64)
    for w, one in enumerate(score):
        total += ((one[found >> 3] >> (7 - (found & 7)).astype(np.uint8)) & 1).astype(np.int64) << w
    return found, total


class _Block:
    """A block of the index, ready to be asked."""

    def __init__(self, rows: int, bits: int, ids: bytes, least: bytes, slices: bytes):
        self.rows, self.bits = rows, bits
        self.ids, self.least = np.frombuffer(ids, np.int64), np.frombuffer(least, np.int64)
        raw = np.frombuffer(slices, np.uint8).reshape(len(self.least), bits, -1)
        padded = np.pad(raw, ((0, 0), (0, 0), (0, -raw.shape[2] % 8)))
        both = padded.reshape(len(self.least) * bits, -1)
        self.both = np.concatenate([both, ~both])
        everyone = np.packbits(np.ones(rows, np.uint8))
        self.everyone = np.pad(everyone, (0, padded.shape[2] - len(everyone)))
        # The score of a row, and what is added on the way to it.
        self.reach = len(self.least) * (int(np.abs(self.least).max(initial=0)) + (1 << bits))

    def topk(self, query_id: int, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows that are not the query's own."""
        query = np.zeros(len(self.least), np.int64)
        query[:len(values)] = values
        if self.reach * int(np.abs(query).max(initial=0)) >= 1 << 60:
            raise ValueError("components are too large: scores leave 64 bits")
        allowed = self.everyone
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        if hi > lo:
            allowed = self.everyone.copy()
            for r in range(lo, hi):
                allowed[r >> 3] &= ~np.uint8(128 >> (r & 7))
        found, score = block_topk(query, self.both, self.bits, self.least, allowed, self.rows, k)
        return self.ids[found], score


def _place(k: int):
    """A place's rows are its blocks first, then queries, which stream past them:
    per query the ``k`` best rows of all the blocks go on."""
    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[_Block] = []
        for part in parts:
            own = part[part["kind"] == 0]
            held += [_Block(*b) for b in own[["rows", "bits", "ids", "least", "slices"]].itertuples(index=False)]
            asked = part[part["kind"] == 1]
            out = []
            for q, values in zip(asked["query_id"], asked["query_values"]):
                found = [block.topk(q, values, k) for block in held]
                if found:
                    ids, score = map(np.concatenate, zip(*found))
                    first = np.lexsort((ids, -score))[:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[first], "score": score[first]}))
            if out:
                yield pd.concat(out)
    return best


def topk(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
         scale: int = 64, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows of largest integer inner product for each query row, ties
    to the smaller id: ``query_id``, ``rank``, ``vec_id``, ``score``. A query does
    not find rows of its own id.

    A task holds some blocks, and passes on their ``k`` best rows for each query
    that streams past them. Rows whose vector or id is null, or whose vector holds null or
    non-finite components, take no part. Of query rows with one id the least
    vector is asked; repeated candidate rows all compete. Components that a
    shorter vector lacks count as 0. If scores could leave 64 bits, a ValueError
    ends the job.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), quantised(vector, scale).alias("values")).filter(
            "vec_id IS NOT NULL AND values IS NOT NULL")

    index, blocks = build_index(usable(vectors), block_rows=block_rows)
    asked = materialize(usable(queries).groupBy("vec_id").agg(F.min("values").alias("values")), "queries")
    number = asked.count()
    # A span is the blocks that one task holds. Every span meets all queries, dealt
    # to so many places that the cores are busy but blocks are copied a few times.
    largest = index.agg(F.max(F.octet_length("slices"))).first()[0] or 1
    spans = math.ceil(blocks / max(1, SPAN_BYTES // largest))
    wanted = TASKS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    dealt = max(1, min(math.ceil(number / query_block), math.ceil(wanted / spans)))
    first = F.pmod("block", F.lit(spans)) * dealt
    held = index.withColumn("place", F.explode(F.sequence(first, first + (dealt - 1)))).select(
        F.lit(0).alias("kind"), "place", "rows", "bits", "ids", "least", "slices", F.lit(0).cast("bigint").alias("query_id"),
        F.lit(None).cast("array<bigint>").alias("query_values"))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(dealt)).cast("int")
    none = F.lit(None).cast("binary")
    met = asked.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).select(
        F.lit(1).alias("kind"), (F.col("span") * dealt + share).alias("place"), F.lit(0).alias("rows"), F.lit(0).alias("bits"),
        none.alias("ids"), none.alias("least"), none.alias("slices"), F.col("vec_id").alias("query_id"), F.col("values").alias("query_values"))
    # No join: Spark would take a side for as small as it is before it is copied,
    # and send the copies to the driver to be broadcast.
    places = held.unionByName(met).repartitionById(spans * dealt, "place").sortWithinPartitions("kind")
    found = places.mapInPandas(_place(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""
