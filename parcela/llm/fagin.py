"""Hard negatives by Fagin's threshold algorithm.

The vectors are stored in blocks of rows. A block keeps, for each dimension, its
rows in order of their value. An anchor reads all lists at once, from the top
where its own component is positive and from the bottom where it is negative;
every row that turns up is scored in full. What no list has shown yet cannot score
more than the anchor against the last values read: the threshold. Reading stops
once the threshold is strictly below the last place of every window still open,
strictly since a tie may go to a smaller id.

First pass: each anchor's best rows of its own label. Second pass: for each of
these, the best rows of other labels within a window under its score. The
index stays where it is stored; anchors come to it in passes of bounded size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize, shared_dir

BLOCK_ROWS = 8192
# Anchors that go to the index at once: some 8 MB of 64 whole numbers each.
PASS_ANCHORS = 16_384
# Rows read from each list before the first look at the threshold; doubles then.
FIRST_DEPTH = 16


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * component) in 64 bits; null if a component is null or not finite."""
    v = F.col(vector)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _blocks(width: int, block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut a partition's rows into blocks with a sorted list per dimension."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            ids, labels = (rows[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            values = _matrix(rows["values"], width)
            lists = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
            cells = {"rows": len(ids), "ids": ids.tobytes(), "labels": labels.tobytes(), "components": values.tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}
            return pa.RecordBatch.from_pydict({k: [v] for k, v in cells.items()},
                                              schema=pa.schema([("rows", pa.int32()), *[(k, pa.binary()) for k in list(cells)[1:]]]))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block_rows:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, block_rows))
                held = rows.slice(block_rows).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))
    return build


class Block:
    """One block of the index, ready for reading."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, lists: np.ndarray, largest: int):
        self.ids, self.labels, self.values, self.lists = ids, labels, values, lists
        # Scores and a hundredfold of them must stay exact.
        most = max(1, values.shape[1]) * max(int(np.abs(values).max(initial=0)), 1) * max(largest, 1)
        if 100 * most >= 1 << 63:
            raise ValueError("components are too large: scores leave 64 bits")
        self.number = np.float64 if most < 1 << 53 else np.int64
        self.exact = values.astype(self.number)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows new at each depth, their scores, and the threshold: no row that
        is still to come scores more. None: no row is to come."""
        rows = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        asked = anchor.astype(self.number)
        seen, left = np.zeros(rows, bool), rows
        depth, step = 0, FIRST_DEPTH
        if not len(up) and not len(down):
            # All scores are 0 and no list says more than another.
            yield np.arange(rows), np.zeros(rows, np.int64), None
            return
        while left:
            last = min(rows, depth + step)
            now = np.zeros(rows, bool)
            now[self.lists[up, rows - last:rows - depth]] = True
            now[self.lists[down, depth:last]] = True
            now &= ~seen
            seen |= now
            new = np.flatnonzero(now)
            left -= len(new)
            threshold = None
            if left:
                ends = self.values[self.lists[up, rows - last], up] @ anchor[up] + self.values[self.lists[down, last - 1], down] @ anchor[down]
                threshold = int(ends)
            yield new, (self.exact[new] @ asked).astype(np.int64), threshold
            depth, step = last, 2 * step
            if threshold is None:
                return


class Best:
    """The best ``k`` rows so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.ids) == self.k:
            good = scores >= self.scores[-1]
            ids, scores = ids[good], scores[good]
        if len(ids):
            ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
            order = np.lexsort((ids, -scores))[:self.k]
            self.ids, self.scores = ids[order], scores[order]

    def closed(self, threshold: int) -> bool:
        return len(self.ids) == self.k and threshold < self.scores[-1]


def nearest_of_label(block: Block, anchor: np.ndarray, anchor_id: int, label: int, k: int) -> tuple[Best, int]:
    """The ``k`` best other rows of the label, and how many rows were scored."""
    best, scored = Best(k), 0
    for rows, scores, threshold in block.read(anchor):
        scored += len(rows)
        mine = (block.labels[rows] == label) & (block.ids[rows] != anchor_id)
        best.offer(block.ids[rows[mine]], scores[mine])
        if threshold is not None and best.closed(threshold):
            break
    return best, scored


def best_in_windows(block: Block, anchor: np.ndarray, anchor_id: int, label: int, tops: list[int], k: int, percent: int) -> tuple[list[Best], int]:
    """Per window under a top score, the ``k`` best rows of other labels."""
    found, scored = [Best(k) for _ in tops], 0
    still = list(range(len(tops)))
    for rows, scores, threshold in block.read(anchor):
        scored += len(rows)
        other = (block.labels[rows] != label) & (block.ids[rows] != anchor_id)
        ids, scores = block.ids[rows[other]], scores[other]
        for w in still:
            inside = (percent * tops[w] <= 100 * scores) & (scores <= tops[w])
            found[w].offer(ids[inside], scores[inside])
        if threshold is not None:
            still = [w for w in still if not (found[w].closed(threshold) or 100 * threshold < percent * tops[w])]
            if not still:
                break
    return found, scored


def _per_block(width: int, work: Callable, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply ``work(block, anchors)`` to each block with the anchors beside it."""
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {n: batch.column(n)[i] for n in batch.schema.names}
                ids, labels, values, lists = (np.frombuffer(cell[n].as_buffer(), t) for n, t in (
                    ("ids", np.int64), ("labels", np.int64), ("components", np.int64), ("lists", np.int32)))
                anchors = cell["anchors"].values
                vectors = _matrix(anchors.field("values"), width)
                block = Block(ids, labels, values.reshape(-1, width), lists.reshape(width, -1), int(np.abs(vectors).max(initial=0)))
                out = work(block, anchors, vectors)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
    return run


def _positives(k: int) -> Callable:
    def work(block: Block, anchors: pa.StructArray, vectors: np.ndarray) -> list[tuple]:
        out = []
        for a, label, vector in zip(anchors.field("vec_id").to_pylist(), anchors.field("label").to_pylist(), vectors):
            best, _ = nearest_of_label(block, vector, a, label, k)
            out += [(a, int(i), int(s)) for i, s in zip(best.ids, best.scores)]
        return out
    return work


def _negatives(k: int, percent: int) -> Callable:
    def work(block: Block, anchors: pa.StructArray, vectors: np.ndarray) -> list[tuple]:
        out = []
        columns = (anchors.field(n).to_pylist() for n in ("vec_id", "label", "positives"))
        for a, label, positives, vector in zip(*columns, vectors):
            tops = sorted({p["score"] for p in positives})
            found = dict(zip(tops, best_in_windows(block, vector, a, label, tops, k, percent)[0]))
            for p in positives:
                best = found[p["score"]]
                out += [(a, p["vec_id"], p["score"], int(i), int(s)) for i, s in zip(best.ids, best.scores)]
        return out
    return work


def _over_passes(index: DataFrame, anchors: DataFrame, passes: int, width: int, work: Callable, names: list[str]) -> DataFrame:
    """``work`` for every block and anchor. A pass broadcasts its anchors, one row
    of about PASS_ANCHORS at most, so the index is read but never shuffled."""
    spark = index.sparkSession
    packed = materialize(anchors.groupBy("_pass").agg(F.collect_list(F.struct(*[c for c in anchors.columns if c != "_pass"])).alias("anchors")), "anchors")
    schema = ", ".join(f"{n} bigint" for n in names)
    path = f"{shared_dir(spark)}/parcela-mined-{uuid.uuid4().hex}"
    for p in range(passes):
        here = packed.filter(F.col("_pass") == p).select("anchors")
        index.crossJoin(F.broadcast(here)).mapInArrow(_per_block(width, work, names), schema).write.parquet(f"{path}/pass={p}")
    return spark.read.schema(schema).parquet(*[f"{path}/pass={p}" for p in range(passes)])


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256,
         vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
         block_rows: int = BLOCK_ROWS, pass_anchors: int = PASS_ANCHORS) -> DataFrame:
    """Hard negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    Scores are integer inner products of floor(``scale`` * component), higher ones
    first, ties by smaller id. An anchor's positives are its best other rows of
    its (whole-number) label. For each positive the best rows of other labels come back whose
    score is ``percent`` % to 100 % of the positive's.

    Rows without id, label or vector, or with a null or non-finite component, take
    no part. Rows repeated as a whole count once; other rows of one id all
    compete, and of an anchor id the least label and vector asks. A row
    never meets its own id. Components that a shorter vector lacks count as 0. If
    scores could leave 64 bits, a ValueError ends the job. Other columns play no
    part; an empty table gives no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
                         quantised(vector, scale).alias("values")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND values IS NOT NULL")

    stored = materialize(usable(vectors).distinct(), "vectors")
    rows, width = stored.agg(F.count("*"), F.coalesce(F.max(F.size("values")), F.lit(0))).first()
    width = max(1, width)
    whole = F.concat("values", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("values")))
    index = materialize(
        stored.withColumn("values", whole).repartition(max(1, math.ceil(rows / block_rows)))
        .mapInArrow(_blocks(width, block_rows), "rows int, ids binary, labels binary, components binary, lists binary"), "lists")

    asked = usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "values")).alias("least"))
    asked = asked.select("vec_id", "least.label", F.slice("least.values", 1, width).alias("values")).withColumn("values", whole)
    number = (asked := materialize(asked, "asked")).count()
    passes = max(1, math.ceil(number / pass_anchors))
    # Dealt in turn, so that passes are of equal size.
    asked = materialize(asked.repartition(passes).withColumn("_pass", F.spark_partition_id()), "dealt")

    near = _over_passes(index, asked, passes, width, _positives(positives), ["anchor_id", "vec_id", "score"])
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), F.asc("vec_id"))
    near = near.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= positives)
    chosen = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.struct("vec_id", "score")).alias("positives"))
    asked = asked.join(chosen, "vec_id")

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    hard = _over_passes(index, asked, passes, width, _negatives(negatives, percent), names)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    ranked = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


MINE_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5"""
