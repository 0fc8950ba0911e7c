"""Key-based writes: insert if absent, upsert, delete together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from ..session import MAX_SMALL_ROWS, materialize, small_or_stored
from .cleaning import first_per_key

# Key hashes of a batch that are broadcast at a time: some 100 MB in a task's process.
MAX_BROADCAST_HASHES = 1 << 21
# Broadcasts, one after the other, before the target is shuffled instead.
MAX_BROADCASTS = 8
# Types whose equal values have equal texts.
_PLAIN_KEYS = (T.StringType(), T.LongType(), T.IntegerType())


def key_hash(key: str) -> Column:
    """64 bits of a key's text; null is a key."""
    return F.xxhash64(F.col(key).cast("string"))


def hashed_keys(batch: DataFrame, key: str) -> DataFrame:
    """The batch's key hashes ``_hash`` and their row counts ``_n``, stored."""
    return materialize(batch.groupBy(key_hash(key).alias("_hash")).agg(F.count("*").alias("_n")), "keys")


def counted(keys: DataFrame, *more: Column) -> Row:
    """Of ``hashed_keys`` in one job: how many, ``n``, how many with several rows, ``again``, and ``more``."""
    return keys.agg(F.count("*").alias("n"), F.count_if(F.col("_n") > 1).alias("again"), *more).first()


def first_of_hashed(batch: DataFrame, keys: DataFrame, again: int, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """``first_per_key`` of a stored batch whose ``hashed_keys`` are known, ``again``
    of them with several rows. Only rows whose hash occurs again are shuffled, unless
    those hashes are many; two keys of one hash cost a comparison, no row."""
    if not again:
        return batch
    if again > MAX_SMALL_ROWS:
        return first_per_key(batch, [key], order)
    side = F.broadcast(keys.filter("_n > 1").select("_hash"))
    once, more = (batch.join(side, key_hash(key) == F.col("_hash"), how) for how in ("left_anti", "left_semi"))
    return once.unionByName(first_per_key(more, [key], order))


def without_stored(batch: DataFrame, keys: DataFrame, n: int, target: DataFrame, key: str,
                   prefix: tuple[str, int] | None = None) -> DataFrame:
    """Rows of a stored batch whose key is not in ``target``. The target's key
    column is scanned past the batch's ``n`` hashes; what passes is compared by key.

    More hashes than one broadcast may hold go in slices, one after the other.
    ``prefix``: the target's partition column and the number its key hashes are
    divided by there; a slice then reads its own partitions only.
    """
    slices = 1
    # Powers of two, which divide the usual number of prefixes.
    while slices * MAX_BROADCAST_HASHES < n and slices <= MAX_BROADCASTS:
        slices *= 2
    hashes, parts = keys.select("_hash"), []
    if slices > MAX_BROADCASTS:
        parts.append((target, hashes.hint("shuffle_hash")))
    else:
        own = prefix is not None and prefix[1] % slices == 0
        for i in range(slices):
            rows = target.filter(F.col(prefix[0]) % slices == i) if own and slices > 1 else target
            parts.append((rows, F.broadcast(hashes.filter(F.pmod("_hash", F.lit(slices)) == i))))
    for rows, side in parts:
        stored = rows.select(F.col(key).alias("_stored"))
        known = small_or_stored(stored.join(side, key_hash("_stored") == F.col("_hash"), "left_semi").distinct())
        # A null key is one key: rows without key are stored once.
        batch = batch.join(known, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")
    return batch


def plain_key(batch: DataFrame, target: DataFrame, key: str) -> bool:
    """Whether the keys of both may be compared by the hash of their text."""
    return batch.schema[key].dataType == target.schema[key].dataType and batch.schema[key].dataType in _PLAIN_KEYS


def unseen_rows(batch: DataFrame, target: DataFrame, key: str = "_id",
                order: Sequence[Column] = ()) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``target``; the first of a key wins.

    The batch's keys go to the target, not the target to the batch: with a
    batch of ordinary size the target is only scanned (its key column), never
    shuffled.
    """
    if plain_key(batch, target, key):
        batch = materialize(batch, "batch")
        keys = hashed_keys(batch, key)
        found = counted(keys)
        return without_stored(first_of_hashed(batch, keys, found.again, key, order), keys, found.n, target, key)
    batch = materialize(first_per_key(batch, [key], order), "first")
    keys = small_or_stored(batch.select(F.col(key).alias("_key")))
    stored = target.select(F.col(key).alias("_stored"))
    known = small_or_stored(stored.join(keys, F.col("_stored").eqNullSafe(F.col("_key")), "left_semi").distinct())
    return batch.join(known, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")


def upsert(df: DataFrame, updates: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """``df`` with ``updates`` added; an update replaces the row of its key."""
    updates = materialize(first_per_key(updates, [key], order), "updates")
    keys = small_or_stored(updates.select(F.col(key).alias("_key")))
    return df.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(updates, allowMissingColumns=True)


def cascade_delete(vectors: DataFrame, deleted: DataFrame, key: str = "_id") -> DataFrame:
    """Vector rows whose listing was not deleted."""
    return vectors.join(small_or_stored(deleted.select(key).distinct()), key, "left_anti")


def union_listings(*tables: DataFrame) -> DataFrame:
    """Union by column name; a column one table lacks is null there."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
