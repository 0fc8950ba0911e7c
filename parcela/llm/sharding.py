"""Shards of bounded size by extendible hashing.

A row's shard is a prefix of the hash of its key. The directory starts with one
bucket for everything; a bucket above the byte limit is split on its next hash
bit, buckets that fit stay as they are. All bucket sizes are sums over narrow
columns, so no task sees a bucket's rows before the shards are final.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize, small_or_stored
from .names import set_apart

HASH_BITS = 60
SHARD_BYTES = 64 << 20
# Bits beyond the expected depth that the first round of counting looks at, and
# what later rounds look at: at most so many bits, and cells unless more are full.
EXTRA_BITS = 1
ROUND_BITS, ROUND_CELLS = 10, 20_000


def key_hash(key: str) -> Column:
    """The first 60 bits of the key's MD5; a null key hashes as the empty text."""
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def _cell(bits: int) -> Column:
    return F.shiftright("_hash", HASH_BITS - bits)


def _buckets(sizes: DataFrame, bits: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Final buckets (depth, prefix) among the prefixes of up to ``bits`` bits,
    and the cells that are still too large at ``bits`` bits."""
    cells = sizes.groupBy(_cell(bits).alias("cell")).agg(F.sum("_bytes").alias("bytes"))
    # Every node of the bit trie: sums are combined before the shuffle.
    nodes = materialize(
        cells.select(F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"), "cell", "bytes")
        .groupBy("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix"))
        .agg(F.sum("bytes").alias("bytes")),
        "trie",
    )
    full = nodes.filter(F.col("bytes") > limit)
    fits = nodes.filter(F.col("bytes") <= limit)
    split = full.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
    children = fits.withColumn("_parent", F.shiftright("prefix", 1)).join(split, ["depth", "_parent"], "left_semi")
    found = children.select("depth", "prefix").unionByName(fits.filter("depth = 0").select("depth", "prefix"))
    return found, full.filter(F.col("depth") == bits).select(F.col("prefix").alias("cell"))


def _directory(buckets: DataFrame, bits: int) -> DataFrame:
    """One entry per hash prefix of ``bits`` bits, naming the bucket it leads to."""
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {bits} - depth) - 1")
    return buckets.select(F.explode(F.sequence(first, last)).alias("_cell"), "depth", "prefix")


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``df`` with ``n_bytes``, ``shard`` (the bucket's hash bits, empty for a
    single bucket), ``depth`` (their number) and ``page``.

    Every (shard, page) holds at most ``limit`` bytes of UTF-8 text, unless one
    row alone is larger. ``page`` is 0 except where rows of the very same key
    exceed the limit: no further bit parts those, so they overflow into pages by
    running size, counted separately for each input partition; rows above half
    the limit get a page of their own. A null text has 0 bytes, an empty table
    gives no rows. Columns of the four names in ``df`` are replaced.
    """
    clash = [c for c in ("n_bytes", "shard", "depth", "page") if c in df.columns]
    own, named = set_apart(df.drop(*clash), ["_hash", "_prefix", "_cell", "_d", "_p", "_over", "_part"], [key, text])
    keyed = own.withColumns({
        "_hash": key_hash(key),
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"),
    })
    sizes = materialize(keyed.select("_hash", F.col("n_bytes").alias("_bytes")), "sizes")
    total = sizes.agg(F.sum("_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + EXTRA_BITS)

    placed = keyed.withColumns({"depth": F.lit(None).cast("int"), "_prefix": F.lit(None).cast("bigint")})
    while True:
        buckets, full = _buckets(sizes, bits, limit)
        directory = small_or_stored(_directory(buckets, bits).withColumnsRenamed({"depth": "_d", "prefix": "_p"}))
        placed = (
            placed.withColumn("_cell", _cell(bits)).join(directory, "_cell", "left")
            .withColumns({"depth": F.coalesce("depth", "_d"), "_prefix": F.coalesce("_prefix", "_p")})
            .drop("_cell", "_d", "_p")
        )
        full = small_or_stored(full)
        crowded = full.count()
        if not crowded or bits == HASH_BITS:
            break
        # Only the buckets that are still too large are looked at again.
        sizes = sizes.withColumn("cell", _cell(bits)).join(full, "cell", "left_semi").drop("cell")
        step = int(math.log2(max(2, ROUND_CELLS // crowded)))
        bits = min(HASH_BITS, bits + min(ROUND_BITS, step))

    placed = placed.withColumns({
        "_over": F.col("depth").isNull(),
        "depth": F.coalesce("depth", F.lit(HASH_BITS)),
        "_prefix": F.coalesce("_prefix", F.col("_hash")),
    })
    page = F.lit(0).cast("bigint")
    if crowded:
        placed = placed.withColumn("_part", F.spark_partition_id())
        page = _overflow_page(limit)
    shard = F.expr("if(depth = 0, '', lpad(bin(_prefix), depth, '0'))")
    return named(placed.withColumns({"shard": shard, "page": page}).select(*own.columns, "n_bytes", "shard", "depth", "page"))


def _overflow_page(limit: int) -> Column:
    """Pages of rows that share one hash: at most half the limit starts before
    a row on its page, and rows above that half stand alone."""
    half = limit // 2
    large = F.col("n_bytes") > half
    # Rows of other buckets share no window: their hash and salt set them apart.
    own = Window.partitionBy("_hash", "_part", F.when(~F.col("_over"), F.monotonically_increasing_id()))
    before = own.orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    small = F.floor(F.coalesce(F.sum(F.when(~large, F.col("n_bytes"))).over(before), F.lit(0)) / max(half, 1))
    nth = F.sum(F.when(large, 1).otherwise(0)).over(own.orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, 0))
    number = F.when(large, 2 * nth + 1).otherwise(2 * small)
    return F.when(F.col("_over"), F.col("_part") * F.lit(1 << 32) + number).otherwise(0).cast("bigint")


def together(df: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Rows of ``shard_rows`` with those of a (shard, page) in one partition. The
    number of partitions follows the bytes, so a task's share does not grow."""
    total = df.agg(F.sum("n_bytes")).first()[0] or 0
    return df.repartition(max(1, math.ceil(2 * total / limit)), "shard", "page")


def write_shards(df: DataFrame, path: str) -> None:
    """Write rows of ``shard_rows`` so that each shard is one folder."""
    together(df).write.partitionBy("shard", "page").parquet(path)


def shard_sql(limit: int = SHARD_BYTES) -> str:
    """The same shards in DuckDB: the least depth whose prefix fits. Where doc_ids
    are unique, a row that fits nowhere is larger than the limit by itself and
    stands alone on the first page of large rows."""
    return f"""
WITH d AS (SELECT documents.*, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
     s AS (SELECT d.*, r.depth, h >> (60 - r.depth) AS prefix,
         sum(n_bytes) OVER (PARTITION BY r.depth, h >> (60 - r.depth)) AS bytes
         FROM d, (SELECT unnest(range(0, 61))::INT AS depth) r)
SELECT doc_id, text, lang, source, n_chars, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       CASE WHEN bytes > {limit} THEN 3 ELSE 0 END::BIGINT AS page
FROM s WHERE bytes <= {limit} OR depth = 60
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""
