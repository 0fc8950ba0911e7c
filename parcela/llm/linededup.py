"""Exact line dedup that returns keep bitmaps.

A line is known by a 128-bit hash of its key. Hash rows are partitioned by range
of the hash and sorted within a partition by hash, document and position, so the
first row of each hash names the document that keeps it, and the rows that
follow are streamed past it. What comes back per document is a run-length
bitmap of the lines to keep; texts stay where they are.

A hash that very many lines share would fill one range. All hash buckets are
counted first, and rows of a crowded bucket are cut into slabs by document.
Slabs are streamed like hashes of their own; their first rows then
meet in a second, small round, which names the first document overall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# What is stripped from both ends of a line, and the shortest key that counts.
BLANKS = " \t\n\x0b\x0c\r"
MIN_POINTS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows of one hash bucket beyond which they are cut into slabs.
SLAB_ROWS = 100_000
BUCKETS = 1 << 16

# A line's place; the text's hash parts rows of one id.
_HASH = ["_h1", "_h2"]
_ROW = ["_id", "_th"]


def lines_of(text: Column) -> Column:
    """The text split at line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is fast and touches only A-Z when all characters are ASCII.
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS) -> DataFrame:
    """One row per line whose key has at least ``min_points`` code points:
    ``_h1``, ``_h2`` (hash of the key), ``_id``, ``_th``, ``_at`` (0-based)."""
    lines = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th"),
        F.posexplode(lines_of(F.col(text))).alias("_at", "_line"),
    ).withColumn("_key", line_key(F.col("_line")))
    return lines.filter(F.char_length("_key") >= min_points).select(
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"), *_ROW, "_at")


def _first_document(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_first``: whether their document is the first that holds
    their key. Partitioned by range of the keys, sorted by document and position,
    so the window streams the rows without another shuffle."""
    order = [F.asc_nulls_last("_id"), F.asc("_th"), F.asc("_at")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, *order)
    # The frame holds the rows up to the current one: only its first row is kept.
    stream = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("_first", F.first("_id").over(stream).eqNullSafe(F.col("_id")))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   min_points: int = MIN_POINTS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """The lines to drop: ``_id``, ``_th``, ``_at``, each once per place."""
    lines = materialize(line_hashes(docs, doc_id, text, min_points), "lines")
    bucket = F.pmod(F.col("_h1"), F.lit(BUCKETS)).cast("int")
    # At most BUCKETS rows, whatever the input: safe to broadcast.
    crowded = materialize(
        lines.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).filter(F.col("_n") > slab_rows)
        .select("_bucket", F.ceil(F.col("_n") / slab_rows).alias("_slabs")), "crowded")
    dealt = lines.withColumn("_bucket", bucket).join(F.broadcast(crowded), "_bucket", "left")
    slab = F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_slabs")), F.lit(-1))
    dealt = dealt.withColumn("_slab", slab).drop("_bucket", "_slabs")
    streamed = _first_document(dealt, ["_h1", "_slab", "_h2"])
    # Rows that are first in no slab go; rows that are first in a slab meet again.
    known = materialize(streamed.filter("NOT _first OR _slab >= 0"), "streamed")
    again = _first_document(known.filter("_first").drop("_first"), _HASH)
    gone = known.filter("NOT _first").select(*_ROW, "_at").unionByName(again.filter("NOT _first").select(*_ROW, "_at"))
    return gone


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """Kept runs (start, length) between the sorted dropped positions."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))
    after = F.slice(edges, 2, F.size(edges) - 1)
    gaps = F.transform(F.arrays_zip(F.slice(edges, 1, F.size(edges) - 1).alias("a"), after.alias("b")), lambda e: F.struct(
        (e["a"] + 1).alias("start"), (e["b"] - e["a"] - 1).alias("length")))
    return F.filter(gaps, lambda g: g["length"] > 0)


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 min_points: int = MIN_POINTS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Per document that loses lines: ``_id``, ``_th`` (hash of its text),
    ``dropped`` (sorted 0-based lines to drop). Other documents have no row."""
    gone = repeated_lines(docs, doc_id, text, min_points, slab_rows)
    # A set: rows that are repeated as a whole name the same places.
    return gone.groupBy(*_ROW).agg(F.array_sort(F.collect_set("_at")).alias("dropped"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_points: int = MIN_POINTS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``keep_bitmap``, the kept
    lines as runs (start, length) in order; columns of these names are replaced.

    A line whose key has at least ``min_points`` code points goes if a document
    with a smaller id holds the key as well; within the smallest one all its
    lines stay. Rows of one id are one document, though their lines are told
    apart; rows without id are one document, which comes last. A null or
    empty text is one empty line, which stays. An empty table gives no rows.
    """
    names = ["n_lines", "n_dropped", "keep_bitmap"]
    own = [c for c in docs.columns if c not in names]
    kept = dropped_lines(docs, doc_id, text, min_points, slab_rows)
    # Renamed while joined, so that no column of the input can clash.
    inner = docs.select(F.struct(*own).alias("_row"), F.col(doc_id).alias("_i"), F.xxhash64(F.col(text)).alias("_t"),
                        F.size(lines_of(F.col(text))).alias("_n"))
    both = inner.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return both.select(
        "_row.*", F.col("_n").cast("bigint").alias("n_lines"), F.size(dropped).cast("bigint").alias("n_dropped"),
        kept_runs(dropped, F.col("_n")).alias("keep_bitmap"))


def kept_text(text: Column, keep_bitmap: Column) -> Column:
    """The lines of the runs, joined by line feeds."""
    lines = lines_of(text)
    return F.array_join(F.flatten(F.transform(keep_bitmap, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def digests(docs: DataFrame) -> DataFrame:
    """``dedup_lines`` with the SHA-256 of each kept text."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep_bitmap")), 256).alias("kept_sha256"))


LINES_SQL = f"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {MIN_POINTS} GROUP BY key),
m AS (SELECT k.*, o.owner IS NOT NULL AND o.owner IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""
