"""Merkle manifest of a dataset: roots, and a proof for every row.

A row is a leaf. Leaves are ranked within their group, and the rank is read as
digits to base 8. Blocks of 512 consecutive ranks come together; within a block
the digits are grouped away one after the other, each grouping nesting the nodes
below in their parent. The digests of the blocks are the leaves of the next tier,
until every group has one node; the groups' roots are the leaves of one more tree.

Proofs go down the same way: a tier hands each block the siblings above it. Block
and siblings meet by grouping, and one transform and explode walks the
nested nodes and yields each child with its path, so no leaf is ever joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize, small_or_stored

# Children of a node, and the columns of a leaf in order.
FAN_BITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Levels within one block: 8 ** 3 leaves are nested in a row.
BLOCK_LEVELS = 3
_ID_BITS = 33  # monotonically_increasing_id: the partition stands above these bits


def record_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values, each as its UTF-8 length, a colon and itself;
    a null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts
    ]), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _ranked(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """``leaves`` with ``_rank`` in their group ``_g`` (from 0) and the group's
    size ``_n``. A sort by ranges; only counts per range and group are added up."""
    placed = leaves.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    placed = materialize(placed.withColumn("_nth", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_nth", _ID_BITS)
    counts = placed.groupBy(F.col("_g").alias("_cg"), part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_nth").alias("_start"))
    group = Window.partitionBy("_cg")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group.
    offsets = small_or_stored(counts.select(
        "_cg", "_part", "_start", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("_n")))
    both = placed.join(offsets, (F.col("_g") == F.col("_cg")) & (part == F.col("_part")))
    return both.withColumn("_rank", F.col("_nth") - F.col("_start") + F.col("_before")).drop("_nth", "_cg", "_part", "_start", "_before")


def _hashed(level: int) -> Column:
    """Whether the group still has several nodes below this level."""
    return F.col("_n") > F.lit(1 << FAN_BITS * (level - 1)).cast("bigint")


def _rolled(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes`` (``_g``, ``_n``, ``_rank``, ``node`` with a digest):
    one row per block (``_rank`` is the block's), ``node`` holding all below."""
    rows = nodes.select("_g", "_n", F.shiftright("_rank", FAN_BITS * BLOCK_LEVELS).alias("_block"), "node", *[
        F.shiftright("_rank", FAN_BITS * level).bitwiseAND(F.lit((1 << FAN_BITS) - 1).cast("bigint")).cast("int").alias(f"_d{level}")
        for level in range(BLOCK_LEVELS)])
    rows = rows.repartition("_g", "_block")
    keys = ["_g", "_n", "_block", *[f"_d{level}" for level in reversed(range(BLOCK_LEVELS))]]
    for level in range(1, BLOCK_LEVELS + 1):
        digit = keys.pop()
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), "node"))).alias("_c"))
        children = F.transform("_c", lambda c: c["node"])
        below = F.array_join(F.transform("_c", lambda c: c["node"]["digest"]), "")
        digest = F.when(_hashed(level), F.sha2(below, 256)).otherwise(F.col("_c")[0]["node"]["digest"])
        rows = rows.select(*keys, F.struct(digest.alias("digest"), children.alias("children")).alias("node"))
    return rows.withColumnRenamed("_block", "_rank")


def _children(node: Column, path: Column, level: int) -> Column:
    """A node's children, each with its path: its siblings, then the path above."""
    nodes = node["children"]
    digests = F.transform(nodes, lambda c: c["digest"])

    def child(c: Column, i: Column) -> Column:
        step = F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"),
                        F.array_join(F.slice(digests, i + 2, F.size(digests)), "").alias("right"))
        return F.struct(c.alias("node"), F.when(_hashed(level), F.concat(F.array(step), path)).otherwise(path).alias("path"))

    return F.transform(nodes, child)


def _opened(level: int) -> Callable[[Column], Column]:
    return lambda x: _children(x["node"], x["path"], level)


def _unrolled(blocks: DataFrame, above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The nodes below ``blocks``: ``_g``, ``_rank``, ``node``, ``path`` and the
    ``carried`` columns of ``above``, which has one row per block."""
    def nothing(df: DataFrame, c: str) -> Column:
        return F.lit(None).cast(df.schema[c].dataType).alias(c)

    down = ["path", *carried]
    met = blocks.select("_g", "_rank", "_n", "node", *[nothing(above, c) for c in down]).unionByName(
        above.select("_g", "_rank", nothing(blocks, "_n"), nothing(blocks, "node"), *down))
    met = met.groupBy("_g", "_rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_n", "node", *down)])
    found = F.array(F.struct(F.col("node"), F.col("path")))
    for level in reversed(range(1, BLOCK_LEVELS + 1)):
        found = F.flatten(F.transform(found, _opened(level)))
    # A block's children are full except in the last one, so positions are ranks.
    return met.select("_g", "_rank", *carried, F.posexplode(found).alias("_at", "_x")).select(
        "_g", (F.shiftleft("_rank", FAN_BITS * BLOCK_LEVELS) + F.col("_at")).alias("_rank"), *carried, "_x.node", "_x.path")


def _roll_up(leaves: DataFrame, order: list[Column]) -> tuple[list[DataFrame], DataFrame]:
    """All tiers of the trees over ``leaves`` (``_g``, ``node``) and the trees'
    roots (``_g``, ``digest``)."""
    nodes = _ranked(leaves, order)
    most = nodes.agg(F.max("_n")).first()[0] or 1
    tiers = []
    while True:
        blocks = materialize(_rolled(nodes), "blocks")
        tiers.append(blocks)
        most = -(-most >> FAN_BITS * BLOCK_LEVELS)
        if most <= 1:
            return tiers, blocks.select("_g", F.col("node.digest").alias("digest"))
        size = 1 << FAN_BITS * BLOCK_LEVELS
        nodes = blocks.select("_g", F.ceil(F.col("_n") / size).alias("_n"), "_rank", F.struct(F.col("node.digest").alias("digest")).alias("node"))


def _walk_down(tiers: list[DataFrame], tops: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Every leaf of the tiers with its path; ``tops`` has ``_g``, the ``path``
    above the group's root and the ``carried`` columns."""
    above = tops.withColumn("_rank", F.lit(0).cast("bigint"))
    for i, blocks in enumerate(reversed(tiers)):
        above = _unrolled(blocks, above, carried)
        if i + 1 < len(tiers):
            above = materialize(above.drop("node"), "paths")
    return above


_NO_PATH = "CAST(array() AS array<struct<left: string, right: string>>)"


def proofs(leaves: DataFrame, key: str = "key", group: str = "group", digest: str = "digest", payload: Sequence[str] = ()) -> DataFrame:
    """Proof of each leaf: ``key``, ``leaf``, ``path`` (siblings from the leaf up,
    each level ``left`` and ``right`` of the node), ``subroot`` (of the leaf's
    group), ``root`` and the ``payload`` columns.

    Leaves of a group ascend by ``key`` (null first; rows of one key by their
    digest), groups by name (null first, bytewise). Up to 8 consecutive nodes make
    a parent, a lone node stays as it is. An empty table gives no rows.
    """
    # The mark keeps the null group apart and first.
    name = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    node = F.struct(F.col(digest).alias("digest"), F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"p_{c}") for c in payload]).alias("own"))
    rows = leaves.select(name.alias("_g"), F.col(key).alias("_k"), F.col(digest).alias("_leaf"), node.alias("node"))
    tiers, subroots = _roll_up(rows, [F.col("_k"), F.col("_leaf")])
    # The groups' roots are the leaves of a tree of their own.
    one = subroots.select(F.lit("").alias("_g"), F.col("_g").alias("_name"), F.struct("digest", F.col("_g").alias("name")).alias("node"))
    over, root = _roll_up(one, [F.col("_name")])
    tops = root.select("_g", F.col("digest").alias("root"), F.expr(_NO_PATH).alias("path"))
    groups = _walk_down(over, tops, ["root"]).select(
        F.col("node.name").alias("_g"), "root", F.col("node.digest").alias("subroot"), "path")
    found = _walk_down(tiers, materialize(groups, "groups"), ["root", "subroot"])
    return found.select(F.col("node.own.key").alias(key), F.col("node.digest").alias("leaf"), "path", "subroot", "root",
                        *[F.col(f"node.own.p_{c}").alias(c) for c in payload])


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified(docs: DataFrame, altered: Column | None = None, fields: Sequence[str] = FIELDS,
             key: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """Manifest of ``docs`` and a check of each row against it: ``key``, ``leaf``,
    ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    The manifest is made of the rows as they are. Rows where ``altered`` is true
    then come to the check with A-Z of their text in lower case, so their folded
    root differs if that changes anything. A row without key counts as unaltered
    and comes first in its group; nulls, empty and repeated rows are leaves as
    any other. Columns other than ``fields`` play no part.
    """
    plain = [F.col(c) for c in fields]
    other = [lowered(F.col(c)) if c == text else F.col(c) for c in fields]
    tampered = F.when(F.coalesce(F.lit(False) if altered is None else altered, F.lit(False)), record_digest(other))
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), record_digest(plain).alias("digest"), tampered.alias("shown"))
    found = proofs(leaves, payload=["shown"])
    folded = found.withColumn("folded_root", fold(F.coalesce("shown", "leaf"), F.col("path")))
    return folded.select(F.col("key").alias(key), "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def third_of_ids(key: str = "doc_id") -> Column:
    """Rows whose key, in decimal, has a CRC-32 that 3 divides."""
    return F.crc32(F.col(key).cast("string")) % 3 == 0


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {text})"
_CRC = """xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
    WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT))"""

MERKLE_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format(text=_FIELD.format('text'))} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text=_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')"))} END AS shown FROM documents),
l AS MATERIALIZED (SELECT *, coalesce('=' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
up AS (SELECT g, 0 AS lvl, idx, leaf AS digest FROM l
  UNION ALL SELECT g, lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM up) WHERE n > 1 GROUP BY g, lvl, idx // 8),
sub AS MATERIALIZED (SELECT g, max(lvl) AS height, arg_max(digest, lvl) AS subroot, row_number() OVER (ORDER BY g) - 1 AS gidx FROM up GROUP BY g),
over_ AS (SELECT 0 AS lvl, gidx AS idx, subroot AS digest FROM sub
  UNION ALL SELECT lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM over_) WHERE n > 1 GROUP BY lvl, idx // 8),
nodes AS MATERIALIZED (SELECT g, lvl, idx, digest FROM up UNION ALL SELECT '' AS g, lvl, idx, digest FROM over_),
top AS MATERIALIZED (SELECT max(lvl) AS height, arg_max(digest, lvl) AS root FROM over_),
steps AS MATERIALIZED (SELECT a.g, a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS lhs,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS rhs
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 GROUP BY a.g, a.lvl, a.idx),
walk AS (SELECT r, g, 0 AS lvl, idx, coalesce(shown, leaf) AS acc, '' AS sibs, 0 AS n FROM l
  UNION ALL SELECT w.r, CASE WHEN w.lvl = s.height THEN '' ELSE w.g END, CASE WHEN w.lvl = s.height THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN w.lvl = s.height THEN s.gidx ELSE w.idx // 8 END, CASE WHEN w.lvl = s.height THEN w.acc ELSE sha256(t.lhs || w.acc || t.rhs) END,
    CASE WHEN w.lvl = s.height THEN w.sibs ELSE w.sibs || t.lhs || t.rhs END, w.n + 1
  FROM walk w JOIN (SELECT g, height, gidx FROM sub UNION ALL SELECT '', (SELECT height FROM top) + 1000, 0) s ON w.g = s.g
  JOIN steps t ON t.g = w.g AND t.lvl = w.lvl AND t.idx = w.idx WHERE NOT (w.g = '' AND w.lvl = (SELECT height FROM top))),
ends AS (SELECT r, arg_max(acc, n) AS folded, arg_max(sibs, n) AS sibs FROM walk GROUP BY r)
SELECT l.doc_id, l.leaf, sub.subroot, top.root, sha256(ends.sibs) AS proof_sha256, ends.folded AS folded_root, ends.folded = top.root AS verified
FROM l JOIN sub USING (g) JOIN ends USING (r), top"""
