"""Near-duplicate documents with an LSH forest.

A document's MinHash signature is cut into blocks of values, and every tree of
the forest sorts all documents by another order of the blocks. Neighbours in a
tree's order whose longest common prefix holds a whole block form a region.
Within a region the exact links are searched on the full shingle sets, starting
from one document and asking only documents not yet reached, so a group of n
copies costs about n comparisons and gives n - 1 links.

A region with too much text for one task is cut into pieces that all hold its
first document. If what that one does not reach is more than one task holds too,
the region goes deeper: its documents are sorted again under every block that
its prefix does not hold yet, so unlike texts part and the region costs no
square of its text. Depth is thus adaptive, one more block at a time.

Documents with equal shingle sets are one class from the start. The links of
all regions are joined to components by spreading the least id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, small_or_stored
from .names import set_apart

# Blocks of a signature, each the start of one tree's order, and values of a block.
TREES = 16
DEPTH = 4
SIGNATURE = TREES * DEPTH
# Blocks in the longest prefix; what is crowded even there is compared in full.
LEVELS = 4
# Characters of text one region task holds before the region is cut.
REGION_CHARS = 4 << 20

_SEED = np.random.default_rng(20_240_501)
_MULTIPLY = (_SEED.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


class _WordHashes(dict):
    """Word -> 64-bit hash, forgetting everything when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, cache: dict) -> np.ndarray:
    """Sorted different hashes of the runs of ``words`` words. Words are parted by
    ASCII white space and A-Z count as a-z; fewer words are one shingle."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(h) - words + 1)
    run = np.full(n, len(h) if len(h) < words else 0, np.uint64)
    for i in range(min(words, len(h))):
        run = (run ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    return np.unique(run)


def _signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each hash function; the top 32 bits are enough to compare."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        piece = shingles[start:start + 4096]
        np.minimum(least, (piece * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).astype(np.int32)


def _profile(words: int, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = _WordHashes()
    for part in parts:
        out = []
        for row, text in zip(part["_id"], part["_text"]):
            s = shingle_set(text, words, cache)
            whole = xxhash.xxh3_128_hexdigest(s.tobytes())
            out.append((row, len(s), whole, _signature(s) if len(s) else None, len(text or "")))
        yield pd.DataFrame(out, columns=["_id", "n_shingles", "_set", "_sig", "_chars"])


def _block(number: Column) -> list[Column]:
    """The values of a block, two to a number."""
    value = lambda i: F.get("_sig", number * DEPTH + i).cast("bigint")
    pair = lambda i: F.shiftleft(value(i), 32).bitwiseOR(value(i + 1).bitwiseAND(F.lit(0xFFFFFFFF)))
    return [pair(0).alias("_k1"), pair(2).alias("_k2")]


_ORDER = ["_tree", "_k1", "_k2"]


def _neighbours(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted part that share a whole block with the row before or
    after. The outer rows stay: their neighbours are in another part."""
    held, near = None, True
    for part in parts:
        if part.empty:
            continue
        rows = part if held is None else pd.concat([held, part], ignore_index=True)
        place = rows[_ORDER].to_numpy()
        same = (place[1:] == place[:-1]).all(axis=1)
        keep = np.zeros(len(rows), bool)
        keep[0] = near
        keep[1:] |= same
        keep[:-1] |= same
        held, near = rows.iloc[-1:], bool(keep[-1])
        yield rows.iloc[:-1][keep[:-1]]
    if held is not None:
        yield held


def _gathered(placed: DataFrame, most: int) -> DataFrame:
    """Members of the regions of sorted orders. ``placed`` names for every
    document and order (``_tree``) the block it is sorted by, the blocks its
    prefix then holds (bits of ``_used``) and whether its links are still wanted
    (``_open``); a region without open documents is left out."""
    ordered = placed.repartitionByRange(*_ORDER, "_id").sortWithinPartitions(*_ORDER, "_id")
    near = materialize(ordered.mapInPandas(_neighbours, placed.schema), "neighbours")
    near = near.select("_id", "_chars", "_tree", "_used", "_open", F.xxhash64(*_ORDER).alias("_region"))
    hashed = F.xxhash64("_id")
    halves = [hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32)]
    sizes = near.groupBy("_tree", "_region").agg(
        F.count("*").alias("n"), F.sum("_chars").alias("chars"), F.min("_id").alias("first"), F.max("_open").alias("open"),
        # Sums of 32-bit halves: no number of members overflows them.
        F.struct(*[F.sum(half) for half in halves]).alias("members"),
    ).filter("n > 1 AND open")
    # Trees often agree on a region: equal members are looked at once.
    once = sizes.groupBy("n", "members", "first").agg(F.min(F.struct("_tree", "_region", "chars")).alias("r")).select("r.*", "n", "first")
    once = small_or_stored(materialize(once, "once"))
    cut = F.col("chars") > most
    pieces = F.least(F.ceil(F.col("chars") / most), F.col("n"))
    # The first document of a region meets each of its pieces.
    is_first = F.col("_id") == F.col("first")
    own = F.when(is_first, F.sequence(F.lit(0).cast("bigint"), pieces - 1)).otherwise(F.array(F.pmod(hashed, pieces)))
    joined = near.join(once, ["_tree", "_region"]).withColumn("_piece", F.explode(own))
    return materialize(joined.select(
        "_id", F.xxhash64("_region", "_tree", "_piece").alias("_region"), F.when(cut, F.xxhash64("_region", "_tree")).alias("_base"),
        F.when(cut & ~is_first, F.col("_piece")).alias("_piece"), "_used", "_open").distinct(), "members")


def regions(profiles: DataFrame, most: int = REGION_CHARS) -> DataFrame:
    """Regions of at least two classes: ``_region`` and ``_id``, each set of
    members once. Regions with more than ``most`` characters are cut into pieces,
    named by ``_base`` and ``_piece`` (else null), that all hold the region's
    least document, to which nearly everything in a group of copies links. That
    document itself has no ``_piece``."""
    block = F.col("_tree").cast("int")
    trees = profiles.select("_id", "_sig", "_chars", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(TREES - 1).cast("bigint"))).alias("_tree"))
    return _gathered(trees.select("_id", "_chars", "_tree", *_block(block), F.expr("shiftleft(1L, int(_tree))").alias("_used"),
                                  F.lit(True).alias("_open")), most)


def _deeper(alone: DataFrame, members: DataFrame, profiles: DataFrame, most: int) -> DataFrame:
    """Regions one block deeper below the regions of ``alone`` (``_base``,
    ``_id``), whose documents have links still to be found."""
    bases = alone.select("_base").distinct()
    inside = members.filter("_base IS NOT NULL").join(bases, "_base", "left_semi").groupBy("_base", "_id").agg(F.max("_used").alias("_used"))
    inside = inside.join(alone.select("_base", "_id", F.lit(True).alias("_open")), ["_base", "_id"], "left")
    blocks = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.getbit("_used", t) == 0)
    trees = inside.join(profiles.select("_id", "_sig", "_chars"), "_id").withColumn("_next", F.explode(blocks))
    return _gathered(trees.select(
        "_id", "_chars", F.xxhash64("_base", "_next").alias("_tree"), *_block(F.col("_next")),
        F.expr("_used | shiftleft(1L, _next)").alias("_used"), F.coalesce("_open", F.lit(False)).alias("_open")), most)


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph "100 * shared >= percent * union".

    Breadth first over documents; each asks only those not reached so far,
    through lists of the documents that hold a shingle.
    """
    sizes = np.array([len(s) for s in sets])
    left = np.ones(len(sets), bool)
    links: list[tuple[int, int]] = []
    listed = np.empty(0, int)

    def lists() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([sets[i] for i in listed])
        owner = np.repeat(np.arange(len(listed)), sizes[listed])
        order = np.argsort(every, kind="stable")
        return every[order], owner[order]

    waiting: list[int] = []
    while True:
        if not waiting:
            rest = np.flatnonzero(left)
            if len(rest) < 2:
                return links
            waiting, left[rest[0]] = [int(rest[0])], False
        here = waiting.pop()
        n_left = int(left.sum())
        if not n_left:
            return links
        if not len(listed) or n_left * 2 < len(listed):
            listed = np.flatnonzero(left)
            keys, owner = lists()
        lo, hi = np.searchsorted(keys, sets[here], "left"), np.searchsorted(keys, sets[here], "right")
        counts = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = np.bincount(owner[at], minlength=len(listed))
        union = sizes[listed] + sizes[here] - shared
        near = listed[(100 * shared >= percent * union) & left[listed]]
        left[near] = False
        links += [(here, int(x)) for x in near]
        waiting += [int(x) for x in near]


def _link(words: int, percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id")
        cache = _WordHashes()
        sets = [shingle_set(t, words, cache) for t in group["_text"]]
        ids = group["_id"].to_numpy()
        links = spanning_links(sets, percent)
        rows = [(int(ids[i]), int(ids[j]), None, None) for i, j in links]
        base = group["_base"].iloc[0]
        if not pd.isna(base):
            # Links come from the first document outwards.
            reached = {0}
            for i, j in links:
                if i in reached:
                    reached.add(j)
            wanted = group["_open"].to_numpy()
            rows += [(int(ids[i]), None, int(base), len(t)) for i, t in enumerate(group["_text"]) if wanted[i] and i not in reached]
        names = ["a", "b", "_base", "_chars"]
        return pd.DataFrame({n: pd.array([r[k] for r in rows], "Int64") for k, n in enumerate(names)})

    return link


def _against_all(alone: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Groups that compare ``alone``, what the first document of a cut region does
    not reach, with the whole region: each piece with each chunk of them."""
    chunks = alone.groupBy("_base").agg(F.least(F.ceil(F.sum("_chars") / most), F.count("*")).alias("chunks"))
    # The first document has met everything before.
    pieces = members.filter("_piece IS NOT NULL")
    with_chunks = pieces.join(chunks, "_base").select(
        "_id", "_base", "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("_chunk"))
    chunk = F.pmod(F.xxhash64("_id"), F.col("chunks")).alias("_chunk")
    dealt = alone.join(chunks, "_base").select("_id", "_base", chunk)
    met = dealt.join(with_chunks.select("_base", "_piece", "_chunk").distinct(), ["_base", "_chunk"]).select(*with_chunks.columns)
    # No base: what this pass does not link is linked to nothing there.
    none = F.lit(None).cast("bigint")
    return with_chunks.unionByName(met).distinct().select(
        "_id", F.xxhash64("_base", "_piece", "_chunk").alias("_region"), none.alias("_base"), none.alias("_piece"), F.lit(False).alias("_open"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node that links lead to.

    Every round each node takes the least label of its neighbours and then that
    label's own label. Rounds are stored, so a lost executor costs one round.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("component").alias("told"))
        nearer = labels.join(told.withColumnRenamed("b", "node"), "node", "left").select(
            "node", F.least("component", "told").alias("next"), F.col("component").alias("was"))
        nearer = materialize(nearer, "nearer")
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("further"))
        after = nearer.join(jump, "next", "left").select(
            "node", F.least("next", "further").alias("component"), (F.least("next", "further") < F.col("was")).alias("moved"))
        after = materialize(after, "labels")
        if after.filter("moved").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                    percent: int = 80, region_chars: int = REGION_CHARS) -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles``, ``component_id`` (least id
    linked directly or through others, itself included) and ``kept``.

    Two documents are linked if 100 * shared shingles >= ``percent`` * all their
    shingles; links are confirmed on full sets. Documents without words have no
    shingles and no links. Rows of one id belong together; a row without id takes
    no part, has a null component and is kept. Regions are found with a
    probability: a pair at 0.8 shares one in all but 0.03 % of cases, more alike
    pairs practically always. Every block that a crowded region goes deeper can
    lose a pair again, with fewer trees left: at 0.8 the bound is 0.03 % for
    regions of one block, 0.06 %, 0.13 % and 0.23 % for two, three and four.
    Regions crowded below four blocks are compared in full.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    profiles = materialize(
        rows.mapInPandas(partial(_profile, words), "_id bigint, n_shingles int, _set string, _sig array<int>, _chars bigint"), "profiles")
    usable = profiles.filter("_id IS NOT NULL AND n_shingles > 0")
    # One class per set of shingles, named by its least id.
    classes = materialize(usable.groupBy("_set").agg(
        F.min("_id").alias("_id"), F.first("_sig").alias("_sig"), F.max("_chars").alias("_chars"), F.count("*").alias("_n")), "classes")
    profiled = classes.select("_id", "_sig", "_chars")
    # The join of texts is the same at every size: both sides are dealt by id.
    usable_rows = rows.filter("_id IS NOT NULL")

    def linked(groups: DataFrame) -> DataFrame:
        wanted = usable_rows.join(groups.select("_id", "_region", "_base", "_open").hint("merge"), "_id")
        found = wanted.groupBy("_region").applyInPandas(_link(words, percent), "a bigint, b bigint, _base bigint, _chars bigint")
        return materialize(found, "pairs")

    # An id that stands for several texts brings all of them into its regions.
    members = regions(profiled, region_chars)
    pairs = linked(members)
    links = pairs.filter("b IS NOT NULL").select("a", "b")
    for level in range(1, LEVELS + 1):
        alone = materialize(pairs.filter("b IS NULL").groupBy("_base", F.col("a").alias("_id")).agg(F.max("_chars").alias("_chars")), "unreached")
        if alone.isEmpty():
            break
        # One task holds them: they are compared with the region, in proportion to it.
        few = F.sum("_chars") <= region_chars if level < LEVELS else F.lit(True)
        bases = materialize(alone.groupBy("_base").agg(few.alias("few")), "crowded")
        direct = alone.join(bases.filter("few"), "_base", "left_semi")
        links = links.unionByName(linked(materialize(_against_all(direct, members, region_chars), "again")).filter("b IS NOT NULL").select("a", "b"))
        crowded = bases.filter("NOT few")
        if crowded.isEmpty():
            break
        members = _deeper(alone.join(crowded, "_base", "left_semi"), members, profiled, region_chars)
        pairs = linked(members)
        links = links.unionByName(pairs.filter("b IS NOT NULL").select("a", "b"))
    named = small_or_stored(classes.filter("_n > 1").select("_set", F.col("_id").alias("a")))
    copies = usable.join(named, "_set").filter("_id <> a").select("a", F.col("_id").alias("b"))
    found = small_or_stored(components(links.unionByName(copies)))
    rows = profiles.select("_id", F.col("n_shingles").cast("bigint").alias("n_shingles"))
    joined = rows.join(found.withColumnRenamed("node", "_id"), "_id", "left")
    component = F.coalesce("component", "_id")
    return joined.select(F.col("_id").alias(doc_id), "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates. Repeated rows
    of one id stay one row each."""
    found = materialize(near_duplicates(docs, doc_id, text, words, percent), "kept")
    gone = small_or_stored(found.filter("NOT kept").select(F.col(doc_id).alias("_gone")).distinct())
    docs, named = set_apart(docs, ["_gone"], [doc_id, text])
    return named(docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti"))


def brute_force(rows: list[tuple[int, str | None]], words: int = 5, percent: int = 80) -> dict[int, int]:
    """Component of each id by comparing all pairs; for tests."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
