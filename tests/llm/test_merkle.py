"""Merkle manifest against a plain tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from parcela.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Word " * 30_000


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def low(t):
    return t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def leaf_of(i, text, lang, source, n):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def walk(tree, at, acc):
    """Siblings and the folded digest of leaf ``at``."""
    sibs = ""
    for level in tree[:-1]:
        first = at // 8 * 8
        left, right = "".join(level[first:at]), "".join(level[at + 1:first + 8])
        sibs, acc, at = sibs + left + right, h(left + acc + right), at // 8
    return sibs, acc


def brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    over = levels([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            shown = leaf_of(r[0], low(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf
            sibs, acc = walk(trees[g], at, shown)
            more, acc = walk(over, n, acc)
            out.append((r[0], leaf, trees[g][-1][0], over[-1][0], h(sibs + more), acc, acc == over[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    wide = docs.select("*", *[F.lit("clash").alias(c) for c in ("leaf", "path", "key", "digest", "_g", "_rank", "node", "shown", "root", "verified")])
    got = merkle.verified(wide, merkle.third_of_ids())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


def test_groups_of_all_heights(spark):
    sizes = {None: 9, "a": 1, "b": 8, "é": 65, "z": 513, "Z": 64, "": 3}
    rows = [(7 * i + len(g or "") * 3, f"Text {i} of {g}", g, None if i % 3 else "s", i) for g, n in sizes.items() for i in range(n)]
    check(spark, rows)


def test_nulls_ties_repeated_and_long_rows(spark):
    rows = [(1, LONG, "en", "s", 5), (1, "Other", "en", "s", 5), (2, None, "en", None, None), (None, "No Id", "en", "s", 0), (None, None, None, None, None),
            (3, "", "en", "", -1), (3, "", "en", "", -1), (0, "ÄB", "de", "s", 2), (15, "MANY", "en", "s", 4)]
    check(spark, rows)
    check(spark, rows[:1])


def test_several_groups_above_one_level(spark):
    check(spark, [(i, f"T{i}", f"g{i % 70}", "s", i) for i in range(140)])


def test_third_tier(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    check(spark, [(i, f"T{i}", "en", "s", i) for i in range(530)])


def test_empty_table_and_no_alteration(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert merkle.verified(docs.limit(0)).count() == 0
    assert merkle.verified(docs).filter("NOT verified").count() == 0


def test_a_changed_row_fails_and_others_do_not(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = merkle.verified(docs, F.col("doc_id") == 3).filter("NOT verified").collect()
    assert [r.doc_id for r in got] == [3]


@pytest.mark.parametrize("value", ["", "plain", "ÄÖÜ straße İ", "MIXED Case é"])
def test_only_ascii_letters_are_lowered(spark, value):
    assert spark.createDataFrame([(value,)], "t string").select(merkle.lowered(F.col("t"))).first()[0] == low(value)
