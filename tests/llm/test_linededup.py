"""Line dedup against a plain reading of the rule."""

import hashlib

import numpy as np
from plan_text import plan_of
from pyspark.sql import functions as F

from parcela.llm import linededup

DOCS = "doc_id bigint, text string, lang string"
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute_force(rows):
    """(id, text) -> (lines, dropped, kept text); rows without id come last."""
    place = lambda i: (i is None, i or 0)
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key_of(line)
            if len(k) >= 10:
                owner[k] = min(owner.get(k, place(i)), place(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key_of(x), place(i)) == place(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of_cases():
    rng = np.random.default_rng(3)
    pool = [f"a line number {i} of many" for i in range(30)] + ["short", "", "ÄÖÜ straße İstanbul", "\x0bA tab\x0c", "exactly 10"]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(0, 9)).tolist())) for i in range(60)]
    rows += [(5, "a line number 3 of many\nOwn line of five"), (61, None), (62, ""), (63, "\n\n"), (64, "  A LINE number 3 of many\r\nnew and long enough"),
             (65, "äöü STRASSE not this one"), (66, "ÄÖÜ STRAßE İstanbul"), (67, "repeated inside\nrepeated inside"), (68, "repeated inside\nx"),
             (None, "a line number 3 of many\nonly without an id"), (None, "only without an id\nExactly 10")]
    rows += [(70, "\n".join(f"line {i % 5000} of a long text" for i in range(20_000))), (71, "line 77 of a long text")]
    return rows + rows[:3]


def test_equals_brute_force_with_and_without_slabs(spark):
    rows = rows_of_cases()
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    want = brute_force(rows)
    for slab_rows in (linededup.SLAB_ROWS, 7, 1):
        done = linededup.dedup_lines(docs, slab_rows=slab_rows)
        got = done.select("doc_id", "n_lines", "n_dropped", F.sha2(linededup.kept_text(F.col("text"), F.col("keep_bitmap")), 256)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert sorted((tuple(r) for r in linededup.digests(docs).collect()), key=repr) == want


def test_bitmaps_are_runs_of_kept_lines(spark):
    docs = spark.createDataFrame([(1, "the same line here\nx", "en"), (2, "a\nthe same line here\nb\nc\nThe Same Line Here", "en")], DOCS)
    got = {r.doc_id: [tuple(x) for x in r.keep_bitmap] for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: [(0, 2)], 2: [(0, 1), (2, 2)]}


def test_clashing_names_and_empty_table(spark):
    extra = ["_id", "_th", "_at", "_h1", "_h2", "_row", "_i", "_t", "_n", "_first", "_slab", "_bucket", "_key", "_line", "dropped", "n_lines", "n_dropped", "keep_bitmap"]
    docs = spark.createDataFrame([(1, "one long line here", "en"), (2, "one long line here", "en")], DOCS)
    wide = docs.select("*", *[F.lit("clash").alias(c) for c in extra])
    done = linededup.dedup_lines(wide)
    assert done.columns == [c for c in wide.columns if c not in extra[-3:]] + extra[-3:]
    assert {(r.doc_id, r.n_dropped, r._row) for r in done.collect()} == {(1, 0, "clash"), (2, 1, "clash")}
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_hash_rows_are_shuffled_and_sorted_once(spark):
    hashes = linededup.line_hashes(spark.createDataFrame([(1, "one long line here", "en")], DOCS))
    plan = plan_of(linededup._first_document(hashes, ["_h1", "_h2"]))
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and plan.count("Sort ") == 1 and "Python" not in plan
