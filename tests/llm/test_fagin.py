"""Hard negatives against all scores, and that reading stops early."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.llm import fagin

ROWS = "vec_id bigint, embedding array<double>, label int"


def whole(v, scale=256):
    return [math.floor(scale * x) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_force(rows, every=10, positives=5, negatives=5, percent=80):
    """Rows repeated as a whole count once; of an anchor id the least row asks."""
    good = sorted({(i, label, tuple(whole(v))) for i, v, label in rows if i is not None and label is not None and usable(v)})
    asking = {}
    for i, label, v in good:
        if i % every == 0:
            asking.setdefault(i, (label, v))
    out = set()
    for a, (label, q) in asking.items():
        near = sorted((-dot(q, v), i) for i, lab, v in good if lab == label and i != a)[:positives]
        for s, p in near:
            inside = sorted((-dot(q, v), i) for i, lab, v in good if lab != label and i != a and percent * -s <= 100 * dot(q, v) <= -100 * s)
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(inside[:negatives])}
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS)
    wide = df.select("*", *[F.lit("clash").alias(c) for c in ("values", "anchors", "score", "rank", "_pass", "rows", "ids", "positives")])
    got = [tuple(r) for r in fagin.mine(wide, wide.filter("vec_id % 10 = 0"), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    centre = rng.normal(0, 0.4, (4, 6))
    rows = [(i, (centre[i % 4] + rng.normal(0, 0.15, 6)).round(1).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    rows += [(400 + i, rows[7][1], i % 2) for i in range(60)]  # one vector many times: ties
    rows += [(300, None, 1), (301, [None] * 6, 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1),
             (304, [0.5] * 6, None), (310, [0.0] * 6, 1), (311, [0.7, 0.7], 2), (320, [], 0)]
    return rows


def test_equals_brute_force(spark, rows):
    want = brute_force(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, block_rows=100, pass_anchors=20) == want


def test_repeated_rows_and_ids(spark, rows):
    more = rows + rows[:40] + [(20, [0.9] * 6, 2), (21, [0.9] * 6, 0)]
    assert mined(spark, more, block_rows=50) == brute_force(more)


def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    assert fagin.mine(df.limit(0), df.limit(0)).count() == 0
    assert fagin.mine(df, df.limit(0)).count() == 0
    assert fagin.mine(df.filter("vec_id = 300"), df.filter("vec_id = 300")).count() == 0


def test_large_components(spark):
    big = [(i, [300_000.0 + i, 1.0], i % 2) for i in range(40)]
    assert mined(spark, big) == brute_force(big)
    with pytest.raises(Exception, match="leave 64 bits"):
        mined(spark, [(i, [1e12, 1.0], i % 2) for i in range(20)])


def block_of(values, labels):
    lists = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32))
    return fagin.Block(np.arange(len(values), dtype=np.int64), labels, values, lists, int(np.abs(values).max()))


def test_reading_stops_before_the_end_and_finds_all():
    rng = np.random.default_rng(2)
    # Few heavy dimensions: the threshold falls quickly.
    values = np.floor(256 * rng.normal(0, 1, (5000, 12)) * 0.5 ** np.arange(12)).astype(np.int64)
    labels = rng.integers(0, 3, 5000)
    block = block_of(values, labels)
    share = []
    for a in range(0, 5000, 500):
        scores = values @ values[a]
        others = [i for i in range(5000) if i != a and labels[i] == labels[a]]
        best, scored = fagin.nearest_of_label(block, values[a], a, int(labels[a]), 5)
        assert best.ids.tolist() == sorted(others, key=lambda i: (-scores[i], i))[:5]
        tops = best.scores.tolist()
        found, more = fagin.best_in_windows(block, values[a], a, int(labels[a]), tops, 5, 80)
        for top, one in zip(tops, found):
            inside = [i for i in range(5000) if labels[i] != labels[a] and 80 * top <= 100 * scores[i] <= 100 * top]
            assert one.ids.tolist() == sorted(inside, key=lambda i: (-scores[i], i))[:5]
        share += [scored / 5000, more / 5000]
    assert np.mean(share) < 0.7


def test_threshold_bounds_what_is_to_come():
    rng = np.random.default_rng(4)
    values = rng.integers(-9, 10, (400, 5))
    block = block_of(values, np.zeros(400, np.int64))
    for a in (np.array([3, -2, 0, 1, -5]), np.zeros(5, np.int64), np.array([0, 0, -1, 0, 0])):
        seen = set()
        for rows, scores, threshold in block.read(a):
            assert not seen & set(rows.tolist()) and (scores == values[rows] @ a).all()
            seen |= set(rows.tolist())
            rest = [int(values[i] @ a) for i in range(400) if i not in seen]
            assert (threshold is None and not rest) or max(rest) <= threshold
        assert len(seen) == 400
