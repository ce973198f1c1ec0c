"""Hard negatives against all products."""

from __future__ import annotations

import numpy as np
import pytest

from petroloom.llm import hardneg, queries, shared
from tests.compare import differ


def plain(rows, every=50, positives=5, negatives=3):
    """rows: (vec_id, label, v) that take part."""
    anchors = {}
    for i, label, v in sorted(rows):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(q, v)))), i, other) for i, other, v in rows if i != a and len(v) == len(q) and len(v)]
        for p, pid in sorted((-s, i) for s, i, other in scored if other == label)[:positives]:
            inside = sorted((-s, i) for s, i, other in scored if other != label and 50 * -p <= 100 * s <= 95 * -p)
            out += [(a, pid, k + 1, n, -p, -s) for k, (s, n) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(int(i), int(c), [float(x) for x in v], 1, "n") for i, c, v in rows], "vec_id long, label long, v array<double>, shard int, place string")
    got = hardneg.mine(df, **how).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


@pytest.mark.parametrize("block", [64, 32_768])
def test_against_all_products(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, tuple(rng.integers(-4, 9, 6))) for i in range(700)]
    rows += [(1000 + i, 1, (3, 3, 3, 3, 3, 3)) for i in range(300)]  # a common vector
    rows += [(2000, 0, (5, 5, 5, 5, 5, 5))] * 3 + [(2050, 1, (1, 2)), (2051, 1, (1, 2)), (2052, 0, (1, 1)), (2100, 2, (0,) * 6), (-50, 2, (1, 2, 3, 4, 5, 6)), (2150, 0, ())]
    assert mined(spark, rows, block=block) == plain(rows)


def test_no_positive_and_no_negative(spark):
    rows = [(0, 1, (1, 1)), (1, 2, (1, 1)), (50, 3, (2, 2)), (51, 3, (2, 2)), (100, 4, (-1, 0)), (101, 4, (1, 0)), (102, 5, (1, 0))]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, (1, 1))]) == []


def test_numbers_beyond_doubles(spark):
    rows = [(i, i % 2, (float(10**12 + 7 * i), float(10**9 * i - 3), 1.0)) for i in range(0, 120, 5)]
    assert mined(spark, rows) == plain(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 900, (20, 8))
    v = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 9, (4000, 8)))
    tree = hardneg.BallTree(np.arange(4000), rng.integers(0, 4, 4000), v, leaf=64)
    q = np.floor(centres[:5])
    length = np.sqrt((q**2).sum(axis=1))
    below = {}
    for node in sorted(tree.centre, reverse=True):
        below[node] = tree.rows[node] if node in tree.rows else np.concatenate([below[2 * node + 1], below[2 * node + 2]])
        low, high = tree.bounds(node, q, length)
        s = q @ v[below[node]].T
        assert (s.min(axis=1) >= low).all() and (s.max(axis=1) <= high).all()
    assert len(below[0]) == 4000
    seen, bounds = [], tree.bounds
    tree.bounds = lambda node, q, n: seen.extend([node] * len(q)) or bounds(node, q, n)
    scores, _ = hardneg.search(tree, np.arange(5) + 10**6, np.zeros(5, np.int64), q, None, 3)
    assert len(seen) < len(q) * len(tree.centre) / 2  # most balls are never opened
    want = -np.sort(-np.where(tree.labels == 0, q @ v.T, -np.inf), axis=1)[:, :3]
    assert (scores[:, 0] == want).all()


def test_rows_that_take_no_part(spark):
    rows = [(50, [1.0, 0.5], 3), (7, [1.0, 1.0], 9), (None, [1.0, 1.0], 3), (3, None, 3), (4, [None, 1.0], 3), (5, [float("nan"), 1.0], 3), (6, [float("inf"), 1.0], 3), (8, [0.001, -0.001], None), (49, [-0.001, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["label"], r["v"]) for r in hardneg.labelled_vectors(df).collect()}
    assert got == {50: (3, [256.0, 128.0]), 7: (0, [256.0, 256.0]), 49: (1, [-1.0, 512.0])}


def test_query(spark, sf):
    assert differ(spark, queries.queries()["op13_hard_negatives"], queries.oracle_sql()["op13_hard_negatives"], sf) == ""
    rows = [(r["vec_id"], r["label"], tuple(r["v"])) for r in hardneg.labelled_vectors(shared.table(spark, sf, "embeddings")).collect()]
    got = hardneg.op13_hard_negatives(spark, sf).collect()
    assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == plain(rows)
