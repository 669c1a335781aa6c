"""Op 13: hard negatives against all pairs, and the matrix product."""

import math
import random

import numpy as np
import pytest

from linecast.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, anchor string, rank string"


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (0, 4, 3), (17, 33, 19), (64, 64, 64), (40, 5, 70), (35, 100, 51)])
def test_strassen_equals_direct_product(m, k, n):
    rnd = np.random.default_rng(m + k + n)
    a, b = rnd.integers(-(2**20), 2**20, (m, k)), rnd.integers(-(2**20), 2**20, (k, n))
    assert (negatives.strassen(a, b) == a @ b).all()


def brute(rows, every=50):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({r[0] for r in kept if r[0] % every == 0}):
        _, label, v = min((r for r in kept if r[0] == a), key=lambda r: r[1:])
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, other, w in kept if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            inside = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(inside[:3])]
    return sorted(out)


def vectors(n, seed, width=8):
    import numpy as np

    rnd = random.Random(seed)
    centre = [[rnd.uniform(-0.3, 0.6) for _ in range(width)] for _ in range(6)]
    return [(i, [float(np.float32(rnd.gauss(c, 0.1))) for c in rnd.choice(centre)], rnd.choice([0, 1, 2, None])) for i in range(n)]


def check(spark, rows, every=50, partitions=3):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(partitions)
    got = negatives.hard_negatives(df, every=every)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, every)


def test_equals_all_pairs_in_any_blocks(spark, monkeypatch):
    rows = vectors(400, 4)
    check(spark, rows, 7)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(negatives, "TILE", 5)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 20 * 64)
    check(spark, rows, 25, 2)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = vectors(60, 6)
    rows += [(100, None, 1), (150, [0.1, None], 1), (200, [float("nan")] * 8, 0), (201, [0.5] * 8, None), (None, [0.5] * 8, 1)]
    rows += [(250, [0.5] * 3, 1), (251, [], 1), (50, [0.25] * 8, 0), (-50, [0.5] * 8, 2), rows[3], rows[3], rows[0]]
    rows += [(300 + k, [0.5] * 8, k % 2) for k in range(12)]
    check(spark, rows, 10)


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 0)], [(50, [0.5], 0)], [(50, None, 0)], [(50, [], 0), (51, [], 0), (52, [], 1)]])
def test_hardly_any_rows(spark, rows):
    check(spark, rows)
