"""Op 12: product codes against a plain loop."""

import hashlib
import math
import random

import pytest

from linecast.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, ids string"


def brute(rows):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    width += -width % 4
    width = width or 4
    size = width // 4
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    parts = [[v[p * size : (p + 1) * size] for p in range(4)] for v in ints]
    books = [[v[p] for v in parts[:256]] for p in range(4)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        new = []
        for p in range(4):
            mine = {}
            for v in parts:
                mine.setdefault(nearest(p, v[p])[1], []).append(v[p])
            new.append([[sum(c) // len(c) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for (i, _, label), v in zip(kept, parts, strict=True):
        best = [nearest(p, v[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    text = ",".join(str(c) for b in books for e in b for c in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def vectors(n, seed, width=8):
    rnd = random.Random(seed)
    centre = [[rnd.uniform(-0.3, 0.3) for _ in range(width)] for _ in range(12)]
    return [(i, [rnd.gauss(c, 0.02) for c in rnd.choice(centre)], rnd.choice([0, 1, None])) for i in range(n)]


def as_floats(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def check(spark, rows, partitions=3):
    rows = as_floats(rows)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(partitions)
    got, books = codebooks.compress(df)
    expected, sha = brute(rows)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got.collect()), key=key) == sorted(expected, key=key)
    assert codebooks.digest(books) == sha


def test_equals_a_plain_loop(spark, monkeypatch):
    rows = vectors(420, 3)
    random.Random(1).shuffle(rows)
    check(spark, rows)
    monkeypatch.setattr(codebooks, "BLOCK_ROWS", 50)
    monkeypatch.setattr(codebooks, "SLICE", 7)
    check(spark, rows, 1)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = vectors(30, 5, width=6)
    rows += [(100, None, 1), (101, [0.1, None, 0.2], 1), (102, [float("nan")] * 6, 0), (103, [float("inf")] * 6, 0)]
    rows += [(104, [], 0), (105, [0.25, -0.25], None), (None, [0.5] * 6, 1), (None, [0.25] * 6, 1), rows[0], rows[0], (3, [0.1] * 6, 0)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(5, [0.5] * 4, None)]])
def test_hardly_any_rows(spark, rows):
    check(spark, rows)


def test_wide_integers_stay_exact(spark):
    check(spark, [(i, [(-1.0) ** i * 60000.0 + i, 0.5, -1e-9, 3.0 * i], i % 3) for i in range(20)])


def test_label_error_sums_nulls_together(spark, tmp_path):
    rows = as_floats(vectors(40, 9))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = codebooks.op12_vector_codes(spark, str(tmp_path)).collect()
    expected, sha = brute(rows)
    total = {}
    for _, _, error, label in expected:
        total[label] = total.get(label, 0) + error
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted((i, c, e, total[la], sha) for i, c, e, la in expected)
