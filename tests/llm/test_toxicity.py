"""Op 8: the classifier learns what its labels mark, and only that."""

import math
import random
import zlib

import numpy as np
import pytest

from linecast.llm import toxicity

BAD = ["grobian", "fiend", "oaf"]


def rows(n=900, seed=1):
    rnd = random.Random(seed)
    word = [f"w{k}" for k in range(400)]
    out, marks = [], []
    for i in range(n):
        t = [rnd.choice(word) for _ in range(rnd.randint(1, 80))]
        y = int(rnd.random() < 0.2)
        if y:
            for _ in range(3):
                t.insert(rnd.randrange(len(t) + 1), rnd.choice(BAD) + rnd.choice(["", ",", "!"]))
        out.append((i, " ".join(t), "de", "s"))
        marks.append((i, y))
    return out, marks


def test_held_out_accuracy_and_no_leak(spark):
    docs, marks = rows()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, label string")
    # labels of held-out rows are turned round: learning from them would show
    out = {i for i, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2}
    b = spark.createDataFrame([(i, 1 - y if i in out else y) for i, y in marks], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.train(d, b)).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, y in marks if i in out]
    assert len(out) > 150 and sum(right) / len(right) > 0.97
    assert all(0 <= s <= 1 for s in got.values())


def test_edges(spark):
    docs, marks = rows(200)
    extra = [(None, "no id", "x", "y"), (900, None, "x", "y"), (901, "", "x", "y"), (902, "oaf " * 30_000, "x", "y"), (0, docs[0][1], "x", "y")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string, `order` string")
    b = spark.createDataFrame([*marks, (None, 1), (3, None), (5, 0), (5, 1), (77777, 1)], "doc_id long, toxic int")
    w = toxicity.train(d, b)
    got = toxicity.score(d, w, keep=("doc_id", "text")).collect()
    assert len(got) == len(docs) + 5
    by = {(r.doc_id, r.text): r.score for r in got}
    assert by[900, None] == by[901, ""]
    kept = toxicity.drop_toxic(d, b)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, t in by if by[i, t] < 0.3} == ids
    assert by[902, "oaf " * 30_000] > by[901, ""]
    none = toxicity.train(d, b.limit(0))
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.5}
    assert toxicity.score(d.limit(0), w).collect() == []


def test_weights_are_sparse_and_bounded(spark):
    docs, marks = rows(400)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    w = toxicity.train(d, spark.createDataFrame(marks, "doc_id long, toxic int"), bits=16)
    assert 1 < len(w) < 2000 and max(i for i, _ in w) < 1 << 16


@pytest.mark.parametrize("limit", [50, 10_000])
def test_the_sample_is_bounded(spark, limit):
    docs, marks = rows(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert toxicity.train(d, spark.createDataFrame(marks, "doc_id long, toxic int"), max_rows=limit)


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, min_rows):
    """FTRL-proximal, one coordinate at a time."""
    seen, z, n = {}, {}, {}
    for x, _ in rows:
        for i in x:
            seen[i] = seen.get(i, 0) + 1

    def weight(i, l1):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + (l2 if i != "bias" else 0.0))

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i, l1) for i in x if seen[i] >= min_rows} | {"bias": weight("bias", 0.0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * wi
                n[i] = old + g * g
    return {i: weight(i, l1) for i in seen if seen[i] >= min_rows and weight(i, l1)}, weight("bias", 0.0)


def test_ftrl_equals_a_plain_loop():
    rnd = random.Random(3)
    rows = []
    for _ in range(200):
        y = rnd.randint(0, 1)
        rows.append((sorted({rnd.randrange(40) + 30 * y * rnd.randint(0, 1) for _ in range(rnd.randint(0, 12))}), y))
    for options in (dict(epochs=3, alpha=0.5, beta=1.0, l1=0.4, l2=1.0, min_rows=2), dict(epochs=5, alpha=1.0, beta=0.5, l1=3.0, l2=0.0, min_rows=1)):
        at, w, bias = toxicity.ftrl([(np.array(x, np.int64), y) for x, y in rows], bits=8, **options)
        expected, expected_bias = plain_ftrl(rows, **options)
        assert expected and dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(expected)
        assert bias == pytest.approx(expected_bias)
