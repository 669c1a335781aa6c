"""Op 7: near-duplicate groups against brute force."""

import random

import numpy as np
import pytest

from linecast.llm import neardup

SCHEMA = "doc_id long, text string, node string, root string"


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, pct):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(sets[a]), least[find(a)], i == least[find(a)]) for a, (i, _) in enumerate(rows))


def corpus(seed=5):
    rnd = random.Random(seed)
    word = [f"w{k}" for k in range(500)]
    base = [[rnd.choice(word) for _ in range(rnd.choice([1, 3, 5, 7, 40, 120]))] for _ in range(30)]
    out = []
    for i in range(150):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            t[rnd.randrange(len(t))] = rnd.choice(word)
        out.append((i, " ".join(t) if rnd.random() < 0.5 else " \t".join(t).upper()))
    rnd.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("pct", [80, 85])
def test_equals_brute_force(spark, pct):
    rows = corpus()
    got = neardup.near_duplicates(frame(spark, rows), threshold_pct=pct).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, pct)


@pytest.mark.parametrize("block", [1_000_000, 7_000])
def test_many_near_copies_of_one_text(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ITEMS", block)
    rnd = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(2):
            t[rnd.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(t)))
    got = neardup.near_duplicates(frame(spark, rows), threshold_pct=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 85)


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FOREST_LINKS", 7)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 105), (200, 300)]
    edges = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(r.v, "big"): int.from_bytes(r.root, "big") for r in neardup.components(edges).collect()}
    for v, root in {40: 0, 17: 0, 105: 100, 300: 200}.items():
        assert got[v] == root


def test_signature_estimates_the_overlap():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (400, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    sig = neardup.superminhash(np.concatenate(sets), np.array([0, 500, 1000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.08
    small = neardup.superminhash(np.array([5], np.uint64), np.array([0, 0, 1]), 16)
    assert np.isinf(small[0]).all() and sorted(np.floor(small[1])) == list(range(16))  # one element, all ranks once


def test_edges(spark):
    text = "one two three four five six"
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (5, text.upper()), (6, "one two"), (7, "ONE  two"), (None, "lost id one two three four"), (None, "lost id one two three four")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    view = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got)
    assert view == [(0, 2, None, True), (0, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 1, 6, True), (7, 1, 6, False)]
    kept = neardup.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.node) for r in kept) == [(0, "lost id one two three four", "x"), (1, "", "x"), (2, "", "x"), (3, " \n", "x"), (4, text, "x"), (6, "one two", "x")]
    assert neardup.near_duplicates(frame(spark, rows).limit(0)).collect() == []
    assert neardup.drop_near_duplicates(frame(spark, rows).limit(0)).collect() == []
