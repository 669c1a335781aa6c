"""Op 11: fingerprints, edited texts and near documents against plain loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from linecast.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string, node string, bucket int, near_id string"


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def hex_of(text):
    return fp.fingerprint_rows([text or ""])[0][0].astype(">u2").tobytes().hex()


def likeness(a, b):
    if (not shingle_set(a)) != (not shingle_set(b)):
        return 0.0
    x, y = hex_of(a), hex_of(b)
    return sum(x[i : i + 4] == y[i : i + 4] for i in range(0, len(x), 4)) / fp.FUNCTIONS


def neighbours(rows):
    """The next document of each id: the least text of the next smaller id (null last, then the first)."""
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, -(i or 0)))
    least = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    return {i: least[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}


def near(rows):
    """class_id, near_id and n_near of each row, from all pairs of different sets."""
    named = [(i, shingle_set(t)) for i, t in rows]
    classes = {}
    for i, s in named:
        if s:
            old = classes.setdefault(s, i)
            classes[s] = i if old is None else old if i is None else min(old, i)
    links = {s: [classes[o] for o in classes if o != s and jaccard(s, o) >= 0.8] for s in classes}
    first = lambda ids: min(ids, key=lambda i: (i is None, i or 0), default=None)
    return [(classes.get(s, i), first(links.get(s, [])), len(links.get(s, []))) for i, s in named]


def corpus(n=160, seed=3):
    rnd = random.Random(seed)
    word = [f"w{k}" for k in range(400)] + ["Straße", "niño", "日本"]
    base = [[rnd.choice(word) for _ in range(rnd.choice([1, 4, 6, 50, 130]))] for _ in range(40)]
    out = []
    for _ in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 4])):
            t[rnd.randrange(len(t))] = rnd.choice(word)
        out.append((rnd.randrange(10**6), " ".join(t)))
    return out


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, t, "a", "b", 7, "c") for i, t in rows], SCHEMA).repartition(partitions)
    got = fp.fingerprints(df).collect()
    follows = neighbours(rows) if rows else {}
    expected = []
    for (i, t), (class_id, near_id, n_near) in zip(rows, near(rows), strict=True):
        t, n = t or "", follows[i]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((i, len(t), sha, hex_of(t), hex_of(edited), likeness(t, edited), likeness(t, n), class_id, near_id, n_near))
    key = lambda r: [(x is None, x if x is not None else 0) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_equals_plain_loops_in_any_segments(spark, monkeypatch):
    rows = corpus()
    check(spark, rows)
    monkeypatch.setattr(fp, "SEGMENT_BYTES", 900)
    monkeypatch.setattr(fp, "HASH_BYTES", 300)
    check(spark, rows, 5)


def test_nulls_ties_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(fp, "SEGMENT_BYTES", 2000)
    rows = corpus(40, 8)
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (8, "one TWO"), (None, "a b c d e f"), (None, ""), (None, "z y x w v u t")]
    rows += [rows[0]] * 3 + [(11, f"copy {k % 3} of one id with several texts") for k in range(60)]
    rows += [(12, "long text of many words " * 3000), (-4, "x"), (2**62, "largest id of all the ids")]
    check(spark, rows, 4)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b")], [(3, "only one document stands here")], [(3, "twice"), (3, "twice")]])
def test_hardly_any_rows(spark, rows):
    check(spark, rows)


def test_likeness_is_close_to_jaccard():
    rnd = random.Random(2)
    error = []
    for _ in range(60):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        cut = rnd.randrange(300)
        b = a[:cut] + [f"w{rnd.randrange(10**6)}" for _ in range(300 - cut)]
        a, b = " ".join(a), " ".join(b)
        error.append(likeness(a, b) - jaccard(shingle_set(a), shingle_set(b)))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_every_close_pair_shares_a_band():
    rnd = random.Random(4)
    texts = []
    for _ in range(150):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        b = list(a)
        for at in rnd.sample(range(0, 200, 20), 4):
            b[at] = "changed"
        texts += [" ".join(a), " ".join(b)]
    h, first = fp._sets(pa.array(texts))
    sig = fp.minhash(h, first, fp.BANDS * fp.BAND_ROWS).reshape(-1, fp.BANDS, fp.BAND_ROWS)
    for k in range(0, len(texts), 2):
        assert jaccard(shingle_set(texts[k]), shingle_set(texts[k + 1])) >= 0.8
        assert (sig[k] == sig[k + 1]).all(axis=1).any()


def test_tasks_without_a_segment_end(spark, monkeypatch):
    monkeypatch.setattr(fp, "SEGMENT_BYTES", 1 << 20)
    check(spark, [(k, f"document number {k} of many with a text of its own") for k in range(60)], 12)


def chain(n=12, step=9, size=100):
    """Texts that change step by step: each is linked with the next ones, none with those far off."""
    words = [f"w{k}" for k in range(size + n * step)]
    return [(n - k, " ".join(words[k * step : k * step + size])) for k in range(n)]


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_links_between_any_two_sets_of_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK_ITEMS", block)
    rows = chain() + [(100 + k, t) for k, (_, t) in enumerate(chain(4))] + [(None, "a b c d e f g h i j k l m n o"), (90, "a b c d e f g h i j k l m n o p")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["id"], r["class_id"], r["near_id"], r["n_near"]) for r in fp.near_documents(df).collect()}
    assert got == {(i, c, x, n) for (i, _), (c, x, n) in zip(rows, near(rows), strict=True)}
    assert sum(n for *_, n in got) > 2 * len(chain())
