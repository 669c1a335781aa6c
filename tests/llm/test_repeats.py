"""Op 4: suffix arrays and removal of repeated byte strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from linecast.llm import substrings
from linecast.llm.suffixes import suffix_arrays

SCHEMA = "doc_id long, text string, id string, ranges string"


def brute(rows, span=50):
    first = {}
    for i, t in rows:
        for p in range(len(t) - span + 1):
            s = t[p : p + span]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        gone = set()
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                gone.update(range(p, p + span))
        left = bytes(c for k, c in enumerate(t) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(t), len(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], SCHEMA)
    got = substrings.remove_repeats(df, **options).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    word = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    passage = [" ".join(rnd.choice(word) for _ in range(25)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [" ".join(rnd.choice(word) for _ in range(rnd.randint(0, 60)))]
        parts += [rnd.choice(passage) for _ in range(rnd.randint(0, 2))]
        if out and rnd.random() < 0.3:
            old = rnd.choice(out)[1].split(" ")
            old[rnd.randrange(len(old))] = "changed"
            parts.append(" ".join(old))
        rnd.shuffle(parts)
        out.append((i, "\n".join(parts)))
    rnd.shuffle(out)
    return out


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(0)
    for _ in range(40):
        texts = [bytes(rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 50), dtype=np.uint8)) for _ in range(rng.integers(1, 15))]
        parts = [np.append(np.frombuffer(t, np.uint8).astype(np.int64), 0) for t in texts]
        off = np.cumsum([0, *map(len, parts)])
        sa = suffix_arrays(np.concatenate(parts), off)
        for k, t in enumerate(texts):
            assert (sa[off[k] : off[k + 1]] - off[k]).tolist() == sorted(range(len(t) + 1), key=lambda i: t[i:])


@pytest.mark.parametrize("long_group", [4096, 100])
def test_equals_brute_force(spark, monkeypatch, long_group):
    monkeypatch.setattr(substrings, "LONG_GROUP", long_group)
    texts = corpus()
    assert run(spark, texts) == sorted(brute([(i, t.encode()) for i, t in texts]))


def test_periodic_and_very_long_texts(spark):
    texts = [(1, "ab" * 400), (2, "b" + "ab" * 60), (3, "x" * 30_000), (4, "x" * 49), (5, "y" + "x" * 50 + "y")]
    assert run(spark, texts) == sorted(brute([(i, t.encode()) for i, t in texts]))


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(40))
    got = run(spark, [(1, None), (2, ""), (3, long), (3, long), (3, long + " more"), (4, long)])
    n = len(long)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[:2] == [(1, 0, 0, 0, empty), (2, 0, 0, 0, empty)]
    assert [r[1:4] for r in got[2:5]] == [(n, 0, 0), (n, 0, 0), (n + 5, 0, 0)]  # equal ids do not remove each other
    assert got[5] == (4, n, n, 1, empty)
    df = spark.createDataFrame([Row(doc_id=7, text=long), Row(doc_id=None, text=long), Row(doc_id=None, text=long)])
    out = {(r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect()}
    assert out == {(7, 0), (None, n)}  # a null id is the greatest
    assert substrings.remove_repeats(df.limit(0)).collect() == []


def test_rows_of_one_id_with_equal_32_bit_hashes(spark):
    from pyspark.sql import functions as F

    passage = "a passage of more than fifty bytes that an earlier document has as well"
    n = spark.range(150_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    repeated = n.select(F.concat(F.lit(passage), "s").alias("t")).withColumn("h", F.hash("t"))
    clean = n.select(F.concat("s", F.reverse("s")).alias("c")).withColumn("h", F.hash("c"))
    pair = repeated.join(clean, "h").first()
    assert pair is not None
    rows = [(1, passage), (None, pair.t), (None, pair.c)]
    for order in (rows, [rows[0], rows[2], rows[1]]):
        got = substrings.remove_repeats(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.n_bytes, r.n_removed) for r in got) == [(71, 0), (128, 0), (135, 71)]
