"""Op 6: counts, base score and class model against a plain computation."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linecast.llm import classlm


def corpus(seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(80):
        lang = i % 2
        names, verbs = [f"n{lang}{k}" for k in range(12)], [f"v{lang}{k}" for k in range(9)]
        out.append((i, " ".join(rnd.choice(names if k % 2 else verbs) for k in range(rnd.randint(1, 60)))))
    return out


def test_scores_equal_the_formulas(spark):
    rows = [*corpus(), (500, "Unseen  WORDS v01"), (501, None), (502, "")]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    train = d.where("doc_id < 60")
    model = classlm.fit(train, classes=4, top=20, endings=8)
    got = {r.doc_id: r for r in classlm.score(d, model).collect()}
    tok = {i: (t or "").lower().encode().split() for i, t in rows}
    c = Counter(w for i in range(60) for w in [*tok[i], 0])
    n, v = sum(c.values()), len(c)
    assert model.tokens == n and model.vocabulary == v
    for i, w in tok.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, 0])
        assert got[i].n_tokens == len(w) + 1 and got[i].n_known == sum(c[x] > 0 for x in [*w, 0])
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
    held = [i for i in range(60, 80)]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)  # classes see the order
    assert classlm.score(d.limit(0), model).collect() == []


def test_class_probabilities_sum_to_one(spark):
    train = spark.createDataFrame(corpus(), "doc_id long, text string")
    model = classlm.fit(train, classes=4, top=20, endings=8)
    assert np.allclose((10**model.step).sum(axis=1), 1)
    # of a class: all its words, and one place for unknown ones
    units = {}
    for i, t in corpus():
        for w in t.split():
            one = spark_unit(model, w)
            units.setdefault(int(model.cls[one]), Counter())[w] += 1
    for k, words in units.items():
        total = sum(n + 1 for n in words.values()) + 1
        assert math.log10(total) == pytest.approx(float(model.spread[k]))


def spark_unit(model, word):
    import pyarrow as pa

    from linecast.llm.words import Words

    return int(classlm._units(Words(pa.array([word])), model.top, model.rank, model.endings)[1][0])


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = rng.poisson(1.0, (30, 30)).astype(float)
    pairs[:10, 10:20] += 8
    pairs[10:20, :10] += 8

    def likelihood(cls):
        g = np.zeros((5, 5))
        np.add.at(g, (cls[:, None], cls[None, :]), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    seen = [likelihood(classlm.exchange(pairs, 4, sweeps=s)) for s in (0, 1, 2, 10)]
    assert seen == sorted(seen) and seen[-1] > seen[0]
    assert classlm.exchange(pairs, 4)[-1] == 4


def test_empty_corpus_and_null_ids(spark):
    d = spark.createDataFrame([(None, "a b"), (1, "a")], "doc_id long, text string")
    model = classlm.fit(d.limit(0), classes=2, top=5, endings=4)
    got = classlm.score(d, model).collect()
    assert sorted(r.n_known for r in got) == [0, 0] and {r.n_tokens for r in got} == {2, 3}
    assert all(r.base_score == 0 for r in got)  # one place for everything unknown
    assert d.select(classlm.held_out().alias("h")).where(F.col("h").isNull()).count() == 0


def test_gains_equal_the_likelihood_of_each_move():
    rng = np.random.default_rng(3)
    words, k = 12, 4
    pairs = rng.poisson(0.7, (words + 1, words + 1)).astype(float)
    cls = np.append(rng.integers(0, k - 1, words), k - 1)

    def bigrams(of):
        g = np.zeros((k, k))
        np.add.at(g, (of[:, None], of[None, :]), pairs)
        return g

    one = np.eye(k)[cls]
    g = bigrams(cls)
    got = classlm.gains((pairs @ one)[:words], (pairs.T @ one)[:words], np.diagonal(pairs)[:words], cls[:words], g)
    for w in range(words):
        for b in range(k - 1):
            to = cls.copy()
            to[w] = b
            assert got[w, b] - got[w, cls[w]] == pytest.approx(classlm.likelihood(bigrams(to)) - classlm.likelihood(g), abs=1e-8)


def test_every_word_is_exchanged_by_itself(spark):
    """Words of one ending, none of them among the ``top``, whose two kinds only their order tells apart."""
    rnd = random.Random(5)
    kinds = [[f"{c}{k}xyz" for k in range(40)] for c in "ab"]
    rows = [(i, " ".join(f"{rnd.choice(kinds[0])} left {rnd.choice(kinds[1])} right" for _ in range(20))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    train = d.where("doc_id < 50")
    start = classlm.fit(train, classes=4, top=2, endings=4)
    asked = classlm.sequences(train, start)
    model = classlm.exchange_words(asked, start, sweeps=4)
    # a word's own class, from the counts of a plain pass
    import pyarrow as pa

    from linecast.llm.words import Words

    cls = {r.w: r.cls for r in model.words.collect()}
    of = [{cls[int(h.view(np.int64))] for h in Words(pa.array([" ".join(kind)])).hashes()} for kind in kinds]
    assert len(cls) == 82 and not of[0] & of[1]
    assert np.allclose((10**model.step).sum(axis=1), 1)
    sums = Counter()
    for r in model.words.collect():
        sums[r.cls] += r.n + 1
    assert all(10 ** model.spread[k] == pytest.approx(n + 1) for k, n in sums.items())
    held = d.where("doc_id >= 50")
    score = [classlm.score(held, m).agg(F.sum("score")).first()[0] for m in (start, model)]
    assert score[1] > score[0]
    again = {r.doc_id: r.score for r in classlm.score(train, model, asked=asked).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in classlm.score(train, model).collect()})


def test_exchange_of_no_words(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model = classlm.fit(d, classes=2, top=5, endings=4)
    got = classlm.exchange_words(classlm.sequences(d, model), model)
    assert {r.n_tokens for r in classlm.score(d, got).collect()} == {1}
    empty = classlm.fit(d.limit(0), classes=2, top=5, endings=4)
    assert classlm.exchange_words(classlm.sequences(d, empty), empty) is empty
