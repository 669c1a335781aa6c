"""Op 3: weights, budgets and permutations."""

import math

import pytest
from pyspark.sql import functions as F

from linecast.llm import mixing


def frame(spark, sizes, words=10):
    rows = [(k * 10_000 + i, " ".join(["w"] * words), s, "z") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string")


def test_repetition_limit_sets_the_exponent(spark):
    d = frame(spark, {"a": 800, "b": 100, "c": 50})
    m = mixing.mix_sources(d, max_repeats=2.0, block_tokens=200)
    got = {r.source: r.s for r in m.groupBy("source").agg((F.sum("__copies") / F.count("*")).alias("s")).collect()}
    assert got["a"] == 1.0 and got["c"] == pytest.approx(2.0, abs=0.03)
    assert got["b"] == pytest.approx(8 ** (math.log(2) / math.log(16)), abs=0.02)
    assert m.where("__copies < 1").count() == 0  # no budget: nothing is lost


def test_entropy_target(spark):
    sizes = {"a": 700, "b": 200, "c": 100}
    shares = spark.createDataFrame([(n / 1000,) for n in sizes.values()], "share double")
    alpha = mixing.exponent(shares, None, 0.95)
    p = [n / 1000 for n in sizes.values()]
    w = [x**alpha / sum(y**alpha for y in p) for x in p]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.95 * math.log(3), abs=1e-5)
    assert mixing.exponent(shares, None, 0.1) == pytest.approx(1.0, abs=1e-6)  # the mix is already flatter
    assert mixing.exponent(shares, 1e9, None) == pytest.approx(0.0, abs=1e-6)


def test_budget_is_met_to_a_document_and_blocks_are_whole(spark):
    d = frame(spark, {"a": 700, "b": 200, "c": 100})
    m = mixing.mix_sources(d, max_repeats=None, entropy_share=1.0, budget=3000, block_tokens=100).cache()
    got = {r.source: r.t for r in m.groupBy("source").agg(F.sum(F.col("__copies") * F.col("__tokens")).alias("t")).collect()}
    assert all(990 <= t <= 1000 for t in got.values())
    state = m.where("source = 'a'").groupBy("__block").agg(F.min("__copies").alias("lo"), F.max("__copies").alias("hi")).collect()
    assert sum(r.lo != r.hi for r in state) <= 1  # only the last block is taken in part
    again = mixing.mix_sources(d, max_repeats=None, entropy_share=1.0, budget=3000, block_tokens=100)
    assert sorted(r.doc_id for r in m.where("__copies = 1").collect()) == sorted(r.doc_id for r in again.where("__copies = 1").collect())


def test_edges(spark):
    d = frame(spark, {"a": 50, None: 5}).unionByName(spark.createDataFrame([(None, "x y", "a", "z"), (1, None, "a", "z"), (2, "", "e", "z"), (3, " ".join(["v"] * 50_000), "long", "z")] + [(9, "same row", "a", "z")] * 20, "doc_id long, text string, source string, block string"))
    out = mixing.realise(d, max_repeats=3.0)
    assert out.columns == d.columns
    key = ["doc_id", "text", "source"]
    assert out.select(key).distinct().count() == d.select(key).distinct().count()
    assert out.count() >= d.count()
    same = out.where("text = 'same row'").count()
    assert same % 20 == 0  # equal rows go in or out together
    assert mixing.realise(d.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(d, max_repeats=2.0, entropy_share=0.5)
    only_empty = mixing.realise(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string"))
    assert only_empty.count() == 2
