"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

Method. A source's share of all tokens is raised to an exponent and normalised: 1 keeps the mix as it
is, 0 makes all sources equal. The exponent is bisected until the mix meets a target entropy or a
limit on repetition. A source's weight times the budget is its number of tokens; it is realised as
whole epochs plus a part of one more. Every epoch is a permutation of the source's blocks; the part
takes blocks in that order until its tokens are used up, and permuted documents in the last block.

Scale. DataFrame operations only, no text is shuffled. Documents fall into blocks by hash; blocks are
sized so that there are at most ``MAX_BLOCKS`` besides one per source, whatever the corpus, so a hot
source is many blocks and only their sums are windowed. The bisection tries many exponents at once,
and only these sums reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linecast.llm.decontam import bounded
from linecast.llm.scratch import table, written

MAX_BLOCKS = 1 << 16
TRIES = 15


def count_tokens(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, max_repeats: float | None, entropy_share: float | None, rounds: int = 6) -> float:
    """The largest exponent in [0, 1] whose mix has the entropy, or the smallest within the repetition
    limit. ``sources`` has ``share`` (over 0). Each round narrows the bracket ``TRIES + 1`` times.

    ``entropy_share``: part of the greatest possible entropy, log of the number of sources.
    ``max_repeats``: how much more often the most repeated source is seen than the least repeated."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * (k + 1) / (TRIES + 1) for k in range(TRIES)]
        p = F.col("share")
        sums = [F.count("*").alias("n")]
        for k, a in enumerate(grid):
            sums += [F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p) * a).alias(f"e{k}"), (F.max(F.pow(p, F.lit(a - 1))) / F.min(F.pow(p, F.lit(a - 1)))).alias(f"r{k}")]
        got = sources.agg(*sums).first()
        if entropy_share is not None:
            want = entropy_share * math.log(max(got["n"], 1))
            fine = [math.log(got[f"z{k}"]) - got[f"e{k}"] / got[f"z{k}"] >= want for k in range(TRIES)]  # falls with the exponent
            at = sum(fine)
        else:
            fine = [got[f"r{k}"] <= max_repeats for k in range(TRIES)]  # holds from some exponent on
            at = TRIES - sum(fine)
        edges = [low, *grid, high]
        low, high = edges[at], edges[at + 1]
    return low if entropy_share is not None else high


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_repeats: float | None, entropy_share: float | None, budget: float | None, block_tokens: int, seed: int):
    """Tables ``sources(source, tokens, weight, blocks, full)`` and ``parts(source, block, upto)``."""
    if (max_repeats is None) == (entropy_share is None):
        raise ValueError("give either max_repeats or entropy_share")
    src = F.col(source_col).alias("source")
    sizes = docs.select(src, count_tokens(F.col(text_col)).alias("t")).groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("rows"))
    sizes = written(sizes, "sources")
    total = sizes.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = sizes.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    alpha = exponent(shares, max_repeats, entropy_share) if total else 1.0
    scale = shares.agg(F.sum(F.pow("share", F.lit(alpha))).alias("z"), F.max(F.pow("share", F.lit(1 - alpha))).alias("m")).first()
    z = scale["z"] or 1.0
    # without a budget, the least repeated source is seen exactly once, so no document is lost
    tokens = float(budget) if budget is not None else total * z * (scale["m"] or 1.0)
    step = max(block_tokens, -(-total // MAX_BLOCKS))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    sources = sizes.withColumn("weight", weight).withColumn("due", F.round(F.col("weight") * F.lit(tokens)).cast("long"))
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(step))).cast("long"))
    # sources without tokens can't be weighed; their rows stay once
    sources = sources.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("due") / F.col("tokens"))).otherwise(1).cast("int"))
    sources = written(sources.withColumn("rest", F.when(F.col("tokens") > 0, F.col("due") % F.col("tokens")).otherwise(0)), "mix")

    placed = place(docs, sources, id_col, text_col, source_col, seed).select("__source", "__block", "__rank", "__tokens")
    sums = placed.groupBy("__source", "__block").agg(F.sum("__tokens").alias("t"))
    order = F.xxhash64(F.lit(seed), F.col("full"), F.col("__block"))
    cum = sums.join(sources, sums["__source"].eqNullSafe(sources["source"])).withColumn("order", order)
    before = F.sum("t").over(Window.partitionBy("source").orderBy("order", "__block").rowsBetween(Window.unboundedPreceding, -1))
    cum = cum.select("source", F.col("__block").alias("block"), "t", "rest", F.coalesce(before, F.lit(0)).alias("before")).where("before < rest")
    cum = written(cum, "parts")
    edge = cum.where("before + t > rest").select(F.col("source").alias("es"), F.col("block").alias("eb"), (F.col("rest") - F.col("before")).alias("left"))
    inside = placed.join(edge, F.col("__source").eqNullSafe(F.col("es")) & (F.col("__block") == F.col("eb")))
    ran = F.sum("__tokens").over(Window.partitionBy("es", "eb").orderBy("__rank").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    upto = inside.withColumn("ran", ran).groupBy("es", "eb").agg(F.max(F.when(F.col("ran") <= F.col("left"), F.col("__rank"))).alias("upto"))
    upto = upto.select("es", "eb", F.coalesce("upto", F.lit(-(1 << 62)).cast("long")).alias("upto"))
    parts = cum.join(upto, F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("eb")), "left").select("source", "block", F.coalesce("upto", F.lit((1 << 62)).cast("long")).alias("upto"))
    return sources, written(parts, "parts"), alpha


def place(docs: DataFrame, sources: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with its source's plan, block, place in the block and tokens; no shuffle."""
    s = sources.select(F.col("source").alias("__source"), F.col("blocks").alias("__blocks"), F.col("full").alias("__full"))
    joined = docs.join(bounded(s, F.coalesce(F.length(F.col("__source").cast("string")), F.lit(0)) + 24), docs[source_col].eqNullSafe(s["__source"]))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    return joined.withColumn("__block", F.pmod(key, F.col("__blocks"))).withColumn("__rank", F.shiftright(F.xxhash64(F.lit(seed + 1), key), 2)).withColumn("__tokens", count_tokens(F.col(text_col)))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float | None = 2.0, entropy_share: float | None = None, budget: float | None = None, block_tokens: int = 1 << 18, seed: int = 7) -> DataFrame:
    """``docs`` plus ``__copies``, how often the mix holds the row, ``__block`` and ``__weight``.

    Exactly one of ``max_repeats`` and ``entropy_share`` (see ``exponent``) sets the temperature.
    ``budget`` is the number of tokens of the whole mix; without it, the least repeated source is seen
    once and no row is lost. A source gets at most its due and at least its due less one document.

    * a null source is a source; null and empty texts have no tokens: such rows follow their block,
      and a source without any tokens stays once;
    * a null id takes part; rows of equal id, source and text are one item of the permutation: they go
      in or out together (ties), so a part epoch may fall short by all of them;
    * an empty table gives an empty mix; other columns are passed through, and may have any name that
      does not begin with two underscores.
    """
    sources, parts, _ = plan(docs, id_col, text_col, source_col, max_repeats, entropy_share, budget, block_tokens, seed)
    placed = place(docs, sources, id_col, text_col, source_col, seed)
    p = parts.select(F.col("source").alias("__ps"), F.col("block").alias("__pb"), F.col("upto").alias("__upto"))
    p = bounded(p, F.coalesce(F.length(F.col("__ps").cast("string")), F.lit(0)) + 24)
    out = placed.join(p, placed["__source"].eqNullSafe(F.col("__ps")) & (placed["__block"] == F.col("__pb")), "left")
    extra = F.coalesce((F.col("__rank") <= F.col("__upto")).cast("int"), F.lit(0))
    return out.withColumn("__copies", F.col("__full") + extra).drop("__ps", "__pb", "__upto", "__source", "__blocks", "__full", "__rank")


def realise(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs``' columns, each row as often as the mix holds it."""
    mixed = mix_sources(docs, **options).where("__copies > 0")
    return mixed.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """How often each document of the whole table stands in the mix, with its block and tokens."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__block").alias("block"), F.col("__copies").alias("copies"))
