"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method. A text's features are the distinct hashes of its words, word pairs and pairs that skip one
word. FTRL-proximal keeps ``z`` and ``n`` per coordinate, so each has its own learning rate, and an
L1 term holds weights at exactly zero until they are needed. The non-zero weights (at most
``2 ** bits``) travel to the scoring tasks with the function.

Scale. The classifier is fitted on a bounded sample of labelled rows (``max_rows``, those of smallest
hash), in one task; every row of the table is scored, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecast.llm.scratch import table, written
from linecast.llm.words import GOLDEN, U, Words, chunks, mix

#: Everything between words, as in the decontamination contract: punctuation doesn't hide a word.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BITS = 22
#: Text whose features are found at once.
TEXT_BYTES = 1 << 20


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every word, pair and skipping pair of each row, with repeats."""
    words = Words(column, GAP)
    h = words.hashes()
    rows, feats = [words.doc], [h]
    with np.errstate(over="ignore"):
        for k in (1, 2):
            near = words.doc[k:] == words.doc[:-k]
            rows.append(words.doc[:-k][near])
            feats.append(mix(h[:-k][near] * U(0x9FB21C651E98DF25) + h[k:][near] + U(k) * GOLDEN))
        return np.concatenate(rows), (np.concatenate(feats) >> U(64 - bits)).astype(np.int64)


def _distinct(rows: np.ndarray, feats: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows << bits) | feats)
    return both >> bits, both & ((1 << bits) - 1)


def _extract(bits: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=TEXT_BYTES):
            rows, feats = _distinct(*features(batch.column("text"), bits), bits)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feats, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), items], names=["order", "label", "items"])

    return run


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, min_rows: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the non-zero weights, and the bias. Features of fewer than ``min_rows`` rows
    get no weight: they would only learn the noise of single labels.

    The defaults were chosen by log loss on a fold of the *training* rows (crc32 mod 4 = 3, fitted on
    the other two remainders); rows that are held out had no part in it."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weight(z, n):
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    # All rows' features in one array, and rows as views of it: many small arrays would never be given back.
    flat = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in rows)])
    frequent = np.bincount(flat, minlength=1 << bits)[flat] >= min_rows
    ends = np.append(0, np.cumsum(frequent))[np.cumsum([0, *(len(x) for x, _ in rows)])]
    flat = flat[frequent]
    rows = [(flat[i:j], y) for i, j, (_, y) in zip(ends[:-1], ends[1:], rows, strict=True)]
    for _ in range(epochs):
        for x, y in rows:
            w, old = weight(z[x], n[x]), n[x]
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[x] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[x] = old + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return at, w[at], -zb / ((beta + np.sqrt(nb)) / alpha)


def _fit(bits: int, options: dict):
    def run(batches) -> Iterator[pa.RecordBatch]:
        orders, labels, sizes, items = [[np.zeros(0, np.int64)] for _ in range(4)]
        for batch in batches:
            orders.append(batch.column("order").to_numpy())
            labels.append(batch.column("label").to_numpy().astype(np.int64))
            sizes.append(np.diff(np.asarray(batch.column("items").offsets, np.int64)))
            items.append(np.array(batch.column("items").flatten(), np.int32))
        order, label, size = (np.concatenate(x) for x in (orders, labels, sizes))
        flat = np.concatenate([np.zeros(0, np.int32), *items[1:]])
        items.clear()
        end = np.cumsum(size)
        rows = [(flat[end[k] - size[k] : end[k]], int(label[k])) for k in np.lexsort((size, label, order)).tolist()]
        at, w, bias = ftrl(rows, bits, **options)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w, bias), pa.float64())], names=["i", "w"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels may not be learnt: crc32 of the id's text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, bits: int = BITS, **options) -> list[tuple[int, float]]:
    """Weights ``[(feature, w)]``, the bias at feature -1.

    The training rows are the ``max_rows`` labelled, not held-out rows of smallest id hash. Rows
    without label or id are left out; of contradicting labels of an id the larger counts. Without any
    labelled row the bias is 0 and every score 0.5."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("label"))
    rows = marks.where(~held_out("__id")).withColumn("order", F.xxhash64("__id")).orderBy("order", "__id").limit(max_rows)
    rows = written(rows, "sample")  # narrow, at most max_rows
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "__id").select("order", "label", "text")
    items = written(sample.mapInArrow(_extract(bits), "order long, label int, items array<int>"), "features")
    model = items.repartition(1).mapInArrow(_fit(bits, options), "i long, w double")
    return [(r["i"], r["w"]) for r in model.collect()]


def _score(weights: list[tuple[int, float]], bits: int):
    at = np.array([i for i, _ in weights if i >= 0], np.int64)
    value = np.array([w for i, w in weights if i >= 0], np.float64)
    bias = next((w for i, w in weights if i < 0), 0.0)

    def run(batches) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = value
        for batch in chunks(batches, "__text", TEXT_BYTES):
            rows, feats = features(batch.column("__text"), bits)
            live = dense[feats] != 0
            rows, feats = _distinct(rows[live], feats[live], bits)
            total = np.bincount(rows, weights=dense[feats], minlength=batch.num_rows) + bias
            names = [c for c in batch.schema.names if c != "__text"]
            score = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [score], names=[*names, "score"])

    return run


def score(docs: DataFrame, weights: list[tuple[int, float]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1) of every row; null and empty texts get the bias's score."""
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(_score(weights, bits), f"{schema}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, corpus: DataFrame | None = None, text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more.

    ``corpus``: the table that ``labels`` speak of, ``docs`` itself if it is not given."""
    weights = train(docs if corpus is None else corpus, labels, text_col=text_col, **options)
    plain = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are named
    own = docs.toDF(*plain)
    marked = score(own, weights, plain[docs.columns.index(text_col)], tuple(plain))
    return marked.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, weights)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
