"""Hard-negative mining: exact integer scores by Strassen multiplication, merged through heaps.

Method. Components become integers. The scores of a tile of anchors against a block of rows are one
int64 matrix product, computed by Strassen's recursion (seven half-size products, odd sides padded with
zeros); sums wrap modulo 2^64, so the result is exact. Each task keeps, for every anchor, a
heap of the best rows of its label, and in a second pass one heap for every positive over the window of
scores that the positive allows. Heaps of tasks merge by taking the best of their union.

Scale. Rows are written once as blocks of ``BLOCK_ROWS`` vectors. Anchors are taken in groups of at most
``GROUP_BYTES`` of integers, which are the only thing a task gets besides its own blocks, so both
grow without a join: every group is a pass over all blocks. A task gives at most five rows an anchor
in the first pass and three a positive in the second, however many vectors it reads. No score leaves
its tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linecast.llm.scratch import table, written
from linecast.llm.vectors import integer_rows, whole_vector, widened

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
BLOCK_ROWS = 4096
#: Integers of the anchors that one pass over the blocks takes along.
GROUP_BYTES = 8 << 20
#: Anchors of a tile: its scores against a block are ``TILE x BLOCK_ROWS`` integers.
TILE = 256
#: Integers are kept within this bound, so that a hundredfold score fits 64 bits.
LIMIT = 1 << 22
#: Sides up to this length are multiplied directly.
LEAF = 16
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices of any sides."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[:m, :n] = p1 + p4 - p5 + strassen(a12 - a22, b21 + b22)
    out[m:, n:] = p1 + p3 - p2 + strassen(a21 - a11, b11 + b12)
    return out


class Heaps:
    """The best ``size`` (score, id) of each of ``rows`` heaps: higher scores first, then smaller ids."""

    def __init__(self, rows: int, size: int):
        self.score = np.full((rows, size), NONE)
        self.id = np.zeros((rows, size), np.int64)

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``scores`` (heaps x ids; ``NONE`` is no offer) to the heaps ``rows``. ``ids`` ascend;
        ``scores`` is used up."""
        size = self.score.shape[1]
        at = np.arange(len(rows))
        best, best_id = [self.score[rows]], [self.id[rows]]
        for _ in range(min(size, scores.shape[1])):
            place = scores.argmax(axis=1)  # the first of equals has the smallest id
            top = scores[at, place]
            if (top == NONE).all():
                break
            best.append(top[:, None])
            best_id.append(ids[place][:, None])
            scores[at, place] = NONE
        score, number = np.concatenate(best, axis=1), np.concatenate(best_id, axis=1)
        order = np.lexsort((number, ~score), axis=1)[:, :size]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(number, order, 1)

    def batch(self, keys: np.ndarray, names: list[str]) -> pa.RecordBatch:
        """Rows (keys, score, id): ``keys`` has a row of key values for each heap."""
        heap, place = np.nonzero(self.score != NONE)
        columns = [*keys[heap].T, self.score[heap, place], self.id[heap, place]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=[*names, "score", "id"])


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            ids, labels = (np.asarray(part.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("__id", "__label"))
            rows = integer_rows(part.column("__vec"), SCALE, LIMIT)
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[order].astype(kind).tobytes()], pa.binary()) for x, kind in ((ids, np.int64), (labels, np.int64), (rows, np.int32))],
                names=["ids", "labels", "ints"],
            )


def _read(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and integers (rows x width) of each stored block."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            ints = np.frombuffer(row["ints"], np.int32).reshape(len(ids), -1)
            yield ids, np.frombuffer(row["labels"], np.int64), ints.astype(np.int64)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    width = max(anchors.shape[1], rows.shape[1])
    return strassen(widened(anchors, width), np.ascontiguousarray(widened(rows, width).T))


def _positive_rows(ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, size: int):
    """Tasks of the first pass: the best ``size`` other rows of each anchor's label."""
    of = {x: np.flatnonzero(labels == x) for x in np.unique(labels).tolist()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(ids), size)
        for found, its_label, rows in _read(batches):
            for label in np.unique(its_label).tolist():
                here = its_label == label
                for at in range(0, len(of.get(label, ())), TILE):
                    tile = of[label][at : at + TILE]
                    score = _scores(ints[tile], rows[here])
                    score[ids[tile][:, None] == found[here]] = NONE
                    heaps.merge(tile, score, found[here])
        yield heaps.batch(np.arange(len(ids))[:, None], ["anchor"])

    return run


def _negative_rows(labels: np.ndarray, ints: np.ndarray, anchor: np.ndarray, slot: np.ndarray, bound: np.ndarray, size: int):
    """Tasks of the second pass: the best ``size`` rows of other labels within each positive's window.
    ``anchor``, ``slot`` and ``bound`` (the positive's score) describe the positives, by anchor."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(anchor), size)
        for found, its_label, rows in _read(batches):
            for at in range(0, len(labels), TILE):
                end = min(at + TILE, len(labels))
                mine = slice(*np.searchsorted(anchor, [at, end]))
                if mine.start == mine.stop:
                    continue
                score = _scores(ints[at:end], rows)
                score[labels[at:end, None] == its_label] = NONE
                for s in np.unique(slot[mine]).tolist():
                    heap = np.arange(mine.start, mine.stop)[slot[mine] == s]
                    own, limit = score[anchor[heap] - at], bound[heap][:, None]
                    inside = (own != NONE) & (own * 100 >= limit * LOW) & (own * 100 <= limit * HIGH)
                    heaps.merge(heap, np.where(inside, own, NONE), found)
        yield heaps.batch(np.stack([anchor, slot], axis=1), ["anchor", "slot"])

    return run


def _merged(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The heaps of all tasks merged: the best ``size`` rows of each key, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the ids divisible by ``every``. Rows with a null id or label, a null vector or a null or
    non-finite component take no part. Shorter vectors count as filled with zeros at the end, integers
    beyond ``LIMIT`` as ``LIMIT``. Rows of one id: the one of least label and vector is the anchor, none
    of them is its positive, and as candidates each counts, so repeated rows fill places of a heap.
    Equal scores are ranked by smaller id. No rows, or no anchors, give an empty result. Other columns of
    the input are not read, whatever their names.
    """
    spark = vectors.sparkSession
    kept = vectors.where(whole_vector(vector) & F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(
        F.col(id_col).cast("long").alias("__id"), F.col(label).cast("long").alias("__label"), F.col(vector).alias("__vec")
    )
    blocks = written(kept.mapInArrow(_blocks, "ids binary, labels binary, ints binary"), "vector-blocks")
    first = kept.where(F.col("__id") % every == 0).groupBy("__id").agg(F.min(F.struct("__label", "__vec")).alias("__row"))
    anchors = written(first.select("__id", "__row.*"), "anchors")
    count, width = anchors.agg(F.count(F.lit(1)), F.max(F.size("__vec"))).first()
    groups = -(-count * max(width or 0, 1) * 8 // GROUP_BYTES)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for g in range(groups):
        mine = anchors.where(F.pmod(F.xxhash64("__id"), F.lit(groups)) == g).orderBy("__id").toArrow()
        if not mine.num_rows:
            continue
        ids, labels = (mine.column(c).to_numpy().astype(np.int64) for c in ("__id", "__label"))
        ints = integer_rows(mine.column("__vec").combine_chunks(), SCALE, LIMIT)
        best = _merged(blocks.mapInArrow(_positive_rows(ids, labels, ints, POSITIVES), "anchor long, score long, id long"), ["anchor"], POSITIVES)
        positives = written(best.select("anchor", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
        known = positives.orderBy("anchor", "slot").toArrow()
        if not known.num_rows:
            continue
        anchor, slot, bound = (known.column(c).to_numpy().astype(np.int64) for c in ("anchor", "slot", "positive_score"))
        found = blocks.mapInArrow(_negative_rows(labels, ints, anchor, slot, bound, NEGATIVES), "anchor long, slot long, score long, id long")
        names = spark.createDataFrame(pa.table({"anchor": np.arange(len(ids)), "anchor_id": ids}), "anchor long, anchor_id long")
        rows = _merged(found, ["anchor", "slot"], NEGATIVES).join(positives, ["anchor", "slot"]).join(names, "anchor")
        rows = rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = out.unionByName(written(rows, "hard-negatives")) if groups > 1 else rows
    return out


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings, labels of ids divisible by 7 moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.withColumn("label", moved))


ORACLE_OP13 = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept AS a JOIN kept AS b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
pairs AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives AS p JOIN scored AS n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 100 * n.score BETWEEN {LOW} * p.score AND {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= {NEGATIVES}"""
