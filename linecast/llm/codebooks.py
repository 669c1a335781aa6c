"""Vector code compression by product codebooks, with distances from per-dimension value dictionaries.

Method. Components become integers, so a block of vectors has few distinct values in each dimension.
A block is stored once as dictionaries (the sorted distinct integers of each dimension) and codes (the
place of each component in its dictionary). For a codebook, the squared differences of every dictionary
value to all entries are tabulated, and the distance of a part to all entries is then a sum of gathered
table rows, one for each of its dimensions. All arithmetic is in integers, so results are exact.

Scale. Blocks hold at most ``BLOCK_ROWS`` vectors, so dictionaries are bounded whatever values occur.
They are written once to the shared folder; each round is one pass over them in which a task sums
its own parts by entry, so at most ``parts x entries`` sums leave a task. The driver holds the codebooks
(``parts x entries x width`` integers) and nothing else. No step groups rows by vector or by entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecast.llm.scratch import table, written
from linecast.llm.vectors import integer_rows, whole_vector, widened

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a block; its dictionaries hold no more values a dimension, so codes fit 16 bits.
BLOCK_ROWS = 8192
#: Integers are kept within this bound, so that a sum of squared differences fits 64 bits.
LIMIT = 1 << 26
#: Rows whose distances are summed at once, so that they stay in the processor's cache.
SLICE = 1024


def _blocks(id_type: pa.DataType, label_type: pa.DataType):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows = integer_rows(part.column("__vec"), SCALE, LIMIT)
                values, codes = [], []
                for d in range(rows.shape[1]):
                    distinct, code = np.unique(rows[:, d], return_inverse=True)
                    values.append(distinct)
                    codes.append(code.astype(np.uint16))
                whole = [0, part.num_rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(whole, part.column("__id").cast(id_type)),
                        pa.ListArray.from_arrays(whole, part.column("__label").cast(label_type)),
                        pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                        pa.array([np.concatenate([*values, np.zeros(0, np.int64)]).tobytes()], pa.binary()),
                        pa.array([b"".join(c.tobytes() for c in codes)], pa.binary()),
                    ],
                    names=["ids", "labels", "sizes", "vals", "codes"],
                )

    return run


class Block:
    """A stored block: ``values[d]`` the dictionary and ``codes[d]`` the places of dimension ``d``."""

    def __init__(self, row: dict, width: int):
        self.rows = len(row["ids"])
        ends = np.cumsum([0, *row["sizes"]])
        flat = np.frombuffer(row["vals"], np.int64)
        places = np.frombuffer(row["codes"], np.uint16).reshape(len(row["sizes"]), self.rows)
        self.values = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.codes = list(places)
        for _ in range(width - len(self.values)):  # vectors that are shorter than the longest
            self.values.append(np.zeros(1, np.int64))
            self.codes.append(np.zeros(self.rows, np.uint16))

    def nearest(self, dims: range, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower of equals) and squared distance of each row's part."""
        tables = [(self.values[d][:, None] - book[:, k]) ** 2 for k, d in enumerate(dims)]
        most = sum(int(t.max(initial=0)) for t in tables)
        tables = [t.astype(np.int32 if most < 2**31 else np.int64) for t in tables]
        index, error = np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)
        for at in range(0, self.rows, SLICE):
            here = slice(at, at + SLICE)
            total = tables[0][self.codes[dims[0]][here]]
            for t, d in zip(tables[1:], dims[1:], strict=True):
                total += t[self.codes[d][here]]
            index[here] = total.argmin(axis=1)
            error[here] = total.min(axis=1)
        return index, error

    def part(self, dims: range) -> np.ndarray:
        return np.stack([self.values[d][self.codes[d]] for d in dims], axis=1)


def _sums(books: np.ndarray, spans: list[range], width: int):
    """Rows (part, entry, pos, total) of a task: sums of the parts nearest to each entry; pos -1 counts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts, entries, size = books.shape
        total = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, width)
                for p, dims in enumerate(spans):
                    index, _ = block.nearest(dims, books[p])
                    order = np.argsort(index, kind="stable")
                    found, first = np.unique(index[order], return_index=True)
                    total[p, found, :size] += np.add.reduceat(block.part(dims)[order], first, axis=0)
                    total[p, :, size] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(total[:, :, size])
        sums = total[p, e]
        pos = np.tile(np.append(np.arange(size), -1), len(p))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, size + 1), pa.int32()), pa.array(np.repeat(e, size + 1), pa.int32()), pa.array(pos, pa.int32()), pa.array(sums.reshape(-1), pa.int64())],
            names=["part", "entry", "pos", "total"],
        )

    return run


def _assigned(books: np.ndarray, spans: list[range], width: int, id_type, label_type):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                block = Block(row, width)
                found = [block.nearest(dims, books[p]) for p, dims in enumerate(spans)]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[i].values.cast(id_type),
                        batch.column("labels")[i].values.cast(label_type),
                        pa.array([c.tobytes().hex() for c in codes], pa.string()),
                        pa.array(sum(f[1] for f in found), pa.int64()),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error) and the codebooks (parts x entries x width).

    Rows whose vector is null or holds a null or non-finite component go. A vector has as many
    components as the longest; shorter and empty ones, and a length that the parts do not divide, are
    filled with zeros at the end. Integers beyond ``LIMIT`` count as ``LIMIT``. Codebooks start with the
    rows of smallest id (null last, equal ids by vector), so fewer than 256 rows give as many entries.
    Repeated rows each count. An empty table gives no rows and empty codebooks. Other columns of the
    input are not read, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kept = vectors.where(whole_vector(vector)).select(F.col(id_col).alias("__id"), F.col(label).alias("__label"), F.col(vector).alias("__vec"))
    types = [kept.schema[c].dataType for c in ("__id", "__label")]
    arrow = [to_arrow_type(t) for t in types]
    ids, labels = (t.simpleString() for t in types)
    blocks = written(kept.mapInArrow(_blocks(*arrow), f"ids array<{ids}>, labels array<{labels}>, sizes array<int>, vals binary, codes binary"), "vector-blocks")
    width = blocks.agg(F.max(F.size("sizes"))).first()[0] or 0
    width += -width % PARTS
    if not width:
        width = PARTS  # no vectors, or empty ones only
    first = kept.orderBy(F.col("__id").asc_nulls_last(), "__vec").limit(ENTRIES).select("__vec").collect()
    start = integer_rows(pa.array([r[0] for r in first], pa.list_(pa.float64())), SCALE, LIMIT)
    size = width // PARTS
    spans = [range(p * size, (p + 1) * size) for p in range(PARTS)]
    books = np.stack([widened(start, width)[:, s.start : s.stop] for s in spans])
    if not len(first):
        return blocks.select(F.lit(None).cast(types[0]).alias("vec_id"), F.lit(None).cast(types[1]).alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(books, spans, width), "part int, entry int, pos int, total long")
        total = np.zeros((PARTS, len(first), size + 1), np.int64)
        for r in sums.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total")).collect():
            total[r.part, r.entry, r.pos] = r.total
        used = total[:, :, size] > 0
        books = books.copy()
        books[used] = total[used][:, :size] // total[used][:, size:]
    rows = blocks.mapInArrow(_assigned(books, spans, width, *arrow), f"vec_id {ids}, label {labels}, code string, error long")
    return rows, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors, with each label's summed error and the codebooks' hash."""
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    rows = written(rows, "vector-codes")
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed("label", "__label")
    return rows.join(sums, rows["label"].eqNullSafe(sums["__label"])).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Every round in SQL: parts unnested by place, joined with the entries, least distance first."""
    ctes = [
        """kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "wide AS (SELECT max(len(v)) // 4 AS w FROM kept)",
        """comp AS MATERIALIZED (
  SELECT vec_id, p AS part, k AS pos, v[p * w + k + 1] AS x
  FROM kept, wide, range(4) AS a(p), range(w) AS b(k))""",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256)",
        "book0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM comp JOIN firsts USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, part, min(entry) FILTER (d = least) AS entry, any_value(least) AS d FROM (
    SELECT *, min(d) OVER (PARTITION BY vec_id, part) AS least FROM (
      SELECT vec_id, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d
      FROM comp JOIN book{r} USING (part, pos) GROUP BY ALL))
  GROUP BY vec_id, part)""")
        if r < ROUNDS:
            ctes.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, c) AS c FROM book{r} LEFT JOIN (
    SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM comp JOIN near{r} USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos))""")
    ctes.append(f"""coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE_OP12 = _oracle()
