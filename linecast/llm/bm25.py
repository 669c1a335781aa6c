"""Exact BM25 top-k search with block-max pruning, per shard, merged with global statistics.

Method. Each shard is an inverted index. Its most common terms are rows over blocks of consecutive
documents, and every (term, block) of them keeps the greatest term score in it. Queries come in packs:
the postings of their rarer terms are added up first, and with the common terms' block maxima they bound
every block. As in block-max WAND, the common terms are only scored where that bound can still reach
the k-th score found: by one matrix product for a pack and a few blocks, in single precision. What that
leaves is scored exactly. Document frequencies, the number of documents and their mean length are counted
over the whole corpus, so scores do not depend on the sharding and the merge of the shards' top k is exact.

Scale. Texts are read once and become compact postings, some 8 MB of text to a written row. A shard is
up to ``SHARD_CHUNKS`` such rows of one task, where they are read: postings are never shuffled. Queries,
packed with the distinct terms of a pack, are taken in groups of at most ``QUERY_BYTES``, which are all that a
task gets besides its own rows; every group is a pass over the postings, so both may grow without
being sent to each other. A task gives at most ``k`` rows a query, from all its shards, and what one shard
found is the score to reach in the next. Frequencies are pre-aggregated by task and joined with the query
terms in Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linecast.llm.classlm import _pack, _unpack
from linecast.llm.scratch import shared_dir, table, written
from linecast.llm.suffixes import ragged
from linecast.llm.toxicity import GAP
from linecast.llm.words import Words, chunks

CHUNK = 8 << 20
SHARD_CHUNKS = 4
DOCS_A_BLOCK = 64
QUERIES_A_BLOCK = 1000
#: Packed queries that one pass over the postings takes along (one block at least).
QUERY_BYTES = 32 << 20
#: Blocks of one matrix product, and into how many runs its documents fall whose greatest scores set the score to reach.
BLOCKS_A_TILE, RUNS = 4, 16
#: Scores (queries times documents) and postings that are added up at once.
CELLS, POSTINGS = 4 << 20, 1 << 17
#: A term in at least one of so many documents of a shard has a whole row; at most ``ROWS`` terms have, of
#: at most ``ROW_CELLS`` scores.
COMMON, ROWS, ROW_CELLS = 20, 512, 16 << 20
#: Room for the rounding of sums in single precision, in part and to 9 places.
ROOM, LEAST = 1e-4, 2e-9
K1, B = 1.2, 0.75
NO_ID = np.iinfo(np.int64).max


def _postings(batch: pa.RecordBatch):
    """Sorted by term, then row: term, row and times; and the words of each row."""
    words = Words(batch.column("__text"), GAP)
    h = words.hashes()
    order = np.argsort(h, kind="stable")
    h, doc = h[order], words.doc[order]
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[at], doc[at], np.diff(np.append(at, len(h))), words.count


def _index(batches) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "__text", limit=CHUNK):
        h, doc, times, size = _postings(batch)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        blob = _pack(ids.view(np.uint64), batch.column("tag").to_numpy().view(np.uint64), size, h[first], np.diff(np.append(first, len(h))), doc, times)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([int(size.sum())], pa.int64()), pa.array([blob], pa.binary())], names=["docs", "words", "blob"])


def _frequencies(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("blob"):
            _, _, _, term, n, _, _ = _unpack(blob.as_py())
            for at in range(0, len(term), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(term[s].view(np.int64)), pa.array(n[s].astype(np.int64))], names=["term", "df"])


def _query_terms(batches) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "__text"):
        h, doc, times, _ = _postings(batch)
        ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(tags[doc]), pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))], names=["qid", "qtag", "term", "times"])


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of queries: its distinct terms with their weights, and each query's terms by number with their times."""
    pdf = pdf.sort_values(["qid", "qtag", "term"])
    q = pdf.groupby(["qid", "qtag"], sort=True).size()
    ids, tags = q.index.get_level_values(0).to_numpy(), q.index.get_level_values(1).to_numpy()
    terms, first, number = np.unique(pdf["term"].to_numpy().view(np.uint64), return_index=True, return_inverse=True)
    blob = _pack(ids.view(np.uint64), tags.view(np.uint64), q.to_numpy(), terms, pdf["idf"].to_numpy()[first], number, pdf["times"].to_numpy())
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "blob": [blob]})


class Shard:
    """An inverted index with block maxima over packed postings."""

    def __init__(self, blobs: list[bytes], mean: float):
        parts = [_unpack(b) for b in blobs]
        self.ids = np.concatenate([p[0].view(np.int64) for p in parts])
        self.tags = np.concatenate([p[1].view(np.int64) for p in parts])
        size = np.concatenate([p[2] for p in parts]).astype(np.float64)
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        term = np.concatenate([np.repeat(p[3], p[4]) for p in parts])
        doc = np.concatenate([p[5].astype(np.int32) + np.int32(base[k]) for k, p in enumerate(parts)])
        times = np.concatenate([p[6] for p in parts])
        order = np.argsort(term, kind="stable")  # parts come by document, so postings stay so
        term, self.doc, times = term[order], doc[order], times[order].astype(np.float64)
        del doc, order
        gain = times * (K1 + 1) / (times + K1 * (1 - B + B * size[self.doc] / mean))
        self.n = len(self.ids)
        self.blocks = BLOCKS_A_TILE * -(-self.n // (DOCS_A_BLOCK * BLOCKS_A_TILE))
        self.wide = self.blocks * DOCS_A_BLOCK
        lead = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.append(lead, len(term)))
        # terms of many documents are kept as whole rows of scores: a product of rows is cheaper than postings
        often = np.flatnonzero(df * COMMON >= self.n)
        often = np.sort(often[np.argsort(-df[often], kind="stable")[: min(ROWS, ROW_CELLS // max(self.wide, 1))]])
        self.common = term[lead[often]]
        # documents lie by falling weight of their common terms, so that blocks bound their documents closely
        mass = np.zeros(self.n)
        for t in often:
            at = slice(lead[t], lead[t] + df[t])
            mass[self.doc[at]] += gain[at] * np.log1p((self.n - df[t] + 0.5) / (df[t] + 0.5))
        order = np.argsort(-mass, kind="stable")
        place = np.empty(self.n, np.int32)
        place[order] = np.arange(self.n, dtype=np.int32)
        self.ids, self.tags, self.doc = self.ids[order], self.tags[order], place[self.doc]
        self.row = np.zeros((self.wide, len(often)))  # by document
        for k, t in enumerate(often):
            at = slice(lead[t], lead[t] + df[t])
            self.row[self.doc[at], k] = gain[at]
        self.rough = self.row.astype(np.float32)
        self.most = self.rough.reshape(self.blocks, DOCS_A_BLOCK, len(often)).max(axis=1)
        rare = ~np.isin(np.arange(len(lead)), often)
        keep = np.repeat(rare, df)
        self.term, self.doc, self.gain = term[lead[rare]], self.doc[keep], gain[keep]
        self.first = np.append(0, np.cumsum(df[rare]))

    @staticmethod
    def _find(keys: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Places of ``terms`` among ``keys``, -1 for those that are not there."""
        if not len(keys):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
        return np.where(keys[at] == terms, at, -1)

    def ask(self, block: list[np.ndarray], k: int, reach: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For a block of queries, rows (query number, document, score): of each query all documents that
        may be among its top ``k`` and come to its score to ``reach``."""
        ids, _, n, terms, idf, number, times = block
        at_common, at_rare = self._find(self.common, terms), self._find(self.term, terms)
        end = np.cumsum(n)
        step = max(1, CELLS // max(self.wide, 1))
        for lo in range(0, len(ids) if self.n else 0, step):
            hi = min(lo + step, len(ids))
            part = slice(end[lo] - n[lo], end[hi - 1])
            code = number[part]
            query, weight = np.repeat(np.arange(hi - lo), n[lo:hi]), times[part] * idf[code]
            rows = np.zeros((hi - lo, len(self.common)))
            have = at_common[code] >= 0
            rows[query[have], at_common[code[have]]] = weight[have]
            have = at_rare[code] >= 0
            rare = self._rare(hi - lo, query[have], at_rare[code[have]], weight[have])
            for q, doc in self._candidates(rows.astype(np.float32), rare.astype(np.float32), k, reach[lo:hi]):
                total = np.round(rare[q, doc] + np.einsum("pr,pr->p", rows[q], self.row[doc]), 9)
                found = total > 0
                yield [lo + q[found], doc[found], total[found]]

    def _rare(self, queries: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores by the rarer terms, whose postings are added up for as many queries at once as hold few enough."""
        out = np.zeros((queries, self.wide))
        size = self.first[term + 1] - self.first[term]
        upto = np.append(0, np.cumsum(size))[np.searchsorted(query, np.arange(queries + 1))]
        lo = 0
        while lo < queries:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + POSTINGS, side="right")) - 1)
            part = slice(*np.searchsorted(query, (lo, hi)))
            post = ragged(self.first[term[part]], size[part])
            cell, score = np.repeat((query[part] - lo) * self.wide, size[part]), np.repeat(weight[part], size[part])
            cell += self.doc[post]
            score *= self.gain[post]
            out[lo:hi] = np.bincount(cell, weights=score, minlength=(hi - lo) * self.wide).reshape(hi - lo, self.wide)
            lo = hi
        return out

    def _candidates(self, rows: np.ndarray, rare: np.ndarray, k: int, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, document) that may be among the top ``k``, tiles of blocks by falling bound."""
        queries = len(rows)
        across = DOCS_A_BLOCK * BLOCKS_A_TILE
        bound = rare.reshape(queries, self.blocks, DOCS_A_BLOCK).max(axis=2) + rows @ self.most.T
        bound = bound.reshape(queries, -1, BLOCKS_A_TILE).max(axis=2) * (1 + ROOM)
        reach = reach.astype(np.float32)
        best = np.zeros((queries, k), np.float32)  # greatest scores of different runs of documents
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for tile in np.argsort(-bound.sum(axis=0), kind="stable").tolist():
            live = np.flatnonzero((bound[:, tile] + LEAST >= reach) & (bound[:, tile] > 0))
            if not len(live):
                continue
            at = slice(tile * across, (tile + 1) * across)
            score = rows[live] @ self.rough[at].T + rare[live, at]
            most = score
            while most.shape[1] > RUNS and most.shape[1] % 2 == 0:
                most = np.maximum(*np.hsplit(most, 2))
            more = np.flatnonzero(most.max(axis=1) > best[live, 0])
            if len(more):
                best[live[more]] = np.partition(np.concatenate([best[live[more]], most[more]], axis=1), most.shape[1], axis=1)[:, most.shape[1] :]
                reach[live] = np.maximum(reach[live], best[live, 0] * (1 - ROOM) - LEAST)
            some = np.flatnonzero(most.max(axis=1) * (1 + ROOM) + LEAST >= reach[live])
            q, doc = np.nonzero((score[some] * (1 + ROOM) + LEAST >= reach[live[some], None]) & (score[some] > 0))
            held.append((live[some[q]], at.start + doc, score[some[q], doc]))
        if not held:
            return
        query, doc, score = (np.concatenate(c) for c in zip(*held, strict=True))
        keep = score * (1 + ROOM) + LEAST >= reach[query]
        query, doc = query[keep], doc[keep]
        step = max(1, POSTINGS // max(rows.shape[1], 1))
        for lo in range(0, len(query), step):
            yield query[lo : lo + step], doc[lo : lo + step]


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows (query number, id, tag, score) the ``k`` of each query that rank first."""
    order = np.lexsort((found[2], found[1], -found[3], found[0]))
    found = [c[order] for c in found]
    new = np.append(True, found[0][1:] != found[0][:-1]) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return [c[place < k] for c in found]


def _search(k: int, mean: float, asked: list[bytes]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        ids, tags = (np.concatenate([_unpack(b)[i].view(np.int64) for b in asked] or [np.zeros(0, np.int64)]) for i in range(2))
        best = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        reach = np.zeros(len(ids))

        def merged() -> list[np.ndarray]:
            shard, out, lo = Shard(held, mean), [], 0
            for blob in asked:
                block = _unpack(blob)
                here = [[lo + q, shard.ids[doc], shard.tags[doc], score] for q, doc, score in shard.ask(block, k, reach[lo : lo + len(block[0])])]
                if here:
                    out.append(_best([np.concatenate(c) for c in zip(*here, strict=True)], k))
                lo += len(block[0])
            now = _best([np.concatenate(c) for c in zip(best, *out, strict=True)], k)
            full = np.flatnonzero(np.bincount(now[0], minlength=len(ids)) >= k)
            reach[full] = now[3][np.searchsorted(now[0], full, side="right") - 1]
            return now

        for batch in batches:
            for blob in batch.column("blob"):
                held.append(blob.as_py())
                if len(held) == SHARD_CHUNKS:
                    best = merged()
                    held.clear()
        if held:
            best = merged()
        query, found, tag, score = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query], pa.int64()), pa.array(tags[query], pa.int64()), pa.array(found, pa.int64(), mask=found == NO_ID), pa.array(tag, pa.int64()), pa.array(score, pa.float64())],
            names=["qid", "qtag", "id", "tag", "score"],
        )

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` rows of ``docs`` with the greatest BM25 score for each row
    of ``queries``, whose whole text is the query; terms count as often as they occur in it.

    Words are lower-cased (A-Z) and split at ASCII characters that are no letters or digits. Only rows
    that share a word are returned. Scores are rounded to 9 places; ties go to the smaller id.

    * null and empty texts match nothing and ask nothing;
    * a query whose id is null is not asked; rows without id can be found, after others of equal score;
    * repeated rows are found each on its own; rows of equal id and text ask once;
    * ids must be integers; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    cols = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("__text")]
    index = written(docs.select(*cols).mapInArrow(_index, "docs long, words long, blob binary"), "postings")
    total = index.agg(F.sum("docs").alias("n"), F.sum("words").alias("w")).first()
    n, mean = total["n"] or 0, (total["w"] or 0) / max(total["n"] or 0, 1)
    df = index.select("blob").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.where(F.col(id_col).isNotNull()).select(*cols).mapInArrow(_query_terms, "qid long, qtag long, term long, times long").distinct()
    asked = written(asked, "query-terms")
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select("qid", "qtag", "term", "times", idf.alias("idf"))
    many = asked.select("qid", "qtag").distinct().count()
    blocks = max(1, -(-many // QUERIES_A_BLOCK))
    packed = written(weighed.withColumn("block", F.pmod(F.xxhash64("qid", "qtag"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(_block, "block int, blob binary"), "queries")

    largest = packed.agg(F.max(F.length("blob"))).first()[0] or 1
    step = max(1, QUERY_BYTES // largest)
    rows = "qid long, qtag long, id long, tag long, score double"
    found = f"{shared_dir(spark)}/found-{uuid.uuid4().hex[:12]}"
    for at in range(0, blocks, step):
        asks = [r[0] for r in packed.where(F.col("block").between(at, at + step - 1)).select("blob").collect()]
        index.select("blob").mapInArrow(_search(k, mean or 1.0, asks), rows).write.mode("append").option("compression", "zstd").parquet(found)
    found = spark.read.schema(rows).parquet(found)
    place = F.row_number().over(Window.partitionBy("qid", "qtag").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "tag"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias(id_col), "score")


def op5_bm25(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where(F.col("doc_id") % 100 == 0))


ORACLE_OP5 = """
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(n) AS len FROM tf GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM dl) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.n * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * dl.len / st.mean))), 9) AS score
  FROM tf q JOIN tf d ON q.term = d.term AND q.doc_id % 100 = 0 JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = d.doc_id, st GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""
