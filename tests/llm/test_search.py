"""Op 5: BM25 against a plain computation."""

import math
import random
import re
from collections import Counter

import pyarrow as pa

from linecast.llm import bm25

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, queries, k):
    tf = [Counter(words(t)) for _, t in docs]
    n, mean = len(docs), sum(sum(x.values()) for x in tf) / max(len(docs), 1)
    df = Counter(w for x in tf for w in x)
    out = []
    for q, text in queries:
        got = []
        for (i, _), x in zip(docs, tf, strict=True):
            s = 0.0
            for w, m in Counter(words(text)).items():
                if x[w]:
                    s += m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * sum(x.values()) / mean))
            if s > 0:
                got.append((-round(s, 6), i is None, i or 0, i))
        out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(got)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, queries, k):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    q = spark.createDataFrame([(i, t, 1) for i, t in queries], "doc_id long, text string, rank int")
    return sorted(((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in bm25.search(d, q, k).collect()), key=repr)


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(bm25, "CHUNK", 2000)
    monkeypatch.setattr(bm25, "QUERIES_A_BLOCK", 3)
    monkeypatch.setattr(bm25, "DOCS_A_BLOCK", 4)
    rnd = random.Random(6)
    word = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, " ".join(rnd.choice(word) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    docs += [(400 + i, docs[i][1]) for i in range(10)]  # ties
    queries = docs[::20]
    assert run(spark, docs, queries, 7) == brute(docs, queries, 7)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "?"), (4, "apple pear"), (4, "apple pear"), (None, "apple"), (5, "plum " * 20_000)]
    queries = [(10, "Apple!"), (11, None), (12, "nothing here"), (None, "apple"), (13, "plum pear pear")]
    assert run(spark, docs, queries, 10) == brute(docs, [q for q in queries if q[0] is not None], 10)
    assert run(spark, [], queries, 10) == []
    assert run(spark, docs, [], 10) == []


def test_packs_of_queries_are_scored_at_once(spark, monkeypatch):
    monkeypatch.setattr(bm25, "CHUNK", 20_000)
    monkeypatch.setattr(bm25, "SHARD_CHUNKS", 1)
    monkeypatch.setattr(bm25, "DOCS_A_BLOCK", 16)
    calls, real = [], bm25.Shard._candidates

    def candidates(self, rows, rare, k, reach):
        found = list(real(self, rows, rare, k, reach))
        calls.append((len(rows), self.n, sum(len(q) for q, _ in found), bool(reach.any())))
        return found

    monkeypatch.setattr(bm25.Shard, "_candidates", candidates)
    rnd = random.Random(8)
    word = [f"w{int(rnd.paretovariate(0.5))}" for _ in range(3000)]
    docs = [(i, " ".join(rnd.choice(word) for _ in range(rnd.randint(20, 60)))) for i in range(400)]
    queries, k = [d for d in docs if d[0] % 8 == 0], 3
    tf, mean = [Counter(words(t)) for _, t in docs], sum(len(words(t)) for _, t in docs) / len(docs)
    df = Counter(w for x in tf for w in x)
    index = list(bm25._index([pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], names=["id", "tag", "__text"])]))
    (asked,) = list(bm25._query_terms([pa.RecordBatch.from_arrays([pa.array([q[0] for q in queries]), pa.array([0] * len(queries)), pa.array([q[1] for q in queries])], names=["id", "tag", "__text"])]))
    hashes = {w: int(h) for x in tf for w, h in zip(x, bm25.Words(pa.array([" ".join(x)]), bm25.GAP).hashes().view("int64"), strict=True)}
    idf = {hashes[w]: math.log1p((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    pdf = asked.to_pandas()
    blob = bm25._block(pdf.assign(block=0, idf=pdf["term"].map(idf)))["blob"].iloc[0]
    (out,) = list(bm25._search(k, mean, [blob])(index))
    assert len(index) > 2 and [c[:2] for c in calls] == [(len(queries), x.column("docs")[0].as_py()) for x in index]
    assert [c[3] for c in calls] == [False] + [True] * (len(index) - 1)
    assert sum(c[2] for c in calls) < 0.2 * len(queries) * len(docs)
    got = sorted((r.qid, r.id, round(r.score, 6)) for r in out.to_pandas().itertuples(index=False))
    assert got == sorted((q, d, s) for q, _, d, s in brute(docs, queries, k))
