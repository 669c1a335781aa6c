"""Op 9: extendible hashing against a brute-force directory."""

import hashlib
import random

import pytest

from linecast.llm import sharding


def brute(rows, limit):
    h = {r: bin(int(hashlib.md5(f"{'' if r[0] is None else r[0]}\n{r[1] or ''}".encode()).hexdigest()[:15], 16))[2:].zfill(60) for r in rows}
    total = {}
    for r in rows:
        for n in range(61):
            total[h[r][:n]] = total.get(h[r][:n], 0) + len((r[1] or "").encode())
    return {r: next(h[r][:n] for n in range(61) if total[h[r][:n]] <= limit) for r in rows}


@pytest.mark.parametrize("limit", [1 << 30, 5000, 600])
def test_equals_brute_force(spark, limit):
    rnd = random.Random(2)
    rows = [(i, "é" * rnd.randint(0, 250)) for i in range(400)] + [(None, None), (None, "x")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert {(r.doc_id, r.text): r["shard"] for r in got} == brute(rows, limit)
    assert all(r.depth == len(r["shard"]) and r.page == 0 for r in got)


def test_equal_rows_are_paged_and_large_rows_stand_alone(spark):
    rows = [(1, "a" * 100)] * 250 + [(2, "b" * 5000)] * 3 + [(k, "c" * 90) for k in range(3, 40)]
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id long, text string, shard string, page int").repartition(5)
    got = sharding.shard(df, 1000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault((r["shard"], r.page), []).append(r.n_bytes)
    for v in sizes.values():
        assert sum(v) <= 1000 or len(v) == 1
    assert sorted(len(v) for v in sizes.values() if v[0] == 100) == [10] * 25


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 10).collect() == []
