"""Op 10: benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest

from linecast.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, size=13):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, words string, token string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int")
    got = decontam.decontaminate(d, b, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr)


def data(seed=4):
    rnd = random.Random(seed)
    word = [f"w{k}" for k in range(60)] + ["Éa", "x9"]
    items = [(i, " ".join(rnd.choice(word) for _ in range(rnd.choice([1, 3, 13, 14, 30])))) for i in range(15)]
    docs = []
    for i in range(60):
        t = [rnd.choice(word) for _ in range(rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(t))
            piece = rnd.choice(items)[1].split()
            t[at:at] = piece[: rnd.randint(1, len(piece))]
        docs.append((i, ", ".join(t).upper() if i % 3 == 0 else "\n".join(t)))
    return docs, items


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_equals_brute_force_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    docs, items = data()
    # "É" is upper case outside A-Z and stays as it is
    docs = [(i, t.replace("ÉA", "Éa")) for i, t in docs]
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    items = [(1, passage), (1, passage), (2, passage), (None, "solo words"), (3, None), (4, " ... "), (5, "tiny")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, passage), (4, passage), (4, "clean"), (None, "a solo words b"), (5, "TINY " + "x " * 19), (6, "tiny " + "x " * 20), (7, passage[:-4])]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    flags = {(r[0], r[1]): r[5] for r in got}
    assert flags[5, 20] and not flags[6, 21]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_filter_keeps_every_clean_row_and_column(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    d = spark.createDataFrame([(1, "clean", "s"), (1, passage, "s"), (None, None, "s"), (2, passage + " tail", "s"), (2, "clean", "s"), (2, "clean", "s")], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, d.where("text = 'clean' or text is null").collect()))
