"""Byte words and shingles against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from linecast.llm.words import Words, chunks, shingles


def texts(seed=0):
    rnd = random.Random(seed)
    return [None, "", " ", "One two", "É a b\x0bC"] + ["".join(rnd.choice("aB é\t\n.") for _ in range(rnd.randint(0, 200))) for _ in range(50)] + ["x" * 300 + " y"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_are_split_and_hashed_alike(kind):
    col = pa.array(texts(), kind).slice(2)
    w, by = Words(col), {}
    h = w.hashes()
    for i, t in enumerate(texts()[2:]):
        own = slice(w.first[i], w.first[i + 1])
        got = [w.buf[a:b].tobytes() for a, b in zip(w.start[own], w.end[own], strict=True)]
        assert got == (t or "").encode().lower().split()
        for x, y in zip(got, h[own], strict=True):
            assert by.setdefault(x, y) == y
    assert len(set(by.values())) == len(by)


def test_shingle_sets_have_the_right_sizes():
    col = pa.array(texts())
    w = Words(col)
    _, first = shingles(w, w.hashes(), 5)
    for n, t in zip(np.diff(first), texts(), strict=True):
        x = (t or "").encode().lower().split()
        assert n == (len({tuple(x[i : i + 5]) for i in range(len(x) - 4)}) if len(x) > 4 else bool(x))


def test_chunks_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(texts()), pa.array(range(len(texts())))], names=["text", "i"])
    got = [x for c in chunks([batch], limit=100) for x in c.column("i").to_pylist()]
    assert got == list(range(len(texts())))
