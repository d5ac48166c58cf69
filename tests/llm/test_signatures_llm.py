"""Signatures of shingle sets lose no link, and what they spare where there are many near copies."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from pulsepress.llm import jaccard


def _sets(draw: random.Random, n: int) -> list[np.ndarray]:
    random_ = np.random.default_rng(draw.random().as_integer_ratio()[0] % 2**32)
    base = random_.integers(0, 2**64, n, np.uint64, endpoint=False)
    sets = []
    for _ in range(40):
        own = base.copy()
        changed = random_.random(n) < draw.choice((0.01, 0.1, 0.12, 0.3))
        own[changed] = random_.integers(0, 2**64, int(changed.sum()), np.uint64)
        sets.append(np.unique(own))
    return sets


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y))
    return 100 * shared >= 80 * (len(x) + len(y) - shared)


def test_pairs_of_a_list_hold_every_link_and_few_others():
    draw = random.Random(8)
    for n in (25, 150, 400, 1030):  # some of the last have a signature, some are too large
        sets = sorted(_sets(draw, n), key=len)
        count = len(sets)
        columns = {
            "token": [7] * count, "i": [0] * count, "j": [0] * count, "block": [0] * count, "set": range(count),
            "n": [len(x) for x in sets], "pos": [0] * count, "root": range(count),
            "signature": [jaccard.signature(x) for x in sets],
        }
        batch = pa.RecordBatch.from_pydict({k: pa.array(list(v)) for k, v in columns.items()})
        half = batch.slice(0, count // 2), batch.slice(count // 2)  # a piece may go on in the next batch
        got = {(a, b) for x in jaccard._cross_pairs(iter(half)) for a, b in zip(*(c.to_pylist() for c in x.columns))}
        every = {(a, b) for a in range(count) for b in range(a + 1, count)}
        links = {(a, b) for a, b in every if _linked(sets[a], sets[b])}
        assert links and links <= got
        assert n > 1000 or len(got - links) < 0.2 * len(every - links)


def test_entries_get_the_pivots_that_one_pass_would_give():
    draw = random.Random(2)
    rows = [(draw.randrange(40), draw.randrange(300)) for _ in range(400)]
    rows = sorted({(token, 10 + one * 7 % 50, one) for token, one in rows})
    want = []
    for token in sorted({x[0] for x in rows}):
        own = [x for x in rows if x[0] == token]
        pivot = own[0]
        for x in own:
            if 80 * x[1] > 100 * pivot[1]:
                pivot = x
            if len(own) > 1:
                want.append((*x, x[2] % 9, pivot[2], pivot[1], pivot[2] % 9))
    doubled = [x for x in rows for _ in range(1 + x[2] % 2)]
    columns = [*zip(*doubled, strict=True), [x[2] % 9 for x in doubled]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "n", "set", "pos"])
    parts = [batch.slice(i, 37) for i in range(0, batch.num_rows, 37)]
    got = [x for out in jaccard._shared(iter(parts)) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert got == want


def test_many_near_copies_are_not_paired_in_full(spark, monkeypatch):
    draw = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in draw.sample(range(len(words)), 3):
            words[at] = f"x{draw.random()}"
        rows.append((i, " ".join(words)))
    tried, tested = [], jaccard.tested

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return tested(pairs, *rest)

    monkeypatch.setattr(jaccard, "tested", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(df).collect()}
    shingles = jaccard.Shingler()
    sets = [shingles(t) for _, t in rows]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if want[a] != want[b] and _linked(sets[a], sets[b]):
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert got == dict(enumerate(want))
    assert sum(tried) < 40 * len(rows)  # fronts and whole sets; all pairs are 199.5 to a row, twice
