"""Runs of words, against plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pulsepress.llm import periods
from pulsepress.llm.registered import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every run (start, length, period), by start and length."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted((*x, q) for x, q in found.items())


def _collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _runs(words, least):
    found = periods.find_runs(np.array([*words, -1]), least)
    return [(s, e - s, q) for s, e, q in zip(*(x.tolist() for x in found), strict=True)]


@pytest.mark.parametrize("least", [1, 5, 12])
def test_runs_of_random_words(least):
    draw = random.Random(least)
    for _ in range(600):
        n, k = draw.randint(0, 90), draw.choice([1, 2, 2, 3, 5])
        words = [draw.randrange(k) for _ in range(n)]
        if n > 3 and draw.random() < 0.6:
            a = draw.randrange(n)
            q = draw.randint(1, max(1, (n - a) // 2))
            words = [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]
            words[draw.randrange(n)] = draw.randrange(k)
        assert _runs(words, least) == brute(words, least)


def test_runs_of_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert _runs(b, 12) == brute(b)
    assert _runs([3] * 30_000, 12) == [(0, 30_000, 1)]


def test_every_period_has_blocks_that_find_it():
    for least in (1, 2, 12, 13):
        seen = {q for level in range(12) for near, far in periods.windows(level, least) for q in range(near, far + 1)}
        assert set(range(1, 1000)) <= seen
        for level in range(12):
            for near, far in periods.windows(level, least):
                assert far - near < 1 << level
                assert all(max(least, 2 * q) - q >= 2 * (1 << level) - 1 for q in range(near, far + 1))


def test_wavelet_matrix_counts_and_finds():
    draw = np.random.default_rng(5)
    values = draw.permutation(300)
    matrix = periods.WaveletMatrix(values)
    lo = draw.integers(0, 299, 200)
    hi = lo + 1 + draw.integers(0, 300 - lo)
    limit = draw.integers(0, 301, 200)
    assert matrix.below(lo, hi, limit).tolist() == [(values[a:b] < x).sum() for a, b, x in zip(lo, hi, limit, strict=True)]
    k = draw.integers(0, hi - lo)
    assert matrix.smallest(lo, hi, k).tolist() == [np.sort(values[a:b])[x] for a, b, x in zip(lo, hi, k, strict=True)]


def test_names_extend_both_ways():
    draw = random.Random(6)
    text = [draw.randrange(2) for _ in range(200)] + [9]
    names = periods.Names(np.array(text))
    assert [text[i:] for i in names.array] == sorted(text[i:] for i in range(201))
    i, j = np.array([(a, b) for a in range(0, 200, 7) for b in range(a + 1, 200, 11)]).T

    def ahead(a, b):
        n = 0
        while b + n < 201 and text[a + n] == text[b + n]:
            n += 1
        return n

    def behind(a, b):
        n = 0
        while a - n - 1 >= 0 and text[a - n - 1] == text[b - n - 1]:
            n += 1
        return n

    assert names.ahead(i, j).tolist() == [ahead(*x) for x in zip(i, j, strict=True)]
    assert names.behind(i, j).tolist() == [behind(*x) for x in zip(i, j, strict=True)]


def test_rows_stand_for_themselves(rows):
    part = "a b c " * 5
    texts = [None, "", " \n", part, part, f"x y\x1cz {part}q", "one " * 3000, part.strip() + "\t" + part, "a b c a b c"]
    schema = "doc_id long, text string, runs string, n_words string, row string"
    df = rows(schema, *[(i % 8, t, "r", "n", "o") for i, t in enumerate(texts)], (None, part, None, None, None))
    got = periods.periodic_runs(df, ["doc_id", "row"]).collect()
    want = []
    for i, t in [*enumerate(texts), (None, part)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute(words) if len(words) < 1000 else [(0, 3000, 1)]
        want.append((None if i is None else i % 8, None if i is None else "o", len(words), found, _collapsed(words, found)))
    own = [(x.doc_id, x.row, x.n_words, [tuple(r) for r in x.runs], x.collapsed) for x in got]
    assert sorted(map(repr, own)) == sorted(map(repr, want))
    assert periods.periodic_runs(df.limit(0), ["doc_id"]).count() == 0


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: x for x in QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    looped = 0
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            looped += 1
        found = brute(words)
        x = got[doc_id]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert x.n_runs == len(found)
        if best:
            assert (x.start, x.length, x.period) == best and x.exponent_milli == 1000 * best[1] // best[2]
        else:
            assert x.start is x.length is x.period is x.exponent_milli is None
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(_collapsed(words, found).encode()).hexdigest()
    assert looped > 5
