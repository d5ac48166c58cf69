"""The order of string starts in a shard, against brute force, and the work it takes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pulsepress.llm import suffixes


@pytest.mark.parametrize("depth", [8, 13, 32, 64, 203])
def test_repeated_suffixes_are_those_of_a_sort(depth):
    draw = random.Random(depth)
    for turn in range(40):
        noise = bytes(97 + draw.randrange(draw.choice((1, 2, 26))) for _ in range(draw.randint(0, 900)))
        at = draw.randint(0, len(noise))
        text = noise + noise[at : at + draw.randint(0, 2 * depth)] + bytes(draw.randrange(256) for _ in range(turn))
        valid = np.array([i + depth <= len(text) and draw.random() < 0.9 for i in range(len(text))], bool)
        strings = {i: text[i : i + depth] for i in np.flatnonzero(valid).tolist()}
        known = list(strings.values())
        counts = {x: known.count(x) for x in set(known)}
        want = sorted((i for i in strings if counts[strings[i]] > 1), key=lambda i: (strings[i], i))
        starts, run = suffixes.repeated_suffixes(np.frombuffer(text, np.uint8), valid, depth)
        assert starts.tolist() == want
        assert [a == b for a, b in zip(run, run[1:])] == [strings[a] == strings[b] for a, b in zip(want, want[1:])]


def test_starts_of_strings_that_occur_once_are_not_sorted_on(monkeypatch):
    draw = np.random.default_rng(3)
    text = draw.integers(97, 123, 50_000, np.uint8)
    text[30_000:30_500] = text[1_000:1_500]
    sizes, argsort = [], np.argsort

    def counted(x, **how):
        sizes.append(len(x))
        return argsort(x, **how)

    monkeypatch.setattr(suffixes.np, "argsort", counted)
    starts, _ = suffixes.repeated_suffixes(text, np.arange(len(text)) + 400 <= len(text), 400)
    assert sorted(starts.tolist()) == [*range(1_000, 1_101), *range(30_000, 30_101)]
    assert sum(sizes) < 1.2 * len(text)
