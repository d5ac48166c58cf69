"""Runs of words: stretches that go on repeating their first words.

Texts of a batch are numbered word by word, closed by words of their own, and share one suffix array.
It is built by doubling, and every doubling names the stretches of 1, 2, 4, ... words. A run of period q
holds a dyadic block (its length a power of two, its start a multiple of it) that occurs again q words
on, so each block asks for its occurrences in the windows behind it: a wavelet matrix over the suffix
array counts those between two positions and finds the first and the last. Within a window not longer
than the block they are an arithmetic progression, whose members are candidate periods. A candidate
counts when the stretch that keeps it, extended both ways by the names, is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from pulsepress.llm.texts import in_pieces

#: Fewest words of a run.
LEAST = 12


class Names:
    """Suffix array of numbers, and for each power of two the names of the stretches so long.

    The last number must occur once. A name is the place of the first equal stretch in the array, so
    the stretches of a name take the places from it on.
    """

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        ranked = numbers[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if n else np.empty(0, np.int64)
        name = np.empty(n, np.int64)
        name[order] = np.repeat(first, np.diff(np.append(first, n)))
        self.array, self.levels = order, [name.astype(np.int32)]
        width = 1
        while True:
            # A stretch that reaches behind the end holds the last number, so it has no equal.
            often = np.bincount(name, minlength=n)[name] > 1
            open_ = np.flatnonzero(often)
            if not len(open_):
                break
            key = name[open_] * n + name[open_ + width]
            by = np.argsort(key)
            key, at = key[by], open_[by]
            old = name[at]
            new = np.append(True, key[1:] != key[:-1])
            group = np.append(True, old[1:] != old[:-1])
            index = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(group, index, 0))
            self.array[old + index - begin] = at
            name = name.copy()
            name[at] = old + np.maximum.accumulate(np.where(new, index, 0)) - begin
            self.levels.append(name.astype(np.int32))
            width *= 2

    def sizes(self, level: int) -> np.ndarray:
        """By name: how many stretches have it."""
        return np.bincount(self.levels[level], minlength=len(self.array))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers agree from ``i`` and from ``j`` (larger) on."""
        done, last = np.zeros(len(i), np.int64), len(self.array) - 1
        for level in reversed(range(len(self.levels))):
            names = self.levels[level]
            at = j + done
            done += (names[np.minimum(i + done, last)] == names[np.minimum(at, last)]).astype(np.int64) * (at <= last) << level
        return done

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers agree in front of ``i`` and of ``j`` (larger)."""
        done = np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.levels))):
            names, step = self.levels[level], 1 << level
            at = i - done - step
            done += (names[np.maximum(at, 0)] == names[np.maximum(j - done - step, 0)]).astype(np.int64) * (at >= 0) << level
        return done


class WaveletMatrix:
    """Positions by their bits, highest first, to count and find them within parts of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, len(values).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.append(0, np.cumsum(~one)).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of each part from ``lo`` to ``hi`` are less than ``limit`` (at most their number)."""
        count = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (limit >> (self.bits - 1 - level) & 1).astype(bool)
            low, high = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            count += np.where(one, high - low, 0)
            lo, hi = np.where(one, zeros[-1] + lo - low, low), np.where(one, zeros[-1] + hi - high, high)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of each part from ``lo`` to ``hi`` that ``k`` others of it are less than."""
        value = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            low, high = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = k >= high - low
            value += one.astype(np.int64) << (self.bits - 1 - level)
            k = np.where(one, k - (high - low), k)
            lo, hi = np.where(one, zeros[-1] + lo - low, low), np.where(one, zeros[-1] + hi - high, high)
        return value


def windows(level: int, least: int) -> list[tuple[int, int]]:
    """Distances (both ends included) at which blocks of a level look for themselves.

    A run of period q has at least max(least, 2 q) - q places whose number comes again q on, and twice
    a block's length less one of them hold a whole block. Each period goes to the longest blocks that
    are always held; a window has no more distances than a block is long.
    """
    size = 1 << level

    def level_of(q: int) -> int:
        return ((max(least, 2 * q) - q + 1) // 2).bit_length() - 1

    # Periods of the longest blocks below ``least`` words are not in one piece.
    fit = [q for q in range(1, max(least, 4 * size) + 1) if level_of(q) == level]
    parts: list[tuple[int, int]] = []
    for q in fit:
        if parts and parts[-1][1] == q - 1 and q - parts[-1][0] < size:
            parts[-1] = (parts[-1][0], q)
        else:
            parts.append((q, q))
    return parts


def _progressions(names: Names, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block starts and candidate periods."""
    matrix, n = None, len(names.array)
    for level in range(len(names.levels)):
        size = 1 << level
        starts = np.arange(0, n - size + 1, size)
        name = names.levels[level][starts].astype(np.int64)
        often = names.sizes(level)[name]
        again = often > 1
        starts, lo, hi = starts[again], name[again], (name + often)[again]
        for near, far in windows(level, least):
            if not len(starts):
                break
            if near == far:
                # One place only.
                at = starts + near
                same = (at < n) & (names.levels[level][np.minimum(at, n - 1)] == lo)
                yield starts[same], np.full(int(same.sum()), near)
                continue
            if matrix is None:
                matrix = WaveletMatrix(names.array)
            before = matrix.below(lo, hi, np.minimum(starts + near, n))
            count = matrix.below(lo, hi, np.minimum(starts + far + 1, n)) - before
            hit = count > 0
            i, a, b, before, count = (x[hit] for x in (starts, lo, hi, before, count))
            first = matrix.smallest(a, b, before)
            last = matrix.smallest(a, b, before + count - 1)
            step = (last - first) // np.maximum(count - 1, 1)
            # Three occurrences: the block itself has their step as its period. Where that goes on up
            # to them, their distances are multiples of it; only the step itself can be a smallest period.
            many = count > 2
            goes_on = np.zeros(len(i), bool)
            goes_on[many] = names.ahead(i[many], i[many] + step[many]) >= (first + size - i - step)[many]
            count = np.where(goes_on, first - i == step, count)
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(i, count)
            yield start, np.repeat(first, count) + inside * np.repeat(step, count) - start


def find_runs(numbers: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and smallest period of every run, by start and stop. The last number must occur once.

    A run has at least ``least`` numbers and twice its period, and no neighbour extends it.
    """
    names = Names(numbers)
    found = []
    for start, period in _progressions(names, least):
        a = start - names.behind(start, start + period)
        b = start + period + names.ahead(start, start + period)
        long = b - a >= np.maximum(least, 2 * period)
        if long.any():
            found.append(np.unique(np.stack([a[long], b[long], period[long]], 1), axis=0))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    every = np.unique(np.concatenate(found), axis=0)
    # Of the periods of one stretch the smallest.
    new = np.append(True, (every[1:, 0] != every[:-1, 0]) | (every[1:, 1] != every[:-1, 1]))
    return every[new, 0], every[new, 1], every[new, 2]


_RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, a number of its own behind each text, and where texts start."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    out = np.empty(starts[-1], np.int64)
    for at, words in zip(starts.tolist(), texts, strict=False):
        out[at : at + len(words)] = [number(w, len(known)) for w in words]
    out[starts[1:] - 1] = len(known) + np.arange(len(texts))
    return out, starts


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST) -> DataFrame:
    """Columns ``keep`` of every row with ``n_words``, its ``runs`` and the ``collapsed`` text.

    Words are parted by ASCII white space and numbered from 0. ``runs`` (start, length, period) are
    sorted by start and length. ``collapsed`` has the words that no run contains behind its first
    period, joined by one space. A NULL or empty text has no words and no runs; repeated rows and
    columns of any name stand for themselves. The work on a text of n words is n log n, in memory
    of n log n numbers.
    """
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    narrow = docs.select(row, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = StructType([StructField("row", narrow.schema["row"].dataType), *StructType.fromDDL(_RUNS).fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 1):
                # bytes.split() parts at just the six characters of ASCII white space.
                texts = [x.split() for x in piece.column(1).to_pylist()]
                numbers, starts = _numbered(texts)
                begin, stop, period = find_runs(numbers, least)
                of = np.searchsorted(starts, begin, side="right") - 1
                edge = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(edge, begin + period, 1)
                np.add.at(edge, stop, -1)
                dropped = np.cumsum(edge) > 0
                runs: list[list[tuple]] = [[] for _ in texts]
                own = zip(of.tolist(), (begin - starts[of]).tolist(), (stop - begin).tolist(), period.tolist(), strict=True)
                for doc, *x in own:
                    runs[doc].append(tuple(x))
                kept = []
                for at, words, found in zip(starts.tolist(), texts, runs, strict=False):
                    if found:
                        words = [w for w, gone in zip(words, dropped[at : at + len(words)].tolist(), strict=True) if not gone]
                    kept.append(b" ".join(words))
                values = [
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], types.field(2).type),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(types.field(0).type), *values], names=types.names)

    return narrow.mapInArrow(run, schema).select("row.*", "n_words", "runs", "collapsed")
