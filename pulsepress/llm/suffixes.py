"""Suffix arrays of byte strings in numpy: of all suffixes by induced sorting, with common prefixes of
neighbours, and of those alone whose first bytes occur again, by doubling."""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last counts as larger than nothing."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    up = text[:-1] < text[1:]
    differs = text[:-1] != text[1:]
    # In a run of equal bytes the first difference behind it decides; a run at the end is large.
    at = np.where(differs, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out[:-1] = np.append(up, False)[at]
    return out


def leftmost_smaller(small: np.ndarray) -> np.ndarray:
    """Positions of small suffixes behind a large one."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def induce(text: np.ndarray, small: np.ndarray, sorted_starts: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in order.

    Buckets are the first bytes. Large suffixes are placed in ascending passes, each in front of the
    places left in its bucket, then small ones in descending passes from the back. A bucket's
    new entries are handled together; those that fall into the same bucket make its next turn.
    """
    n = len(text)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    starts = ends - counts
    order = np.full(n, -1, np.int32)
    # Leftmost smaller suffixes, in order, by bucket.
    seeds: list[np.ndarray] = [np.empty(0, np.int32)] * 256
    if len(sorted_starts):
        first = text[sorted_starts]
        by = np.argsort(first, kind="stable")
        cuts = np.searchsorted(first[by], np.arange(257))
        seeds = [sorted_starts[by[cuts[c] : cuts[c + 1]]].astype(np.int32) for c in range(256)]

    def before(entries: np.ndarray, want_small: bool) -> tuple[np.ndarray, np.ndarray]:
        previous = entries[entries > 0] - 1
        previous = previous[small[previous] == want_small]
        return previous, text[previous]

    heads = starts.copy()

    def place_up(previous: np.ndarray, first: np.ndarray) -> None:
        by = np.argsort(first, kind="stable")
        previous, first = previous[by], first[by]
        k = np.bincount(first, minlength=256)
        inside = np.arange(len(first)) - (np.cumsum(k) - k)[first]
        order[heads[first] + inside] = previous
        heads[:] += k

    # The last suffix is followed by nothing, the least of all, so it is the first to be placed.
    place_up(np.array([n - 1], np.int32), text[-1:])
    for c in np.flatnonzero(counts).tolist():
        done = starts[c]
        while done < heads[c]:
            entries = order[done : heads[c]].copy()
            done = heads[c]
            place_up(*before(entries, False))
        place_up(*before(seeds[c], False))

    tails = ends.copy()

    def place_down(previous: np.ndarray, first: np.ndarray) -> None:
        by = np.argsort(first, kind="stable")
        previous, first = previous[by], first[by]
        k = np.bincount(first, minlength=256)
        inside = np.arange(len(first)) - (np.cumsum(k) - k)[first]
        order[tails[first] - 1 - inside] = previous
        tails[:] -= k

    for c in np.flatnonzero(counts)[::-1].tolist():
        done = ends[c]
        while done > tails[c]:
            entries = order[tails[c] : done][::-1].copy()
            done = tails[c]
            place_down(*before(entries, True))
        place_down(*before(order[starts[c] : heads[c]][::-1].copy(), True))
    return order


def _names(text: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the substrings from one start to the next, equal for equal ones, in their order."""
    n = len(text)
    place = np.full(n, -1, np.int32)
    place[starts] = np.arange(len(starts), dtype=np.int32)
    ranked = order[place[order] >= 0]
    index = place[ranked]
    stop = np.append(starts[1:], n - 1)[index]
    length = stop - ranked + 1
    same = length[1:] == length[:-1]
    same &= index[1:] != len(starts) - 1
    same &= index[:-1] != len(starts) - 1
    alive = np.flatnonzero(same)
    step = 0
    while len(alive):
        open_ = step < length[alive]
        alive = alive[open_]
        if not len(alive):
            break
        differ = text[ranked[alive] + step] != text[ranked[alive + 1] + step]
        same[alive[differ]] = False
        alive = alive[~differ]
        step += 1
    name = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(starts), np.int64)
    names[index] = name
    return names, int(name[-1]) + 1 if len(name) else 0


def _sorted_names(names: np.ndarray, count: int, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, exact over the first ``depth`` names at least.

    The order of pieces of h names gives that of pieces of 2 h, until all differ.
    """
    rank, h = names, 1
    n = len(names)
    while count < n and h < depth:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        count = int(fresh[-1]) + 1
        h *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (bytes) in order, exact over their first ``depth`` bytes at least.

    Suffixes are classified; the leftmost smaller ones are sorted by their substrings, which become
    names of a string half as long at most; that string's order gives theirs; all others follow by
    induction, in linear work.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = types(text)
    starts = leftmost_smaller(small)
    if len(starts) > 1:
        names, count = _names(text, induce(text, small, starts), starts)
        # Leftmost smaller suffixes are two bytes apart or more.
        starts = starts[_sorted_names(names, count, depth // 2 + 2)]
    return induce(text, small, starts)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """By position: bytes that a suffix shares with the one before it in order, ``depth`` at most."""
    n = len(text)
    shared = np.zeros(n, np.int32)
    if n < 2:
        return shared
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", buffer=padded.tobytes(), strides=(1,))
    left, right = order[:-1], order[1:]
    room = n - np.maximum(left, right)
    alive = np.arange(n - 1)
    step = 0
    while len(alive) and step < depth:
        alive = alive[room[alive] >= step + 8]
        equal = words[left[alive] + step] == words[right[alive] + step]
        alive = alive[equal]
        step += 8
        shared[right[alive]] = step
    # What is left below eight bytes.
    for _ in range(7):
        at = np.flatnonzero((shared[right] < depth) & (room > shared[right]))
        if not len(at):
            break
        k = shared[right[at]]
        equal = text[left[at] + k] == text[right[at] + k]
        open_ = at[equal]
        if not len(open_):
            break
        shared[right[open_]] += 1
    return np.minimum(shared, depth)


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of successive numbers."""
    cuts = np.flatnonzero(at[1:] != at[:-1] + 1)
    return at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]


def repeated_suffixes(text: np.ndarray, valid: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of the suffix array whose first ``depth`` bytes (8 or more) occur again, and runs of equal ones.

    Only starts marked in ``valid`` count; each must have ``depth`` bytes behind it. Starts come in the
    order of these bytes, with a number that equal ones share. The order of pieces of h bytes gives
    that of pieces of 2 h. A piece that occurs once rules out every start whose bytes hold it, so
    pieces that belong to such starts alone are not sorted any further.
    """
    n, width = len(text), 0
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), ">u8", buffer=padded.tobytes(), strides=(1,))
    rank, top = np.zeros(n, np.int64), 0
    starts = np.flatnonzero(valid)
    while len(starts) and width < depth:
        wider = min(2 * width, depth) if width else 8
        # Pieces within the bytes of a start that is left.
        first, last = _stretches(starts)
        ends = np.zeros(n + 1, np.int32)
        np.add.at(ends, first, 1)
        np.add.at(ends, last + depth - wider + 1, -1)
        at = np.flatnonzero(np.cumsum(ends[:-1]) > 0)
        key = rank[at] * (top + 1) + rank[at + wider - width] if width else words[at].astype(np.uint64)
        by = np.argsort(key)
        key = key[by]
        number = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        rank[at[by]] = number
        top = int(number[-1])
        once = np.zeros(n + 1, np.int32)
        once[at[by][(np.bincount(number) == 1)[number]] + 1] = 1
        once = np.cumsum(once)
        starts = starts[once[starts + depth - wider + 1] == once[starts]]
        width = wider
    starts = starts[np.argsort(rank[starts], kind="stable")]
    return starts, rank[starts]
