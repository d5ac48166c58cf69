"""Similarity join of documents on word shingles, by a size-aware split into light and heavy sets.

Sets of equal content count once. Light (small) sets are joined by enumerating their subsets of the
size that two linked sets must share: equal subsets are links, no further test is needed. Heavy sets
meet in inverted lists of the shingles at the front of a common order, in which frequent shingles
come last. The boundary is the size at which enumerating costs more than scanning lists.

Lists are scanned more than once. First each member is paired with a pivot of its list, in work
linear in the list. Pairs that their fronts allow make guessed components, which are joined by random
pairs of long lists, a few of each set; members of guesses that are still different are paired with each other. Where
whole sets break a guess up, its parts are treated in the same way. Pairs are thinned by what fronts and
signatures allow at most, and compared by their whole sets. A signature says of every class of
shingles whether the set holds an odd number of them: where two differ, the sets differ in a shingle at
least. Bounds and comparisons are exact, no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, count
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepress.llm.common import drop, drop_others, new_folder, stored
from pulsepress.llm.components import components
from pulsepress.llm.texts import map_texts

WORDS = 5
#: Linked: 100 * intersection >= 80 * union.
PART, WHOLE = 80, 100
#: Sets up to this size keep all of their shingles in the list table and may be enumerated.
MOST_LIGHT = 20
#: Cost of one entry of an inverted list, in subsets enumerated.
LIST_COST = 8.0
#: Shingles placed last in the common order: at most so many, found in a sample of 1 / SAMPLE of all
#: texts at least FREQUENT times. Any choice gives the same links; a good one gives short lists.
MOST_FREQUENT, SAMPLE, FREQUENT = 200_000, 16, 4
#: Rows of a list compared in one piece, pairs of one pivot in one task, pairs in one task.
LIST_BLOCK, PIVOT_PAIRS, TILE_PAIRS = 4096, 2000, 2000
MEMORY, WORD_LIMIT = 400_000, 64
#: Long numbers of 64 bits in a signature.
SIGNATURE = 8
#: Larger sets have a signature of zeros, which rules nothing out: half of the bits differ in any case.
SIGNED = 128 * SIGNATURE
#: Lists of more sets are joined by random pairs before their sets are paired in full.
LONG_LIST = 64
#: Partners of a set in one random order. Orders go on while more than one of so many pairs is a link.
NEIGHBOURS, LEAST_SHARE = 4, 10

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def needed(n: int, m: int) -> int:
    """Shingles that sets of sizes n and m share at least when they are linked."""
    return -(-PART * (n + m) // (WHOLE + PART))


def smallest(n: int) -> int:
    """The smallest size of a set that can be linked with one of size n."""
    return -(-PART * n // WHOLE)


def front(n: int) -> int:
    """How many shingles at the front of the order two linked sets cannot both avoid sharing."""
    return n - smallest(n) + 1 if n else 0


class Shingler:
    """Sorted, distinct 64-bit hashes of the five-word shingles of a text."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= WORD_LIMIT:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        # Lower-cases A-Z and parts at ASCII white space only, as bytes do.
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        hashes = np.array([known.get(w) or self._hash(w) for w in words], np.uint64)
        n = len(hashes)
        if n < WORDS:
            mixed = (hashes * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + _FACTORS[-1:] * np.uint64(n)
        else:
            mixed = np.zeros(n - WORDS + 1, np.uint64)
            for i in range(WORDS):
                mixed += hashes[i : n - WORDS + 1 + i] * _FACTORS[i]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def frequent_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Frequent shingles of a sample of the texts, rarest first; at most ``MOST_FREQUENT``."""
    sampled = docs.select(F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    sampled = sampled.filter(F.pmod("hash", F.lit(SAMPLE)) == 0)

    def make():
        shingles, seen = Shingler(), set()

        def once(t: str) -> tuple:
            found = shingles(t).view(np.int64)
            key = hash(found.tobytes())
            if key in seen:
                return ([],)
            seen.add(key)
            return (found,)

        return once

    rows = map_texts(sampled, ["hash"], "text", make, "shingles array<bigint>")
    counts = rows.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    counts = counts.filter(F.col("count") >= FREQUENT).orderBy(F.col("count").desc(), "shingle").limit(MOST_FREQUENT)
    rows = counts.toArrow().to_pydict()
    order = np.lexsort((rows["shingle"], rows["count"]))
    return np.array(rows["shingle"], np.int64)[order]


def set_hash(shingles: np.ndarray) -> int:
    """64-bit hash of a set's content."""
    digest = hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bit for every class of shingles, the rest of their hashes: whether the set holds an odd number of them."""
    if len(shingles) > SIGNED:
        return np.zeros(SIGNATURE, np.int64)
    bits = 64 * SIGNATURE
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, id: str, text: str, last: np.ndarray) -> DataFrame:
    """id, text_hash, n, set, content, signature and the front of the set's order (all of it for a small set).

    ``set`` numbers the different sets of a task, ``content`` is a hash of the set. Within a task only
    the first of several equal sets carries its front and signature.
    """
    narrow = docs.select(F.col(id), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    by_value = np.argsort(last)
    values, places = last[by_value], by_value + 1

    def make():
        from pyspark import TaskContext

        shingles, seen = Shingler(), {}
        base = TaskContext.get().partitionId() << 40

        def describe(t: str) -> tuple:
            found = shingles(t)
            n = len(found)
            if not n:
                return 0, None, None, None, None
            content = set_hash(found)
            if content in seen:
                return n, seen[content], content, None, None
            number = seen[content] = base | len(seen)
            bits = signature(found)
            found = found.view(np.int64)
            place = np.zeros(n, np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                place = np.where(values[at] == found, places[at], 0)
            order = np.lexsort((found, place))
            return n, number, content, bits, found[order[: n if n <= MOST_LIGHT else front(n)]]

        return describe

    return map_texts(narrow, [id, "text_hash"], "text", make, "n bigint, set bigint, content bigint, signature array<bigint>, front array<bigint>")


def boundary(sizes: dict[int, int], heavier: int) -> int:
    """The largest size to enumerate, the one of least cost.

    ``sizes`` counts the sets of each size up to ``MOST_LIGHT``, ``heavier`` the list entries of
    the others, which are scanned whatever the boundary.
    """

    def subsets(n: int, most: int) -> int:
        return sum(comb(n, needed(n, m)) for m in range(smallest(n), n * WHOLE // PART + 1) if m <= most)

    def cost(most: int) -> float:
        light = sum(k * subsets(n, most) for n, k in sizes.items() if n <= most)
        listed = sum(k * front(n) for n, k in sizes.items() if n >= smallest(most + 1))
        return light + LIST_COST * (listed + heavier)

    return min(range(MOST_LIGHT + 1), key=cost)


def light_links(sets: DataFrame, most: int, folder: str) -> DataFrame:
    """Links (a, b) between sets of at most ``most`` shingles that hold every component together.

    A key is a subset with the two sizes it links. Sets of equal size that share a key are linked;
    of different sizes, each is linked with every one of the other size. One link to the least
    of them says as much.
    """

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, large = [], []
                ordered = [x.to_bytes(8, "little", signed=True) for x in sorted(shingles)]
                for m in range(smallest(n), n * WHOLE // PART + 1):
                    if m <= most:
                        name = bytes((min(n, m), max(n, m)))
                        found = [xxhash.xxh64_intdigest(name + b"".join(c)) for c in combinations(ordered, needed(n, m))]
                        keys += found
                        large += [n >= m] * len(found) if n != m else [None] * len(found)
                array = np.array(keys, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(array), pa.array([key] * len(keys), pa.int64()), pa.array(large, pa.bool_())],
                    names=["key", "set", "large"],
                )

    small = sets.filter((F.col("n") <= most) & F.col("front").isNotNull()).select("set", "n", "front")
    rows = small.dropDuplicates(["set"]).mapInArrow(enumerate_subsets, "key bigint, set bigint, large boolean")
    rows = stored(rows, folder, "subsets")
    large = F.col("large")
    least = rows.groupBy("key").agg(
        F.min(F.when(large.isNull(), F.col("set"))).alias("same"),
        F.min(F.when(large, F.col("set"))).alias("above"),
        F.min(F.when(~large, F.col("set"))).alias("below"),
        F.count(F.lit(1)).alias("members"),
    )
    joined = rows.join(least.filter("members > 1"), "key")
    other = F.when(large.isNull(), F.col("same")).when(large, F.col("below")).otherwise(F.col("above"))
    links = joined.select(F.col("set").alias("a"), other.alias("b"))
    return links.filter(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()


_LISTED = "token bigint, n bigint, set bigint, pos int, pivot bigint, pivot_n bigint, pivot_pos int"


def _first(columns: np.ndarray) -> np.ndarray:
    """Places whose values differ from those before them."""
    differs = (columns[:, 1:] != columns[:, :-1]).any(0)
    return np.flatnonzero(np.concatenate([[True], differs]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of lists with two sets or more, each with a pivot, from entries sorted by token, n, set.

    A list's pivot is its first entry; where sizes get too far apart for a link, a new one follows.
    Entries stream by; one list is held as a whole, in 32 bytes an entry.
    """
    names = [x.split()[0] for x in _LISTED.split(", ")]
    rest = np.empty((4, 0), np.int64)

    def listed(rows: np.ndarray) -> pa.RecordBatch:
        token, n, one, pos = rows[:, _first(rows[[0, 2]])]
        begin = _first(token[None])
        sizes = np.diff(np.append(begin, len(token)))
        shared = np.repeat(sizes > 1, sizes)
        token, n, one, pos = token[shared], n[shared], one[shared], pos[shared]
        # Pivots: the first entries of lists, and where sizes get too far from a pivot's, the next ones.
        sizes = sizes[sizes > 1]
        pivot = np.repeat(np.cumsum(sizes) - sizes, sizes)
        while True:
            far = np.flatnonzero(PART * n > WHOLE * n[pivot])
            if not len(far):
                break
            # The first entry of each pivot that is too far from it leads those behind.
            far = far[_first(pivot[far][None])]
            lead = pivot.copy()
            lead[far] = far
            pivot = np.maximum.accumulate(lead)
        columns = token, n, one, pos.astype(np.int32), one[pivot], n[pivot], pos[pivot].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for batch in batches:
        rest = np.concatenate([rest, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])], 1)
        if not rest.shape[1]:
            continue
        # The last list may go on.
        done = int(np.searchsorted(rest[0], rest[0, -1]))
        if done:
            yield listed(rest[:, :done])
            rest = rest[:, done:]
    if rest.shape[1]:
        yield listed(rest)


def heavy_lists(sets: DataFrame, most: int) -> DataFrame:
    """Inverted lists of the fronts of all sets that can be linked with one above the boundary."""
    heavy = sets.filter((F.col("n") >= smallest(most + 1)) & F.col("front").isNotNull())
    # The front's length: n less the smallest partner's size, and one more.
    length = (F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1).cast("int")
    fronts = F.when(F.col("n") <= MOST_LIGHT, F.slice("front", F.lit(1), length)).otherwise(F.col("front"))
    entries = heavy.select("n", "set", F.posexplode(fronts).alias("pos", "token"))
    entries = entries.select("token", "n", "set", "pos").repartition("token").sortWithinPartitions("token", "n", "set")
    return entries.mapInArrow(_shared, _LISTED)


def _may_link(n: Column, p: Column, m: Column, q: Column) -> Column:
    """Sizes close enough, and enough left behind a shingle at places p and q for a link."""
    rest = F.least(n - p, m - q)
    return (F.least(n, m) * WHOLE >= F.greatest(n, m) * PART) & (rest * (WHOLE + PART) >= (n + m) * PART)


def _differ(n: Column, m: Column, one: Column, other: Column) -> Column:
    """Whether signatures differ in no more places than two linked sets of these sizes can in shingles."""
    differ = sum((F.bit_count(one[i].bitwiseXOR(other[i])) for i in range(SIGNATURE)), F.lit(0))
    return (F.greatest(n, m) > SIGNED) | (differ <= n + m - 2 * F.ceil((n + m) * PART / (WHOLE + PART)))


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one list piece (token, i, j) whose sets are in different components and may be linked.

    Entries are sorted by piece and n, and each is compared with the one behind it, the next but one and so
    on, as far as sizes allow.
    """
    names = ["token", "i", "j", "block", "set", "n", "pos", "root"]
    kind = np.dtype([(x, np.int64) for x in names] + [("signature", np.uint64, SIGNATURE)])

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        piece = np.cumsum(np.concatenate([[True], rows[["token", "i", "j"]][1:] != rows[["token", "i", "j"]][:-1]]))
        block, n, pos, root = rows["block"], rows["n"], rows["pos"], rows["root"]
        halves = rows["i"] != rows["j"]
        x, step = np.arange(len(rows)), 0
        while len(x):
            step += 1
            x = x[x + step < len(rows)]
            y = x + step
            near = (piece[x] == piece[y]) & (PART * n[y] <= WHOLE * n[x])
            x, y = x[near], y[near]
            rest = np.minimum(n[x] - pos[x], n[y] - pos[y])
            size = n[x] + n[y]
            fits = (root[x] != root[y]) & (rest * (WHOLE + PART) >= size * PART)
            fits &= ~halves[x] | (block[x] != block[y])
            a, b, size = x[fits], y[fits], size[fits]
            if not len(a):
                continue
            differ = np.bitwise_count(rows["signature"][a] ^ rows["signature"][b]).sum(1, dtype=np.int64)
            may = (n[b] > SIGNED) | (differ <= size - 2 * -(-PART * size // (WHOLE + PART)))
            a, b = rows["set"][a[may]], rows["set"][b[may]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    rest = np.empty(0, kind)
    for batch in batches:
        rows = np.empty(batch.num_rows, kind)
        for x in names:
            rows[x] = batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False)
        bits = batch.column(batch.schema.get_field_index("signature")).flatten()
        # Of negative numbers numpy would count the bits of the absolute value.
        rows["signature"] = bits.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SIGNATURE)
        rows = np.concatenate([rest, rows])
        if not len(rows):
            continue
        # The last piece may go on.
        keys = rows[["token", "i", "j"]]
        done = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
        yield from pairs(rows[:done])
        rest = rows[done:].copy()
    yield from pairs(rest)


def _kept(pairs: list[tuple[int, int]]) -> pa.Table:
    columns = list(zip(*pairs, strict=True)) if pairs else [(), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def _linked(key, pairs, sets):
    """The pairs whose whole sets are similar enough."""
    content: dict[int, np.ndarray] = {}
    for one, data in zip(sets["set"].to_pylist(), sets["data"].to_pylist(), strict=True):
        content.setdefault(one, np.frombuffer(data, "<u8"))
    kept = []
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
        x, y = content[a], content[b]
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        shared = int((y[at] == x).sum())
        if shared * (WHOLE + PART) >= PART * (len(x) + len(y)):
            kept.append((a, b))
    return _kept(kept)


def _possible(key, pairs, sets):
    """The pairs that may be linked by their fronts: what these share, and what can follow.

    Shingles behind the last one that two fronts share can only be shared if there are enough of
    them on either side. And of the front that ends first in the order, what the other front does not
    share is missing from the other set, whose further shingles all come later.
    """
    content: dict[int, tuple] = {}
    for one, n, listed in zip(*(sets[c].to_pylist() for c in ("set", "n", "listed")), strict=True):
        content.setdefault(one, (n, {x["token"]: x["pos"] for x in listed}))
    kept = []
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
        (n, x), (m, y) = content[a], content[b]
        shared = x.keys() & y.keys()
        if not shared:
            continue
        i, j = max(x[t] for t in shared), max(y[t] for t in shared)
        behind = min(n - 1 - i, m - 1 - j, max(n - front(n), m - front(m)))
        if len(shared) + behind >= needed(n, m):
            kept.append((a, b))
    return _kept(kept)


def possible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that their signatures allow to be linked."""
    for end in ("a", "b"):
        own = signatures.select(F.col("set").alias(end), F.struct("n", "signature").alias(f"of_{end}"))
        pairs = pairs.join(own, end)
    n, m = F.col("of_a.n"), F.col("of_b.n")
    return pairs.filter(_differ(n, m, F.col("of_a.signature"), F.col("of_b.signature"))).select("a", "b")


def tested(pairs: DataFrame, content: DataFrame, test, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) that pass ``test``, which sees the rows of ``content`` of their sets; stored.

    Pairs are dealt into tiles by their first set; the pairs of a set that has very many are spread
    over several tiles. The rows of a set travel once to each tile that needs them.
    """
    pairs = stored(pairs, folder, f"{name}_pairs")
    tiles = max(1, -(-pairs.count() // TILE_PAIRS))
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > PIVOT_PAIRS)
    dealt = pairs.join(many, "a", "left").select(
        "a",
        "b",
        F.pmod(F.xxhash64("a"), F.lit(tiles)).alias("tile"),
        F.when(F.col("k").isNull(), 0)
        .otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / PIVOT_PAIRS)))
        .cast("long")
        .alias("part"),
    )
    dealt = stored(dealt, folder, f"{name}_dealt")
    to = F.col("tile").alias("to_tile"), F.col("part").alias("to_part")
    wanted = dealt.select(*to, F.explode(F.array("a", "b")).alias("set")).distinct()
    shipped = wanted.join(content, "set")
    together = dealt.groupBy("tile", "part").cogroup(shipped.groupBy("to_tile", "to_part"))
    passed = stored(together.applyInArrow(test, "a bigint, b bigint"), folder, f"{name}_passed")
    drop(pairs.sparkSession, folder, f"{name}_pairs", f"{name}_dealt")
    return passed


def set_contents(docs: DataFrame, text: str, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set`` and ``data``, the sorted hashes, of the wanted sets, from one text of each."""
    chosen = sets.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("text_hash").alias("text_hash"))
    texts = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # Texts are shuffled whatever the size of the wanted part, so that plans are alike at every size.
    texts = texts.hint("merge").join(chosen, "text_hash")

    def make():
        shingles, seen = Shingler(), set()

        def once(t: str) -> tuple:
            found = shingles(t)
            content = set_hash(found)
            if content in seen:
                return (None,)
            seen.add(content)
            return (found.astype("<u8").tobytes(),)

        return once

    rows = map_texts(texts, ["set"], "text", make, "data binary")
    return rows.filter(F.col("data").isNotNull())


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists with the root of each set, which is the set itself where it is linked with none."""
    known = lists.join(roots.withColumnRenamed("id", "set"), "set", "left")
    return known.select("token", "n", "set", "pos", F.coalesce("root", "set").alias("root"))


def _mixed(known: DataFrame) -> DataFrame:
    """The lists that hold sets of different roots, with their lengths ``k``."""
    ends = known.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("k")
    )
    return known.join(ends.filter("low <> high").select("token", "k"), "token")


def _cross(mixed: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a < b) of a list whose sets have different roots and may be linked, by place and signature."""
    pieces = mixed.join(signatures.select("set", "signature"), "set").withColumn("blocks", F.ceil(F.col("k") / LIST_BLOCK))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))
    pieces = pieces.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    pieces = pieces.select("token", i, j, "block", "set", "n", "pos", "root", "signature")
    pieces = pieces.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n")
    return pieces.mapInArrow(_cross_pairs, "a bigint, b bigint").distinct()


def _neighbours(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a < b) of sets of different roots that are close in a random order, and may be linked.

    The order is of the turn and the same for all lists, so that the lists two sets share give one pair.
    Long lists are ordered in pieces.
    """
    place = F.xxhash64("set", F.lit(turn))
    rows = mixed.withColumn("place", place)
    rows = rows.withColumn("piece", F.pmod("place", F.ceil(F.col("k") / LIST_BLOCK)))
    order = Window.partitionBy("token", "piece").orderBy("place", "set")
    own = F.struct("set", "n", "pos", "root")
    others = F.array(*[F.lead(own, i).over(order) for i in range(1, NEIGHBOURS + 1)])
    pairs = rows.withColumn("others", others).select("set", "n", "pos", "root", F.explode("others").alias("y"))
    fits = _may_link(F.col("n"), F.col("pos"), F.col("y.n"), F.col("y.pos")) & (F.col("root") != F.col("y.root"))
    return pairs.filter(fits).select(F.least("set", "y.set").alias("a"), F.greatest("set", "y.set").alias("b")).distinct()


def _joined(roots: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """The roots after further links, found from the links between components alone; stored."""
    of = roots.withColumnRenamed("root", "to")
    pairs = links.join(of.withColumnRenamed("id", "a"), "a", "left").withColumn("a", F.coalesce("to", "a")).drop("to")
    pairs = pairs.join(of.withColumnRenamed("id", "b"), "b", "left").withColumn("b", F.coalesce("to", "b")).drop("to")
    moved = components(pairs.select("a", "b").distinct(), f"{folder}/{name}_moved")
    after = roots.join(moved.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left")
    after = after.select("id", F.coalesce("to", "root").alias("root"))
    fresh = moved.join(roots.select("id"), "id", "left_anti").select("id", "root")
    joined = stored(after.unionByName(fresh), folder, name)
    drop(roots.sparkSession, folder, f"{name}_moved")
    return joined


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``id`` with n_shingles and component_id.

    A document's set holds its distinct five-word shingles, words being A-Z lower-cased and parted by
    ASCII white space; fewer words make one shingle. Two documents are linked where
    100 * intersection >= 80 * union. ``component_id`` is the smallest id reachable over links.
    A text without words (NULL too) has an empty set and is linked with nothing. Repeated rows
    and ids are rows each; a NULL id is never the smallest, a component of NULL ids alone has NULL.
    Shingles and sets are compared by 64-bit hashes.
    """
    folder, spark = new_folder(docs), docs.sparkSession
    plain = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sets = stored(shingle_sets(plain, id, "text", frequent_shingles(plain, "text")), folder, "sets")
    own = sets.filter(F.col("front").isNotNull())
    # Sizes up to a fixed one, and one sum.
    sizes = {x.n: x["count"] for x in own.filter(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    heavier = own.filter(F.col("n") > MOST_LIGHT).agg(F.sum(F.size("front"))).first()[0] or 0
    most = boundary(sizes, heavier)

    # Equal sets of different tasks: one stands for all.
    same = own.groupBy("content").agg(F.min("set").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    same = own.select("set", "content").join(same, "content").filter(F.col("set") != F.col("first"))
    same = stored(same.select("set", "first"), folder, "same")
    links = light_links(sets, most, folder).unionByName(same.select(F.col("set").alias("a"), F.col("first").alias("b")))
    links = stored(links, folder, "light")
    drop(spark, folder, "subsets")

    listed = stored(heavy_lists(sets, most), folder, "listed")
    listed = listed.join(same, "set", "left").withColumn("set", F.coalesce("first", "set")).drop("first")
    to = same.select(F.col("set").alias("pivot"), F.col("first").alias("to"))
    listed = listed.join(to, "pivot", "left").withColumn("pivot", F.coalesce("to", "pivot")).drop("to")
    listed = stored(listed.dropDuplicates(["token", "set"]), folder, "lists")
    drop(spark, folder, "listed", "same")
    lists = listed.select("token", "n", "set", "pos")
    fronts = lists.groupBy("set", "n").agg(F.collect_list(F.struct("token", "pos")).alias("listed"))  # of one front
    fronts = stored(fronts, folder, "fronts")
    signatures = own.select("set", "n", "signature")

    def ordered(a: str, b: str) -> tuple[Column, Column]:
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    # What fronts allow, first against pivots, then between few random pairs of long lists, however many near copies
    # there are, then between all that these leave apart.
    fits = _may_link(F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos"))
    pairs = listed.filter((F.col("set") != F.col("pivot")) & fits).select(*ordered("pivot", "set")).distinct()
    pivots = tested(pairs, fronts, _possible, folder, "pivots")
    guess = components(links.unionByName(pivots), f"{folder}/guess")
    guessed = stored(_rooted(lists, guess), folder, "guessed")
    left = stored(_mixed(guessed), folder, "mixed")
    for turn in count():
        pairs = _neighbours(left.filter(F.col("k") > LONG_LIST), turn)
        pairs = stored(pairs, folder, f"close{turn}")
        close = stored(possible(pairs, signatures), folder, f"close{turn}_passed")
        tried, passed = pairs.count(), close.count()
        drop(spark, folder, f"close{turn}")
        if passed:
            pivots = pivots.unionByName(close)
            guess = _joined(guess, close, folder, f"guess{turn}")
            left = stored(_mixed(_rooted(left.select("token", "n", "set", "pos"), guess)), folder, f"mixed{turn}")
            drop(spark, folder, "mixed", "guess", f"mixed{turn - 1}", f"guess{turn - 1}")
        if passed * LEAST_SHARE <= tried:
            break
    apart = tested(_cross(left, signatures), fronts, _possible, folder, "apart")
    candidates = stored(pivots.unionByName(apart).distinct(), folder, "candidates")
    drop(spark, folder, "lists", "mixed", "pivots_passed", "apart_passed")
    drop(spark, folder, *[f"{name}{i}{end}" for i in range(turn + 1) for name, end in (("close", "_passed"), ("mixed", ""))])
    wanted = stored(candidates.select(F.explode(F.array("a", "b")).alias("set")).distinct(), folder, "wanted")
    content = stored(set_contents(plain, "text", sets, wanted), folder, "contents")
    found = links.unionByName(tested(candidates, content, _linked, folder, "whole"))
    roots = components(found, f"{folder}/found")

    # Where a candidate was no link, a guessed component may fall apart. All pairs between different guesses
    # have been tested; what is left are pairs within the lists of such a guess.
    after = guess.join(roots.withColumnRenamed("root", "now"), "id", "left")
    after = after.groupBy("root").agg(F.min(F.coalesce("now", "id")).alias("low"), F.max(F.coalesce("now", "id")).alias("high"))
    broken = guess.join(after.filter("low <> high").select("root"), "root", "left_semi")
    broken = broken.select(F.col("id").alias("before"), "root")
    within = guessed.withColumnRenamed("root", "before").join(broken, "before")
    within = stored(within.select(F.xxhash64("token", "root").alias("token"), "n", "set", "pos"), folder, "within")
    drop(spark, folder, "guessed", "guess", f"guess{turn}", f"guess{turn - 1}")
    # Most of the parts are joined again by few random pairs of each set, however many copies there are.
    for turn in count():
        left = stored(_mixed(_rooted(within, roots)), folder, f"left{turn}")
        pairs = _neighbours(left, turn).join(candidates, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            pairs = pairs.join(wanted.withColumnRenamed("set", end), end, "left_semi")
        pairs = stored(pairs.select("a", "b"), folder, f"near{turn}")
        passed = tested(possible(pairs, signatures), content, _linked, folder, f"linked{turn}")
        roots = _joined(roots, passed, folder, f"roots{turn}")
        drop(spark, folder, "within", f"left{turn - 1}", "found", f"roots{turn - 1}")
        within = left.select("token", "n", "set", "pos")
        if passed.count() * LEAST_SHARE <= pairs.count():
            break
    # Members of parts that are still apart are paired as well. Those that light links alone had joined
    # belong to no candidate, so their sets are still to be loaded.
    left = stored(_mixed(_rooted(within, roots)), folder, "left")
    rest = _cross(left, signatures).join(candidates, ["a", "b"], "left_anti")
    rest = tested(rest, fronts, _possible, folder, "more")
    further = rest.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(wanted, "set", "left_anti")
    further = stored(further, folder, "further")
    if further.limit(1).count():
        content = content.unionByName(stored(set_contents(plain, "text", sets, further), folder, "further_contents"))
    roots = _joined(roots, tested(rest, content, _linked, folder, "last"), folder, "roots")

    members = sets.join(roots.withColumnRenamed("id", "set"), "set", "left")
    members = stored(members.select(id, "n", F.coalesce("root", "set").alias("group")), folder, "members")
    least = members.filter(F.col("n") > 0).groupBy("group").agg(F.min(id).alias("component_id"))
    least = stored(least, folder, "least")
    drop_others(spark, folder, "members", "least")
    found = members.join(least, "group", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id))
    return found.select(id, F.col("n").alias("n_shingles"), component.alias("component_id"))
