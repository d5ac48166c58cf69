"""Long repeated byte strings over all documents, by suffix arrays of shards.

A suffix array of all text would have to see everything at once. Instead every string of the given
length names an anchor in itself: the block of least hash among its blocks. Equal strings name
equal anchors, so strings can be compared anchor by anchor. A context is the stretch of text whose
strings name one anchor; contexts that are equal as a whole need no further comparison. The others
are dealt by anchor into shards of bounded size. Each shard gets a suffix array of the string starts
that may be repeated: it is sorted by pieces of doubled length, and starts go as soon as a piece of
their string is found once. An anchor with too many different contexts is first dealt out further,
by what groups of its strings share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.llm.common import drop_others, new_folder, stored
from pulsepress.llm.suffixes import repeated_suffixes
from pulsepress.llm.texts import in_pieces

LENGTH = 400
BLOCK = 32
#: A word, parted from others by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text in a shard, and most contexts of one anchor that go into one.
SHARD_BYTES, ANCHOR_CONTEXTS = 2 << 20, 3000
#: An anchor with more contexts is dealt out by groups of so many string starts, then of fewer.
CELLS = (32, 4, 1)
#: Positions within a stretch of text take this many bits beside a hash.
POSITION_BITS = 20

_RANDOM = np.random.default_rng(20250101)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def block_hashes(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """64-bit hash of the ``block`` bytes (a power of two) from every position."""
    out, base, width = _BYTES[data], _BASE, 1
    while width < block:
        out = out[:-width] * np.uint64(base) + out[width:]
        base = base * base % (1 << 64)
        width *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Per context: first and last string start, place of the anchor, hash of the anchor's block.

    The anchor of a string is its block of least hash, the leftmost of equals, which depends on
    the string alone.
    """
    mask = np.uint64((1 << POSITION_BITS) - 1)
    step = (1 << POSITION_BITS) - length
    found: list[tuple[np.ndarray, ...]] = []
    for base in range(0, len(data) - length + 1, step):
        hashes = block_hashes(data[base : base + step + length - 1])
        least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        blocks, width = length - BLOCK + 1, 1
        while width * 2 <= blocks:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = blocks - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        at = (least & mask).astype(np.int64)
        cuts = np.flatnonzero(at[1:] != at[:-1])
        first = np.concatenate([[0], cuts + 1])
        last = np.concatenate([cuts, [len(at) - 1]])
        place = at[first]
        found.append((first + base, last + base, place + base, hashes[place].view(np.int64)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hash(data) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


_CONTEXT = "text_hash bigint, key bigint, context bigint, first int, last int, at int"


def _batch(columns: list, ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """All contexts of (text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 1):
                parts = []
                hashes, values = (x.to_pylist() for x in piece.columns)
                for text_hash, text in zip(hashes, values, strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    if len(data) < length:
                        continue
                    first, last, at, key = anchors(np.frombuffer(data, np.uint8), length)
                    ends = (last + length).tolist()
                    names = _signed([_hash(data[a:b]) for a, b in zip(first.tolist(), ends, strict=True)])
                    parts.append((np.full(len(key), text_hash), key, names, first, last, at))
                if parts:
                    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    yield _batch([c.astype(np.int32) if i > 2 else c for i, c in enumerate(columns)], _CONTEXT)

    return texts.mapInArrow(run, _CONTEXT)


_WITH_DATA = f"{_CONTEXT}, data binary"
_LOADED = f"{_CONTEXT}, contexts bigint, data binary"


def _with_data(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted contexts with the number of their anchor's contexts and their bytes, read from any text of the hash."""
    fields = ["key", "context", "first", "last", "at", "contexts"]
    per_text = wanted.groupBy("text_hash").agg(F.collect_list(F.struct(*fields)).alias("wanted"))  # of one text
    # Texts are shuffled whatever the size of the wanted part, so that plans are alike at every size.
    joined = texts.hint("merge").join(per_text, "text_hash").select("text_hash", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for piece in in_pieces(batch, 1):
                rows = []
                for text_hash, text, found in zip(*(x.to_pylist() for x in piece.columns), strict=True):
                    if text_hash in seen:
                        continue
                    seen.add(text_hash)
                    data = text.encode("utf-8", "surrogatepass")
                    for x in found:
                        values = [x[c] for c in fields]
                        rows.append((text_hash, *values, data[x["first"] : x["last"] + length]))
                if rows:
                    yield _batch(list(zip(*rows, strict=True)), _LOADED)

    return joined.mapInArrow(run, _LOADED)


_SPAN = "text_hash bigint, start int, stop int"


def _shard_spans(length: int):
    def spans(key, rows):
        """Stretches of the contexts of one shard whose strings also start elsewhere in it."""
        data = rows["data"].to_pylist()
        sizes = np.array([len(x) for x in data], np.int64)
        begins = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(data), np.uint8)
        # Whole strings only: a start must have room within its own context.
        owner = np.repeat(np.arange(len(sizes)), sizes)
        room = (begins + sizes)[owner] - np.arange(len(text))
        # Equal strings belong to one run.
        starts, run = repeated_suffixes(text, room >= length, length)
        if not len(starts):
            return pa.Table.from_batches([_batch([[], [], []], _SPAN)])
        of = owner[starts]
        first = rows["first"].to_numpy().astype(np.int64)
        text_hash = rows["text_hash"].to_numpy()
        place = first[of] + starts - begins[of]
        whose = text_hash[of]
        # Runs with two different places; copies of a context's row count once.
        by = np.lexsort((place, whose, run))
        new_run = np.concatenate([[True], run[by][1:] != run[by][:-1]])
        other = np.concatenate([[True], (whose[by][1:] != whose[by][:-1]) | (place[by][1:] != place[by][:-1])])
        number = np.cumsum(new_run) - 1
        different = np.bincount(number, weights=(new_run | other).astype(float))
        repeated = np.zeros(len(starts), bool)
        repeated[by] = (different >= 2)[number]
        # Neighbouring repeated starts of a context make one stretch.
        hit = np.sort(starts[repeated])
        if not len(hit):
            return pa.Table.from_batches([_batch([[], [], []], _SPAN)])
        cut = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])
        a = hit[cut]
        b = hit[np.concatenate([cut[1:], [True]])]
        shift = (first - begins)[owner[a]]
        return pa.Table.from_batches(
            [_batch([text_hash[owner[a]], (a + shift).astype(np.int32), (b + shift + length).astype(np.int32)], _SPAN)]
        )

    return spans


def _cells(length: int, cell: int):
    """Cut contexts into groups of ``cell`` string starts, keyed by what all of a group's strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 6):
                rows = []
                for text_hash, key, _, first, last, at, data in zip(*(x.to_pylist() for x in piece.columns), strict=True):
                    for number in range((at - last) // cell, (at - first) // cell + 1):
                        # Starts whose distance from the anchor is in the cell.
                        low, high = max(first, at - number * cell - cell + 1), min(last, at - number * cell)
                        core = data[at - number * cell - first : at - number * cell - cell + 1 + length - first]
                        part = data[low - first : high - first + length]
                        name = xxhash.xxh3_64_intdigest(core, seed=number)
                        rows.append((text_hash, key ^ (name >> 1), _hash(part), low, high, at, part))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield _batch([columns[0], columns[1], _signed(list(columns[2])), *columns[3:]], _WITH_DATA)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal spans from spans sorted by text and start; they stream by."""
    held: tuple[int, int, int] | None = None
    for batch in batches:
        out = []
        for text_hash, start, stop in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and held[0] == text_hash and start <= held[2]:
                held = (text_hash, held[1], max(held[2], stop))
                continue
            if held:
                out.append(held)
            held = (text_hash, start, stop)
        if out:
            yield _batch(list(zip(*out, strict=True)), _SPAN)
    if held:
        yield _batch([[x] for x in held], _SPAN)


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``text_hash`` and ``spans``, sorted (start, stop) in bytes, of texts with repeated strings.

    ``texts`` has text_hash and text, a row for every document. A span is a maximal stretch covered
    by strings of ``length`` bytes that also start at another place, in any document or the same one.
    """
    folder = new_folder(texts)
    named = stored(contexts(texts, length), folder, "contexts")
    one = F.min(F.struct("text_hash", "first", "last", "at")).alias("one")
    groups = stored(named.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), one), folder, "groups")

    def covered(rows: DataFrame) -> DataFrame:
        return rows.select("text_hash", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))

    # Contexts that occur again as a whole.
    same = groups.filter("n > 1").select("key", "context")
    spans = [covered(named.join(same, ["key", "context"]))]
    # Anchors with several different contexts.
    mixed = groups.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    mixed = stored(mixed, folder, "mixed")
    wanted = groups.join(mixed, "key").select("key", "context", "one.*", "contexts")
    loaded = stored(_with_data(texts, wanted, length), folder, "loaded")
    cold = [loaded.filter(F.col("contexts") <= ANCHOR_CONTEXTS).drop("contexts")]
    hot = loaded.filter(F.col("contexts") > ANCHOR_CONTEXTS).drop("contexts").dropDuplicates(["key", "text_hash", "first"])
    for cell in CELLS:
        if not mixed.filter(F.col("contexts") > ANCHOR_CONTEXTS).limit(1).count():
            break
        cut = hot.select(*named.columns, "data").mapInArrow(_cells(length, cell), _WITH_DATA)
        parts = stored(cut, folder, f"cells{cell}")
        groups = stored(parts.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n")), folder, f"groups{cell}")
        spans.append(covered(parts.join(groups.filter("n > 1").select("key", "context"), ["key", "context"])))
        mixed = groups.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
        mixed = stored(mixed, folder, f"mixed{cell}")
        rest = parts.dropDuplicates(["key", "context"]).join(mixed, "key")
        few = rest.filter(F.col("contexts") <= ANCHOR_CONTEXTS).select(*named.columns, "data")
        cold.append(stored(few, folder, f"few{cell}"))
        hot = rest.filter(F.col("contexts") > ANCHOR_CONTEXTS)
    together = cold[0].select(*named.columns, "data")
    for rows in cold[1:]:
        together = together.unionByName(rows)
    total = together.agg(F.sum(F.length("data"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = together.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    compared = dealt.select("shard", "text_hash", "first", "data").groupBy("shard").applyInArrow(_shard_spans(length), _SPAN)
    spans.append(compared)
    every = spans[0]
    for rows in spans[1:]:
        every = every.unionByName(rows)
    every = every.distinct().repartition("text_hash").sortWithinPartitions("text_hash", "start")
    merged = every.mapInArrow(_merged, _SPAN)
    listed = merged.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    found = stored(listed, folder, "spans")
    drop_others(texts.sparkSession, folder, "spans")
    return found


def without_spans(data: Column, spans: Column) -> Column:
    """Binary ``data`` without the bytes of the spans."""

    def add(done: Column, x: Column) -> Column:
        kept = F.substring(data, done["at"] + 1, x["start"] - done["at"])
        return F.struct(x["stop"].alias("at"), F.concat(done["out"], kept).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    rest = F.aggregate(spans, start, add)
    return F.concat(rest["out"], F.substring(data, rest["at"] + 1, F.length(data)))


def whole_characters(data: Column, spans: Column) -> Column:
    """The spans without the bytes of characters that they cover in part."""

    def inside(at: Column) -> Column:
        """Whether a character goes on at the position: a byte from 80 to BF."""
        byte = F.hex(F.substring(data, at + 1, F.lit(1)))
        return (byte >= "80") & (byte < "C0")

    def fit(x: Column) -> Column:
        a, b = x["start"], x["stop"]
        start = F.when(~inside(a), a).when(~inside(a + 1), a + 1).when(~inside(a + 2), a + 2).otherwise(a + 3)
        stop = F.when(~inside(b), b).when(~inside(b - 1), b - 1).when(~inside(b - 2), b - 2).otherwise(b - 3)
        return F.struct(start.alias("start"), stop.alias("stop"))

    return F.transform(spans, fit)


def _joined(docs: DataFrame, keep: list[str], text: str, length: int) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), whole.alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(rows.select("text_hash", "text"), length)
    return rows.hint("merge").join(spans, "text_hash", "left")


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH) -> DataFrame:
    """Columns ``keep`` of every row with n_bytes, the removed ``spans`` and the ``kept`` bytes.

    Every byte covered by a ``length``-byte string that also starts elsewhere is removed, judged on
    the input; all occurrences go, those of repeated rows too. NULL is the empty text; texts shorter
    than ``length`` lose nothing. Texts are told apart by 64-bit hashes.
    """
    data = F.col("text").cast("binary")
    joined = _joined(docs, keep, text, length)
    kept = F.when(F.col("spans").isNull(), data).otherwise(without_spans(data, F.col("spans")))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))
    return joined.select("row.*", F.length(data).cast("long").alias("n_bytes"), spans.alias("spans"), kept.alias("kept"))


def long_spans(data: Column, spans: Column, words: int) -> Column:
    """The spans that touch at least ``words`` words or have at least ``LENGTH`` bytes."""

    def long(x: Column) -> Column:
        size = x["stop"] - x["start"]
        part = F.substring(data, x["start"] + 1, size).cast("string")
        return (size >= LENGTH) | (F.regexp_count(part, F.lit(WORD)) >= words)

    return F.filter(spans, long)


def cut_repeats(
    docs: DataFrame, text: str = "text", chars: str | None = "n_chars", length: int = LENGTH, words: int | None = None
) -> DataFrame:
    """The rows of ``docs`` without repeated strings in ``text``, and ``chars`` counted anew.

    A character that is covered in part stays whole. A document that loses everything goes. With
    ``words``, spans of fewer words, parted by ASCII white space, stay unless they have ``LENGTH`` bytes.
    """
    data = F.col("text").cast("binary")
    joined = _joined(docs, docs.columns, text, length)
    if words:
        joined = joined.withColumn("spans", long_spans(data, F.col("spans"), words))
    fitted = joined.withColumn("spans", F.filter(whole_characters(data, F.col("spans")), lambda x: x["start"] < x["stop"]))
    changed = F.col("spans").isNotNull() & (F.size("spans") > 0)
    own = F.col("row").getField(text)
    clean = F.when(changed, without_spans(data, F.col("spans")).cast("string")).otherwise(own)
    done = fitted.select("row", clean.alias("clean"), changed.alias("changed"))
    done = done.filter(~F.col("changed") | (F.col("clean") != ""))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text:
            value = F.col("clean")
        elif c == chars:
            value = F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return done.select(*columns)
