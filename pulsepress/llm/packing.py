"""Bulk-synchronous best-fit packing of documents into sequences of fixed capacity.

Every round sorts the open documents and the gaps of the sequences by size into ranges. Within a
range one sweep gives each gap the largest document below it that no smaller gap has taken (open
documents wait on a stack). What a range leaves over meets in a second step: its gaps reach down to
the open documents of the ranges below, nearest first; how many go where follows from the counts of
the ranges alone, and the n-th gap meets the n-th document by their ranks. Gaps shrink, and the next
round begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulsepress.llm.common import drop, new_folder, stored
from pulsepress.llm.texts import map_texts

CAPACITY = 4096
#: Put behind the ids of every document.
END_ID = 1
#: Chunks and words a worker process remembers with their ids, and the longest remembered.
MEMORY, CHUNK_LIMIT = 400_000, 64
#: Documents and gaps of a range: one task sorts and sweeps so many.
RANGE_ROWS = 50_000
#: str.split() parts text at these, the tokenizer does not.
UNLIKE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Below this character lower case and letters are the same to every version of Unicode.
PLAIN_END = "\u0250"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Remembered(dict):
    """What ``find`` gives for a string; short strings are remembered, up to ``MEMORY`` of them."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        self.find = find

    def __missing__(self, key: str) -> bytes:
        found = self.find(key)
        if len(key) <= CHUNK_LIMIT:
            if len(self) >= MEMORY:
                self.clear()
            self[key] = found
        return found


class _Ids:
    """Ids of texts as little-endian 32-bit numbers, words encoded once and remembered.

    For tokenizers that drop white space and never join what it parts. A chunk between white space
    goes through the tokenizer's own normalizer, splitter and model; where all of its characters
    are Latin, lower-casing and the splitter's pattern do the same quicker. A text with Latin
    characters only is lower-cased at once.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as lines:
            form = json.load(lines)
        steps = [x["type"] for x in form["normalizer"]["normalizers"]], form["pre_tokenizer"]["pretokenizers"]
        split = steps[1][0]
        self.quick = steps[0] == ["NFC", "Replace", "Lowercase"] and split.get("invert") and len(steps[1]) == 2
        self.find_words = regex.compile(split["pattern"]["Regex"]).findall
        self.beyond = regex.compile(f"[{PLAIN_END}-\U0010ffff]").search
        # Letters in a row are one word.
        self.whole_letters = r"|[\p{L}]+|" in split["pattern"]["Regex"]
        self.special = tuple(x["content"] for x in form["added_tokens"])
        self.characters = byte_characters()
        self.words = _Remembered(self._word)
        self.lower_chunks = _Remembered(self._lower_chunk)
        self.chunks = _Remembered(self._chunk)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        mapped = word.encode("utf-8").decode("latin-1").translate(self.characters)
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(mapped)])

    def _lower_chunk(self, chunk: str) -> bytes:
        if self.whole_letters and chunk.isalpha():
            return self.words[chunk]
        return b"".join([self.words[x] for x in self.find_words(chunk)])

    def _chunk(self, chunk: str) -> bytes:
        if not self.quick or self.beyond(chunk):
            return self._whole(chunk)
        return self._lower_chunk(chunk.lower())

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in UNLIKE) or any(x in text for x in self.special):
            return self._whole(text)
        if self.quick and not self.beyond(text):
            return b"".join(map(self.lower_chunks.__getitem__, text.lower().split()))
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=2)
def _ids_at(path: str) -> _Ids:
    """With what it remembers, shared by the tasks of a worker process; results do not depend on it."""
    return _Ids(path)


PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids:binary>>"


def tokenized(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids (little-endian uint32).

    The ids of a document end with ``END_ID``, so an empty or NULL text has one token. Only a
    document longer than the capacity is cut; its last piece may be shorter.
    """

    def make():
        encode = _ids_at(path)

        def cut(t: str) -> tuple:
            ids = encode(t) + np.array([END_ID], "<u4").tobytes()
            whole = range(0, len(ids), 4 * capacity)
            parts = (ids[at : at + 4 * capacity] for at in whole)
            return ([(i, i * capacity, len(x) // 4, x) for i, x in enumerate(parts)],)

        return cut

    return map_texts(docs, [id], text, make, f"pieces {PIECE}").select(id, F.inline("pieces"))


_SWEPT = T.StructType(
    [
        T.StructField("is_gap", T.BooleanType()),
        T.StructField("id", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("range", T.IntegerType()),
        T.StructField("rank", T.LongType()),  # among what the range leaves over; else NULL
        T.StructField("bin", T.LongType()),  # of a document placed within its range
    ]
)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match the sorted documents and gaps of one range; number what is left over."""
    from pyspark import TaskContext

    here = TaskContext.get().partitionId()
    rows = list(batches)
    if not rows:
        return
    rows = pa.Table.from_batches(rows)
    gap, ids, sizes = (rows[c].to_numpy() for c in ("is_gap", "id", "size"))
    open_rows: list[int] = []
    bins = np.full(len(ids), -1, np.int64)
    unmet = np.zeros(len(ids), bool)
    for i, is_gap in enumerate(gap.tolist()):
        if not is_gap:
            open_rows.append(i)
        elif open_rows:
            bins[open_rows.pop()] = ids[i]
        else:
            unmet[i] = True
    rank = np.full(len(ids), -1, np.int64)
    rank[open_rows] = np.arange(len(open_rows))
    rank[unmet] = np.arange(int(unmet.sum()))
    keep = ~gap | unmet
    columns = [
        pa.array(gap[keep]),
        pa.array(ids[keep]),
        pa.array(sizes[keep]),
        pa.array(np.full(int(keep.sum()), here, np.int32)),
        pa.array(rank[keep], mask=rank[keep] < 0),
        pa.array(bins[keep], mask=bins[keep] < 0),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in _SWEPT])


def _meetings(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Which left-over gaps meet which left-over documents, from (range, gaps, documents).

    Gives (gap range, first gap, end gap, document range, document rank of the first gap), ranks of
    documents counting down, and how many documents each range keeps.
    """
    waiting: list[list[int]] = []
    meet = []
    for here, gaps, documents in sorted(counts):
        first = 0
        while first < gaps and waiting:
            below, left = waiting[-1]
            n = min(left, gaps - first)
            meet.append((here, first, first + n, below, left - 1))
            first += n
            if n == left:
                waiting.pop()
            else:
                waiting[-1][1] -= n
        if documents:
            waiting.append([here, documents])
    return meet, dict(map(tuple, waiting))


def pack(pieces: DataFrame, capacity: int = CAPACITY, id: str = "row", length: str = "length") -> DataFrame:
    """A sequence and a place in it for every piece: id, sequence_id, offset.

    ``pieces`` has a unique long id and a length from 1 to ``capacity``. At first as many
    sequences are open as the lengths need at least; when no document fits any gap, as many more as
    the rest needs. Rounds go on until every piece has its place.
    """
    folder = new_folder(pieces)
    spark = pieces.sparkSession
    narrow = pieces.select(F.col(id).cast("long").alias("id"), F.col(length).cast("long").alias("size"))
    narrow = stored(narrow, folder, "pieces")

    items = narrow.filter(F.col("size") < capacity)
    bins = spark.range(0).select(F.col("id"), F.col("id").alias("size"))
    opened, rounds, placed = 0, 0, []
    while True:
        sizes = items.groupBy("size").count().select(F.lit(False).alias("gap"), "size", "count")
        free = bins.filter("size > 0").groupBy("size").count().select(F.lit(True).alias("gap"), "size", "count")
        # No more rows than there are sizes, twice the capacity at most.
        table = [(x.gap, x["size"], x["count"]) for x in sizes.unionByName(free).collect()]
        open_items = {s: n for is_gap, s, n in table if not is_gap}
        gaps = {s: n for is_gap, s, n in table if is_gap}
        if not open_items:
            break
        widest, longest, least = max(gaps, default=0), max(open_items), min(open_items)
        # Documents that fit no gap need sequences of their own.
        lost = sum(s * n for s, n in open_items.items() if s > widest)
        more = -(-lost // capacity)
        if more:
            new = spark.range(opened, opened + more).select("id", F.lit(capacity).cast("long").alias("size"))
            bins, opened = bins.unionByName(new), opened + more
        # A gap that holds the longest document several times takes part as often.
        times = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / longest))
        slots = bins.filter(F.col("size") >= least).select("id", "size", F.explode(F.sequence(F.lit(1), times.cast("int"))))
        elements = items.select(F.lit(False).alias("is_gap"), "id", "size").unionByName(
            slots.select(F.lit(True).alias("is_gap"), "id", "size")
        )
        total = sum(open_items.values()) + sum(n * max(1, s // longest) for s, n in gaps.items()) + more
        # So many that a task's range stays bounded; what comes back to the driver is a row of counts for each.
        ranges = max(1, -(-total // RANGE_ROWS))
        ordered = elements.repartitionByRange(ranges, "size", "is_gap", "id")
        ordered = ordered.sortWithinPartitions("size", "is_gap", "id")
        swept = stored(ordered.mapInArrow(_sweep, _SWEPT), folder, f"swept{rounds}")
        drop(spark, folder, f"swept{rounds - 1}")
        left = swept.filter(F.col("rank").isNotNull())
        per_range = left.groupBy("range").agg(
            F.sum(F.col("is_gap").cast("long")).alias("gaps"), F.sum((~F.col("is_gap")).cast("long")).alias("documents")
        )
        meet, stay = _meetings([(x["range"], x.gaps, x.documents) for x in per_range.collect()])
        # One row per meeting, at most twice as many as ranges.
        fields = "range int, first long, end long, below int, top long"
        meetings = F.broadcast(spark.createDataFrame(meet, fields))
        gap_side = left.filter("is_gap").join(meetings, "range")
        gap_side = gap_side.filter("rank >= first AND rank < end").select(
            F.col("id").alias("bin"), F.col("below").alias("range"), (F.col("top") - F.col("rank") + F.col("first")).alias("rank")
        )
        carried = left.filter("NOT is_gap").select("id", "size", "range", "rank").join(gap_side, ["range", "rank"])
        found = swept.filter(F.col("bin").isNotNull()).select("id", "bin", "size")
        found = found.unionByName(carried.select("id", "bin", "size"))
        done = stored(found.withColumn("round", F.lit(rounds)), folder, f"placed{rounds}")
        placed.append(done)
        kept = F.broadcast(spark.createDataFrame(list(stay.items()), "range int, stay long"))
        items = left.filter("NOT is_gap").join(kept, "range").filter("rank < stay").select("id", "size")
        taken = done.select(F.col("bin").alias("id"), (-F.col("size")).alias("size"))
        bins = stored(
            bins.unionByName(taken).groupBy("id").agg(F.sum("size").alias("size")), folder, f"bins{rounds}"
        )
        drop(spark, folder, f"bins{rounds - 1}")
        rounds += 1
    drop(spark, folder, f"swept{rounds - 1}", f"bins{rounds - 1}")
    whole = narrow.filter(F.col("size") >= capacity).select("id", (-1 - F.col("id")).alias("bin"), "size", F.lit(0).alias("round"))
    everything = whole
    for done in placed:
        everything = everything.unionByName(done)
    # A sequence holds no more rows than its capacity.
    order = Window.partitionBy("bin").orderBy("round", F.col("size").desc(), "id")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return everything.select(F.col("id").alias(id), F.col("bin").alias("sequence_id"), before.alias("offset"))


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    id: str = "doc_id",
    text: str = "text",
    content: Column | None = None,
) -> DataFrame:
    """Pieces of all documents and their places, packed by ``pack``.

    Returns id, piece, start, length, content, sequence_id, offset; ``content`` is the piece's ids,
    or another expression of the columns of ``tokenized``. Rows are packed one by one, repeated ones
    and those with a NULL id too; an empty table gives no rows.
    """
    folder = new_folder(docs)
    content = F.col("ids") if content is None else content
    pieces = tokenized(docs, path, capacity, id, text).select(id, "piece", "start", "length", content.alias("content"))
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), folder, "tokenized")
    places = pack(pieces, capacity)
    return pieces.join(places, "row").select(id, "piece", "start", "length", "content", "sequence_id", "offset")
