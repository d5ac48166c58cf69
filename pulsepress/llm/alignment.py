"""Links between the tokens of two tokenizers, counted over all documents by inverted bitmaps.

Both tokenizers cut the same bytes. Two tokens are linked where their bytes overlap, and a place where
tokens of both end closes a group. For every pair of ids an inverted list says which documents hold it
linked: a compressed bitmap for each chunk of document numbers, and beside it planes of bitmaps for how
often. Bitmaps of one pair and chunk are merged by OR, bits are counted to document counts and (by
planes) to link counts, and the same bitmaps carry the counts back to the documents as scores.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from pulsepress.llm.common import new_folder, stored
from pulsepress.llm.texts import in_pieces

#: Documents of a chunk are numbered by so many bits; above ``DENSE`` of them a bitmap is not larger than a list.
CHUNK_BITS = 14
CHUNK = 1 << CHUNK_BITS
DENSE = CHUNK // 16 - 1
#: Pairs of (pair of ids, document) held before bitmaps are handed on, and chunks of text remembered.
BLOCK_ENTRIES, MEMORY = 2_000_000, 300_000

#: A single space between two characters that are not white space; no token of either kind reaches over it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def byte_level_tokens(path: str) -> dict[bytes, int]:
    """Bytes and ids of a byte-level BPE file, whose ids have to follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {"<|endoftext|>"}
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in special}
    made = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    ids = [vocabulary[a + b] for a, b in made]
    if ids != sorted(ids):
        raise ValueError("ids do not follow the order of the merges")
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}


class _Grown:
    """A numpy array that is added to at its end."""

    def __init__(self) -> None:
        self.data, self.n = np.empty(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            larger = np.empty(2 * (self.n + len(values)), np.int64)
            larger[: self.n] = self.data[: self.n]
            self.data = larger
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def view(self) -> np.ndarray:
        return self.data[: self.n]


def _strings(ids: int) -> pa.Array:
    """Numbers below ``ids`` followed by a comma, then by a bar, then by a semicolon."""
    return pa.array([f"{i}{end}" for end in ",|;" for i in range(ids)], pa.string())


def _joined(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    empty = b"" if pa.types.is_binary(values.type) else ""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), empty)


class Aligner:
    """Both tokenizers, and what they make of the chunks of text between single spaces.

    A chunk, with the space in front of it, is tokenized and aligned alone: neither tokenizer has a
    token with a space behind another character, so groups end at chunks' ends. Chunks are remembered.
    """

    def __init__(self, byte_level: str, pieces: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        tokens = byte_level_tokens(byte_level)
        self.encode_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=tokens, special_tokens={}).encode_ordinary
        names = {i: token for token, i in tokens.items()}
        self.bytes_a = pa.array([names.get(i) for i in range(max(names) + 1)], pa.binary())
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        size = self.pieces.get_piece_size()
        texts = [self.pieces.id_to_piece(i) for i in range(size)]
        if any(re.search("[^▁]▁", x) for x in texts):
            raise ValueError("a piece has a space behind another character")
        self.bytes_b = pa.array(
            [
                bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode()
                for i, x in enumerate(texts)
            ],
            pa.binary(),
        )
        self.size_a, self.size_b = (
            pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (self.bytes_a, self.bytes_b)
        )
        self.text_a, self.text_b = _strings(len(self.bytes_a)), _strings(len(self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []
        # By chunk: tokens of both kinds, groups, links and where its links begin; the pair of every link.
        self.counts = [_Grown() for _ in range(5)]
        self.links = _Grown()
        self.pairs: dict[int, int] = {}

    def chunks(self, text: str) -> list[int]:
        """Numbers of the chunks of a text, which are all known afterwards."""
        known, parts = self.known, text.split(" ") if text else []
        found = [known.get(x, -1) for x in parts]
        if -1 not in found:
            return found
        missing = {x for x, i in zip(parts, found, strict=True) if i < 0}
        if any(not x or x[0].isspace() or x[-1].isspace() for x in missing):
            parts = _SAFE.split(text)
            missing = {x for x in parts if x not in known}
        for x in missing:
            # Tokenized later, together with others.
            known[x] = len(known)
        return [known[x] for x in parts]

    def learn(self) -> None:
        """Tokenize and align the chunks that were not known yet."""
        first = len(self.groups)
        new = [x for x, _ in zip(reversed(self.known), range(len(self.known) - first), strict=False)][::-1]
        if not new:
            return
        ids_a = [self.encode_a(f" {x}") for x in new]
        ids_b = self.pieces.encode(new, num_threads=1)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        whole = pa.array([f" {x}".encode() for x in new], pa.binary())
        good = np.ones(len(new), bool)
        for n, flat, names in ((n_a, flat_a, self.bytes_a), (n_b, flat_b, self.bytes_b)):
            joined = _joined(np.append(0, np.cumsum(n)), names.take(pa.array(flat)))
            good &= pc.fill_null(pc.equal(joined, whole), False).to_numpy(zero_copy_only=False)
        flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        # Ends of tokens in the bytes of all good chunks; between two cuts lies just one token of each kind.
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        cuts = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        chunk_a, chunk_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        chunk = chunk_a[at_a]
        closes = (ends_a[at_a] == cuts) & (ends_b[at_b] == cuts)
        n_groups = np.bincount(chunk[closes], minlength=len(new))
        n_links = np.bincount(chunk, minlength=len(new))
        for grown, values in zip(self.counts, (n_a, n_b, n_groups, n_links), strict=False):
            grown.add(values)
        self.counts[4].add(self.links.n + np.cumsum(n_links) - n_links)
        keys, which = np.unique(flat_a[at_a] << 32 | flat_b[at_b], return_inverse=True)
        numbers = np.fromiter((self.pairs.setdefault(k, len(self.pairs)) for k in keys.tolist()), np.int64, len(keys))
        self.links.add(numbers[which])
        texts = self._texts(flat_a, flat_b, ends_a, ends_b, cuts[closes], chunk_a, chunk_b, len(new))
        self.groups += [x if ok else None for x, ok in zip(texts, good.tolist(), strict=True)]

    def _texts(self, flat_a, flat_b, ends_a, ends_b, group_ends, chunk_a, chunk_b, chunks) -> list[str]:
        """By chunk the groups as text, each closed by a semicolon."""
        group_a, group_b = np.searchsorted(group_ends, ends_a), np.searchsorted(group_ends, ends_b)
        # A token is followed by a comma, the last of its group by a bar or a semicolon.
        mark_a = np.where(group_ends[group_a] == ends_a, 1, 0)
        mark_b = np.where(group_ends[group_b] == ends_b, 2, 0)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        texts = pa.concat_arrays(
            [
                self.text_a.take(pa.array(flat_a + mark_a * len(self.bytes_a))),
                self.text_b.take(pa.array(flat_b + mark_b * len(self.bytes_b))),
            ]
        ).take(pa.array(order))
        sizes = np.bincount(np.concatenate([chunk_a, chunk_b]), minlength=chunks)
        return _joined(np.append(0, np.cumsum(sizes)), texts).to_pylist()

    def pair_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Both ids of the pairs, by their number."""
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        return keys >> 32, keys & 0xFFFFFFFF


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def pack(row: np.ndarray, low: np.ndarray, rows: int) -> tuple[np.ndarray, pa.Array]:
    """Sizes and bitmaps of the document numbers ``low`` of each row; sorted by row and number.

    Up to ``DENSE`` numbers are a list of 16-bit numbers, more are a bitmap.
    """
    n = np.bincount(row, minlength=rows)
    dense = n > DENSE
    sparse = ~dense[row]
    lists = low[sparse].astype("<u2").view(np.uint8)
    maps = np.zeros((int(dense.sum()), CHUNK), bool)
    maps[(np.cumsum(dense) - 1)[row[~sparse]], low[~sparse]] = True
    maps = np.packbits(maps, axis=1, bitorder="little")
    sizes = np.where(dense, CHUNK // 8, 2 * n)
    ends = np.cumsum(sizes)
    data = np.empty(int(sizes.sum()), np.uint8)
    data[_spread((ends - sizes)[~dense], sizes[~dense])] = lists
    data[_spread((ends - sizes)[dense], sizes[dense])] = maps.ravel()
    offsets = np.append(0, ends).astype(np.int32)
    return n, pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and document number of every bit."""
    sizes = pc.binary_length(bits).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), bits), b"")[0].as_buffer()
    data = np.frombuffer(joined, np.uint8)
    starts = np.cumsum(sizes) - sizes
    # No list is as long as a bitmap.
    dense = sizes == CHUNK // 8
    sparse_bytes = data[_spread(starts[~dense], sizes[~dense])]
    row_s = np.repeat(np.flatnonzero(~dense), sizes[~dense] // 2)
    maps = data[_spread(starts[dense], sizes[dense])].reshape(-1, CHUNK // 8)
    which, low = np.nonzero(np.unpackbits(maps, axis=1, bitorder="little"))
    row = np.concatenate([row_s, np.flatnonzero(dense)[which]])
    return row, np.concatenate([sparse_bytes.view("<u2").astype(np.int64), low])


@lru_cache(maxsize=2)
def _aligner(byte_level: str, pieces: str, pattern: str) -> Aligner:
    """Read once by a worker process, whose tasks share it and what it remembers."""
    return Aligner(byte_level, pieces, pattern)


class _Block:
    """Entries (pair, document, links) of one chunk of document numbers, until they become bitmaps."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner, self.parts, self.held = aligner, [], 0

    def add(self, low: np.ndarray, chunk_ids: list[list[int]]) -> None:
        a = self.aligner
        sizes = np.fromiter(map(len, chunk_ids), np.int64, len(chunk_ids))
        flat = np.fromiter(chain.from_iterable(chunk_ids), np.int64, int(sizes.sum()))
        if not len(flat):
            return
        keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(a.groups) + flat, return_counts=True)
        doc, chunk = np.divmod(keys, len(a.groups))
        n_links, starts = a.counts[3].view()[chunk], a.counts[4].view()[chunk]
        pair = a.links.view()[_spread(starts, n_links)]
        key = pair << CHUNK_BITS | low[np.repeat(doc, n_links)]
        order = np.argsort(key)
        key, times = key[order], np.repeat(times, n_links)[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.parts.append((key[first], np.add.reduceat(times, first) if len(first) else times))
        self.held += len(first)

    def bitmaps(self, chunk: int) -> Iterator[tuple]:
        """Columns a, b, chunk, plane, bits: plane 0 has all documents, plane k those with bit k - 1 of the links beyond one."""
        if not self.held:
            return
        key, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(key)
        key, more = key[order], times[order] - 1
        id_a, id_b = self.aligner.pair_ids()
        for plane in range(int(more.max()).bit_length() + 1):
            own = key if not plane else key[more >> (plane - 1) & 1 == 1]
            pair, row = np.unique(own >> CHUNK_BITS, return_inverse=True)
            _, bits = pack(row, own & (CHUNK - 1), len(pair))
            yield id_a[pair], id_b[pair], np.full(len(pair), chunk), np.full(len(pair), plane), bits


_DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string"
_BITMAP = "a int, b int, chunk bigint, plane int, bits binary"


def _aligned(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """A row for every document (n, row and counts) and, between them, rows with the bitmaps."""
    schema = StructType(
        [
            StructField("n", docs.schema["n"].dataType),
            docs.schema["row"],
            *StructType.fromDDL(_DOCUMENT).fields,
            *StructType.fromDDL(_BITMAP).fields,
        ]
    )
    for field in schema.fields:
        field.nullable = True
    types = to_arrow_schema(schema)

    def filled(columns: list, first: int) -> pa.RecordBatch:
        rows = len(columns[0])
        arrays = [pa.nulls(rows, f.type) for f in types]
        for i, column in enumerate(columns, first):
            arrays[i] = column.cast(types.field(i).type) if isinstance(column, pa.Array) else pa.array(column, types.field(i).type)
        return pa.RecordBatch.from_arrays(arrays, names=types.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_level, pieces, pattern)
        block, chunk = _Block(aligner), -1
        for batch in batches:
            for piece in in_pieces(batch, 2):
                numbers = piece.column(0).to_numpy()
                of = numbers >> CHUNK_BITS
                for own in np.unique(of).tolist():
                    if own != chunk or block.held > BLOCK_ENTRIES or len(aligner.known) > MEMORY:
                        for columns in block.bitmaps(chunk):
                            yield filled(list(columns), 6)
                        if len(aligner.known) > MEMORY:
                            aligner.forget()
                        chunk = own
                    at = np.flatnonzero(of == own)
                    part = piece.slice(int(at[0]), len(at))
                    ids = [aligner.chunks(x) for x in part.column(2).to_pylist()]
                    aligner.learn()
                    groups = aligner.groups
                    texts = [[groups[i] for i in x] for x in ids]
                    ids = [[] if None in t else x for x, t in zip(ids, texts, strict=True)]
                    hashes = [
                        hashlib.sha256("".join(t)[:-1].encode()).hexdigest() if x else "" for x, t in zip(ids, texts, strict=True)
                    ]
                    counts = [
                        np.array([c[x].sum() for x in ids], np.int64) for c in (aligner.counts[k].view() for k in range(3))
                    ]
                    block.add(numbers[at] & (CHUNK - 1), ids)
                    yield filled([part.column(0), part.column(1), *counts, hashes], 0)
        for columns in block.bitmaps(chunk):
            yield filled(list(columns), 6)

    return docs.mapInArrow(run, schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of one pair, chunk and plane as one, with the number of their bits."""
    for batch in batches:
        parts = batch.column(4)
        row, low = unpack(parts.flatten())
        owner = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy())[row]
        key = np.unique(owner << CHUNK_BITS | low)
        n, bits = pack(key >> CHUNK_BITS, key & (CHUNK - 1), len(parts))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], bits, pa.array(n, pa.int64())], names=["a", "b", "chunk", "plane", "bits", "n"]
        )


_SCORES = "n bigint, n_links bigint, n_best bigint, count_sum bigint"


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by document over bitmaps that come chunk by chunk: links, those with a best count, counts."""
    names = [x.split()[0] for x in _SCORES.split(", ")]
    sums, chunk = np.zeros((3, CHUNK), np.int64), None

    def done() -> pa.RecordBatch:
        low = np.flatnonzero(sums[0])
        columns = [(chunk << CHUNK_BITS) + low, *(x[low] for x in sums)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    for batch in batches:
        chunks, planes, docs, best = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        row, low = unpack(batch.column(4))
        weight = np.where(planes, 1 << np.maximum(planes - 1, 0), 1)
        values = (weight, weight * best, weight * docs)
        for own in dict.fromkeys(chunks.tolist()):
            if chunk is not None and own != chunk:
                yield done()
                sums[:] = 0
            chunk = own
            at = chunks[row] == own
            for total, value in zip(sums, values, strict=True):
                np.add.at(total, low[at], value[row[at]])
    if chunk is not None:
        yield done()


def _inverted(aligned: DataFrame, folder: str) -> DataFrame:
    """One bitmap for each pair, chunk and plane, with its number of documents ``n``."""
    found = aligned.filter(F.col("a").isNotNull()).select("a", "b", "chunk", "plane", "bits")
    # A chunk has a bounded number of documents, so its bitmaps are few.
    listed = found.groupBy("a", "b", "chunk", "plane").agg(F.collect_list("bits").alias("parts"))
    return stored(listed.mapInArrow(_merged, f"{_BITMAP}, n bigint"), folder, "inverted")


def _counted(inverted: DataFrame) -> DataFrame:
    weight = F.when(F.col("plane") == 0, F.lit(1)).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    return inverted.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("docs"), F.sum(F.col("n") * weight).alias("links")
    )


def _numbered(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    return docs.select(F.monotonically_increasing_id().alias("n"), row, F.coalesce(F.col(text), F.lit("")).alias("text"))


def pair_counts(docs: DataFrame, byte_level: str, pieces: str, pattern: str, text: str = "text") -> DataFrame:
    """``a``, ``b``, ``docs`` and ``links``: in how many documents a pair of ids is linked, and how often."""
    folder = new_folder(docs)
    aligned = stored(_aligned(_numbered(docs, [], text).withColumn("row", F.lit(0)), byte_level, pieces, pattern), folder, "aligned")
    return _counted(_inverted(aligned, folder))


def align(docs: DataFrame, byte_level: str, pieces: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with the counts of its tokens, groups and links, and their scores.

    ``byte_level`` is a byte-level BPE file and ``pattern`` what cuts its texts, ``pieces`` a model of
    pieces with byte fallback; every executor has both. Each text is taken with a space in front.
    ``n_best`` counts the links of pairs that no other pair of their first id has more documents than,
    ``count_sum`` adds the document counts of all links. Texts that are NULL, empty, or whose tokens
    do not give back the same bytes have zeros and an empty ``groups_sha256``. Rows count as documents,
    repeated ones too. A long text takes time in proportion to its length.
    """
    folder = new_folder(docs)
    aligned = stored(_aligned(_numbered(docs, keep, text), byte_level, pieces, pattern), folder, "aligned")
    inverted = _inverted(aligned, folder)
    counted = stored(_counted(inverted).select("a", "b", "docs"), folder, "counted")
    # Not more rows than the first tokenizer has ids.
    best = counted.groupBy("a").agg(F.max("docs").alias("most"))
    scored = counted.join(F.broadcast(best), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))
    carried = inverted.hint("merge").join(scored, ["a", "b"]).select("chunk", "plane", "docs", "best", "bits")
    scores = carried.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_returned, _SCORES)
    rows = aligned.filter(F.col("a").isNull()).drop("a", "b", "chunk", "plane", "bits")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    joined = rows.join(scores, "n", "left")
    return joined.select("row.*", "n_a", "n_b", "n_groups", *zero, "groups_sha256")
