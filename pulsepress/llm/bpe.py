"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can be the last one of its encoding: the
token whose pairing with the last token of the prefix before it is one that the merges themselves
would leave alone. The table of these last tokens encodes a piece in one pass, grows exactly when
bytes are appended, and after an edit has to be redone only until it agrees with the old table.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from pulsepress.llm.texts import in_pieces

#: Encoded chunks and pairs remembered by a task, and the longest chunk remembered.
MEMORY, CHUNK_LIMIT = 400_000, 64
#: Kind of array that holds 32-bit ids, and ids decoded before rows are handed back.
PACKED, PIECE_IDS = "i", 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens with their ranks, which are their ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        # A tree of the tokens read from their last byte: node * 256 + byte leads to a node.
        self.steps: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                node = self.steps.get(key, 0)
                if not node:
                    node = self.steps[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = rank

    def merged(self, data: bytes, parts_left: int = 1) -> list[int]:
        """Tokens after merging the neighbours of least rank, leftmost first, until none merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > parts_left:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            at = ranks.index(min(known))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens merged last into a token, (-1, -1) for a byte.

        None where merging the token's own bytes does not give the token, so it never occurs.
        """
        if token not in self._halves:
            data = self.bytes[token]
            two = self.merged(data, 2) if len(data) > 1 else [-1, -1]
            whole = len(two) == 2 and (len(data) == 1 or self.merged(data) == [token])
            self._halves[token] = (two[0], two[1]) if whole else None
        return self._halves[token]

    def pair(self, first: int, second: int) -> bool:
        """Whether merging the bytes of two tokens leaves just these two."""
        key = first << 32 | second
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMORY:
                self._pairs.clear()
            known = self._pairs[key] = self._stays(first, second)
        return known

    def _stays(self, a: int, b: int) -> bool:
        """Undo the merges along the seam, latest first; none across may have been due by then.

        ``due`` is the least rank that the state of the seam still had to come: a merge across of
        a lesser rank would have happened instead. Of equal ranks the left one happens first.
        """
        names, ranks = self.bytes, self.ranks
        due = len(ranks) + max(a, b) + 1
        while True:
            across = ranks.get(names[a] + names[b])
            if across is not None and across < due:
                return False
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None or of_b is None:
                return False
            if of_a[0] < 0 and of_b[0] < 0:
                return True
            if of_b[0] < 0 or (of_a[0] >= 0 and a > b):
                due, a = a, of_a[1]
            else:
                due, b = b + 1, of_b[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixTable:
    """Bytes of one piece and the last token of each of their prefixes.

    The prefixes of a short piece are looked at when they are asked for, which most never are; those
    of a long one in order, so that no recursion gets deep.
    """

    SHORT = 200

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int | None] = [-1]
        self.append(data)

    def at(self, end: int) -> int:
        """The last token of the prefix up to ``end``: one that its predecessor stays apart from."""
        last = self.last
        if last[end] is not None:
            return last[end]
        v, data = self.vocabulary, self.data
        steps, token_at, pairs = v.steps, v.token_at, v._pairs
        ending, node, start = [], 0, end
        while start:
            node = steps.get(node << 8 | data[start - 1])
            if node is None:
                break
            start -= 1
            token = token_at[node]
            if token >= 0:
                ending.append((start, token))
        for start, token in reversed(ending):
            if not start:
                if v.halves(token):
                    last[end] = token
                    return token
                continue
            before = last[start]
            if before is None:
                before = self.at(start)
            stays = pairs.get(before << 32 | token)
            if v.pair(before, token) if stays is None else stays:
                last[end] = token
                return token
        raise ValueError("bytes outside the vocabulary")

    def _fill(self, start: int) -> None:
        if len(self.data) > self.SHORT:
            for end in range(start, len(self.data) + 1):
                self.at(end)

    def append(self, data: bytes) -> None:
        known = len(self.last) if len(self.data) > self.SHORT else 1
        self.data += data
        self.last += [None] * len(data)
        self._fill(known)

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put ``data`` in the place of bytes ``start`` to ``stop``.

        Prefixes up to ``start`` keep their tokens. Behind the edit the old table holds again once
        it has agreed with the new one over as many places as the longest token has bytes.
        """
        old, shift = self.last, len(data) - (stop - start)
        was_long = len(self.data) > self.SHORT
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1] + [None] * (len(self.data) - start)
        if not was_long or len(self.data) <= self.SHORT:
            self._fill(1)
            return
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            token, was = self.at(end), end - shift
            agreed = agreed + 1 if end > start + len(data) and old[was] == token else 0
            if agreed >= self.vocabulary.longest:
                self.last[end + 1 :] = old[was + 1 :]
                return

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.at(end)
            out.append(token)
            end -= len(self.vocabulary.bytes[token])
        return out[::-1]


class Encoder:
    """Encodes texts: pieces of the pattern one by one, repeated chunks from memory."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._known: dict[str, list[int] | None] = {}

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece. A piece that is a token is that token, whatever the merges say."""
        data = piece.encode()
        token = self.vocabulary.ranks.get(data)
        return [token] if token is not None else PrefixTable(self.vocabulary, data).ids()

    def _plain(self, text: str) -> list[int]:
        known, out = self._known, []
        for piece in self.pattern.findall(text):
            ids = known.get(piece) if len(piece) <= CHUNK_LIMIT else None
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= CHUNK_LIMIT:
                    self._remember(piece, ids)
            out += ids
        return out

    def _remember(self, chunk: str, ids: list[int] | None) -> None:
        if len(self._known) >= MEMORY:
            self._known.clear()
        self._known[chunk] = ids

    def encode(self, text: str) -> list[int]:
        return self._plain(text)


class _Unspaced(Exception):
    """A chunk with white space at one of its ends."""


class _Chunks(dict):
    """Packed ids of chunks that follow a space; those not known are encoded when they are asked for."""

    def __init__(self, plain: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.plain = plain

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unspaced
        ids = array(PACKED, self.plain(" " + chunk)).tobytes()
        if len(chunk) < CHUNK_LIMIT:
            if len(self) >= MEMORY:
                self.clear()
            self[chunk] = ids
        return ids


class SpacedEncoder(Encoder):
    """Faster where the pattern always breaks before a single space between two words.

    Between two characters that are not white space, a space starts a new piece under patterns
    of the form `` ?letters| ?numbers| ?others|white space``. Chunks from space to space are encoded
    once and remembered. Texts with other white space beside a space go the plain way.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        super().__init__(vocabulary, pattern)
        self._chunks = _Chunks(self._plain)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers, one behind the other."""
        first, *chunks = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return array(PACKED, self._plain(first)).tobytes() + b"".join(map(self._chunks.__getitem__, chunks))
            except _Unspaced:
                pass
        return array(PACKED, self._plain(text)).tobytes()

    def encode(self, text: str) -> list[int]:
        return array(PACKED, self.packed(text)).tolist()


class EditableText:
    """A text with its ids, kept exact under appends and edits by encoding near them again."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, text
        self.pieces = [(m.start(), m.end(), encoder.piece(m[0])) for m in encoder.pattern.finditer(text)]

    def ids(self) -> list[int]:
        return [x for _, _, ids in self.pieces for x in ids]

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in the place of characters ``start`` to ``stop``.

        A piece is decided by its own characters and at most two behind it, so pieces that end
        two characters before the edit stay. A piece that starts behind the edit where an old one
        did is followed by the old pieces.
        """
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        kept = [x for x in self.pieces if x[1] + 2 <= start]
        old = {x[0] + shift: i for i, x in enumerate(self.pieces) if x[0] >= stop}
        position = kept[-1][1] if kept else 0
        while position < len(self.text):
            if position >= start + len(new) and position in old:
                tail = self.pieces[old[position] :]
                kept += [(a + shift, b + shift, ids) for a, b, ids in tail]
                break
            match = self.encoder.pattern.match(self.text, position)
            kept.append((match.start(), match.end(), self.encoder.piece(match[0])))
            position = match.end()
        self.pieces = kept


@lru_cache(maxsize=2)
def _vocabulary_at(path: str) -> Vocabulary:
    """Read once by a worker process, whose tasks share it."""
    return Vocabulary(read_ranks(path))


@lru_cache(maxsize=2)
def _encoder_at(path: str, pattern: str) -> SpacedEncoder:
    """With what it remembers, shared by the tasks of a worker process; results do not depend on it."""
    return SpacedEncoder(_vocabulary_at(path), pattern)


@lru_cache(maxsize=2)
def _tokens_at(path: str) -> pa.Array:
    """The bytes of every id, NULL where there is none."""
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    return pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.binary())


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int64)
    flat = np.frombuffer(b"".join(packed), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``ids`` (array of int) of every row's whole text; NULL is the empty text.

    ``path`` is a rank file that every executor has; ``pattern`` splits a text into pieces, which
    are encoded one by one, without special tokens. Rows are independent: repeated ones repeat, an
    empty text has no ids, a long one is encoded in time proportional to its length.
    """
    narrow = docs.select(id, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = StructType([narrow.schema.fields[0], StructField("ids", ArrayType(IntegerType()))])
    own = to_arrow_schema(schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_at(path, pattern)
        for batch in batches:
            for piece in in_pieces(batch, 1):
                ids = _lists([encoder.packed(x) for x in piece.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(own), ids], names=schema.names)

    return narrow.mapInArrow(run, schema)


def _decoded(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum([0, *lengths], dtype=np.int64).astype(np.int32)
    done = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), tokens.take(ids.flatten())), b"")
    if done.null_count:
        raise ValueError("ids outside the vocabulary")
    return done


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the bytes of their ids (NULL ids: empty)."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded binary"
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens_at(path)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(lengths, dtype=np.int64), 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_IDS, side="right")))
                piece = batch.slice(start, stop - start)
                done = _decoded(piece.column(at), tokens)
                yield pa.RecordBatch.from_arrays([*piece.columns, done], names=[*piece.schema.names, "decoded"])
                start = stop

    return encoded.mapInArrow(run, schema)


def digests(decoded: DataFrame, id: str = "doc_id") -> DataFrame:
    """Number of ids, and hashes of the ids as text and of the decoded bytes."""
    return decoded.select(
        F.col(id),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
