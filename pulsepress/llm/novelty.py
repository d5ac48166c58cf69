"""Secrets: fixed patterns, and strings in sensitive contexts that nothing around them explains.

A compressor knows the identifiers that documents commonly use (its dictionary) and the text around a
candidate. What the candidate adds to the compressed size is its novelty: words, names and repetitions
add little, a random string about as much as its characters can carry. Candidates whose novelty comes
close to that are reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.llm.common import shuffle_partitions, top_by_tree
from pulsepress.llm.texts import in_pieces, map_texts

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
#: Greedy runs that fail for their length hold no longer match, so the length can be asked at once.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGNED = 8

#: Words that make the rest of their line sensitive, for so many characters.
SENSITIVE = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "signature", "private",
)
_SENSITIVE = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
REACH = 64
#: What can be a candidate: its characters and least length.
_LETTER, _DIGIT, _CAPITAL = (re.compile(x) for x in ("[A-Za-z]", "[0-9]", "[A-Z]"))
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-][A-Za-z0-9+/_.=~-]{10,}[A-Za-z0-9+/_=~-]")
#: Characters on both sides of a candidate that explain it.
AROUND = 256
#: Bytes that a candidate has to add, in parts of what random characters of its kinds would carry.
NOVEL = 0.9
#: Identifiers of the dictionary, those that spell most characters over all documents, and their form.
DICTIONARY, LEVEL = 4096, 9
_IDENTIFIER = re.compile(r"[A-Za-z_]{4,32}", re.ASCII)
#: Different identifiers counted before rows are handed on.
COUNTED = 300_000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Matches (start, kind, end, value) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of strings that stand behind a sensitive word on its line."""
    lower = text.lower()
    if not any(x in lower for x in SENSITIVE):
        return []
    found, done = [], 0
    for word in _SENSITIVE.finditer(text):
        stop = word.end() + REACH
        line = text.find("\n", word.end(), stop)
        stop = line if line >= 0 else stop
        at = max(word.end(), done)
        while match := _CANDIDATE.search(text, at):
            if match.start() >= stop:
                break
            # Digits alone are numbers, letters of one case (but for the first) are words.
            value = match[0]
            mixed = _LETTER.search(value) and (_DIGIT.search(value) or _CAPITAL.search(value, 1) and not value.isupper())
            # A word that the sensitive one is only a part of is no value.
            if mixed and (match.start() > word.end() or not text[word.end() : word.end() + 1].isalpha()):
                found.append((match.start(), match.end()))
            at = done = match.end()
    return found


def carried(value: str) -> float:
    """Bytes that random characters of the same kinds would carry."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        size = 10 if value.isdigit() else 16
    else:
        kinds = ("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26), ("[^0-9A-Za-z]", 4)
        size = sum(n for kind, n in kinds if re.search(kind, value))
    return len(value) * math.log2(size) / 8


class Novelty:
    """Marginal compressed bytes against a dictionary of identifiers and the text around."""

    def __init__(self, dictionary: bytes, level: int = LEVEL) -> None:
        import zstandard

        # The most common ones last: near the end they are cheapest to refer to.
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False).compress

    def added(self, text: str, start: int, end: int) -> int:
        around = f"{text[max(0, start - AROUND) : start]}\n{text[end : end + AROUND]}\n"
        return len(self.compress(f"{around}{text[start:end]}".encode())) - len(self.compress(around.encode()))

    def share(self, text: str, start: int, end: int) -> float:
        """Novelty of text[start:end] in parts of what its characters could carry."""
        return self.added(text, start, end) / carried(text[start:end])


@lru_cache(maxsize=4)
def _novelty(dictionary: bytes) -> Novelty:
    return Novelty(dictionary)


def identifiers(docs: DataFrame, text: str = "text") -> DataFrame:
    """``identifier`` and the number of documents (``docs``) that hold it, for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["identifier", "docs"]
            )
            counts.clear()
            return out

        for batch in batches:
            for piece in in_pieces(batch, 0):
                for value in piece.column(0).to_pylist():
                    counts.update(set(_IDENTIFIER.findall(value)))
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = texts.mapInArrow(run, "identifier string, docs bigint")
    return counted.groupBy("identifier").agg(F.sum("docs").alias("docs"))


def dictionary_of(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> bytes:
    """The ``size`` identifiers that spell most characters in all documents, most common last.

    Lists of ``size`` are merged in a tree, and no more than ``size`` short strings come to the driver.
    Identifiers have letters and underscores only, so that what holds digits never explains another
    document's secret.
    """
    fan_in = 16
    groups = fan_in * shuffle_partitions(docs)
    spelled = (F.col("docs") * F.length("identifier")).alias("spelled")
    part = F.pmod(F.xxhash64("identifier"), F.lit(groups)).alias("part")
    rows = identifiers(docs, text).filter("docs > 1").select("identifier", spelled, part, F.lit(0).alias("all"))
    order = [F.desc("spelled"), F.asc("identifier")]
    top = top_by_tree(rows, ["all"], order, size, "part", groups, fan_in).orderBy("rank").collect()
    return " ".join(x["identifier"] for x in reversed(top)).encode()


_SPANS = "array<struct<start:int,kind:int,end:int,share:double>>"


def _finder(dictionary: bytes, novel: float) -> Callable[[], Callable[[str], tuple]]:
    def make() -> Callable[[str], tuple]:
        novelty = _novelty(dictionary)

        def find(text: str) -> tuple:
            base = base_spans(text)
            spans = [(s, kind, e, novelty.share(text, e - len(value), e)) for s, kind, e, value in base]
            for start, end in candidates(text):
                if any(s < end and start < e for s, _, e, _ in base):
                    continue
                share = novelty.share(text, start, end)
                if share >= novel:
                    spans.append((start, len(KINDS) - 1, end, share))
            return ([dict(zip(("start", "kind", "end", "share"), x, strict=True)) for x in sorted(spans)],)

        return find

    return make


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text", novel: float = NOVEL) -> DataFrame:
    """Columns ``keep`` of every row with ``spans`` (start, kind, end, share), sorted.

    ``kind`` is the number in ``KINDS``: matches of the fixed patterns always stay, and strings in
    sensitive contexts that overlap none of them are added where ``share``, their novelty in parts of
    what their characters could carry, is at least ``novel``. Positions count code points from 0, ends
    are exclusive. A NULL or empty text has no spans; an empty table gives none; repeated rows are
    searched each, whole, however long.
    """
    found = map_texts(
        docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text")),
        ["row"], "text", _finder(dictionary_of(docs, text), novel), f"spans {_SPANS}",
    )
    return found.select("row.*", "spans")


def described(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ","
    )
