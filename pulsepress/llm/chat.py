"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine checks the order of turns while rows stream by; the template says which literals stand
around a turn and which of its parts count for the loss. Control strings inside texts are escaped,
so the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Put after the first character of a control string inside a text; one more where some stand there.
ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """Marks around a turn, further control strings, roles that count for the loss, allowed turns.

    ``follows`` maps a state (a role, or "" at the start) to the roles that may come next.
    """

    before_role: str = "<|turn|>"
    before_text: str = "<|text|>"
    after_text: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def controls(self) -> tuple[str, ...]:
        return (self.before_role, self.before_text, self.after_text, *self.reserved)

    def __post_init__(self) -> None:
        marks = (self.before_role, self.before_text, self.after_text)
        firsts = {x[0] for x in self.controls()}
        if len(set(marks)) < 3 or any(len(x) < 2 or ESCAPE in x for x in self.controls()):
            raise ValueError("three different marks, control strings of two characters or more")
        if any(c in firsts for x in marks for c in x[1:]):
            raise ValueError("the first character of a control string inside a mark")
        for one in self.controls():
            for rest in (one[i:] for i in range(1, len(one))):
                if any(x.startswith(rest) or rest.startswith(x) for x in self.controls()):
                    raise ValueError("control strings overlap")

    def escape_pattern(self) -> re.Pattern:
        each = sorted(set(self.controls()), key=lambda x: (-len(x), x))
        return re.compile("|".join(f"{re.escape(x[0])}(?={ESCAPE}*{re.escape(x[1:])})" for x in each))

    def unescape_pattern(self) -> re.Pattern:
        each = sorted(set(self.controls()), key=lambda x: (-len(x), x))
        return re.compile("|".join(f"{re.escape(x[0])}{ESCAPE}(?={ESCAPE}*{re.escape(x[1:])})" for x in each))


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0][:-1], text)


class _Turns:
    """State of one conversation: the machine's last role and the number of turns."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.valid, self.turns = template, "", True, 0

    def next(self, role: str) -> None:
        self.valid &= role in self.template.follows.get(self.state, ())
        self.state = role
        self.turns += 1


SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, valid boolean"


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)


def format_conversations(
    conversations: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Segments of every conversation in order: conv_id, turn_no, part, text, loss, valid.

    Each turn gives three segments: its opening mark with the role (part 0), its escaped text (part
    1, with ``loss`` where the role counts) and its closing mark (part 2). ``valid`` says whether
    the turns up to here follow the machine; others are formatted all the same. Rows are ordered by
    turn, NULL turns first, ties by role, then text; repeated rows are turns each. NULL roles and
    texts are empty, a NULL conversation id is one more conversation. Rows stream through the task
    of their conversation, however long it is; the segments come out sorted within partitions.
    """
    template = template or Template()
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = template.escape_pattern()
        last, turns = object(), None
        for batch in batches:
            out = []
            for conv_id, _, role, text in _columns(batch):
                if conv_id != last or turns is None:
                    last, turns = conv_id, _Turns(template)
                turns.next(role)
                opening = template.before_role + escape(role, marks) + template.before_text
                parts = (opening, False), (escape(text, marks), role in template.loss), (template.after_text, False)
                out += [(conv_id, turns.turns - 1, i, t, loss, turns.valid) for i, (t, loss) in enumerate(parts)]
            schema = [pa.int64(), pa.int64(), pa.int32(), pa.large_string(), pa.bool_(), pa.bool_()]
            names = [x.split()[0] for x in SEGMENTS.split(", ")]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), s) for c, s in zip(columns, schema, strict=True)], names)

    return rows.mapInArrow(segments, SEGMENTS)


class _Reader:
    """Reads turns back from formatted text that comes in pieces, and keeps their digests."""

    def __init__(self, template: Template) -> None:
        self.template, self.open, self.plain = template, "", template.unescape_pattern()
        self.turns, self.formatted, self.loss_chars = 0, 0, 0
        self.seen, self.masked, self.valid = hashlib.sha256(), hashlib.sha256(), True

    def add(self, text: str, loss: bool, valid: bool) -> None:
        self.formatted += len(text)
        self.valid = self.valid and valid
        if loss:
            counted = unescape(text, self.plain)
            self.loss_chars += len(counted)
            self.masked.update(counted.encode("utf-8", "surrogatepass"))
        self.open += text
        while (end := self.open.find(self.template.after_text)) >= 0:
            turn, self.open = self.open[:end], self.open[end + len(self.template.after_text) :]
            role, _, said = turn.removeprefix(self.template.before_role).partition(self.template.before_text)
            whole = f"{unescape(role, self.plain)}\n{unescape(said, self.plain)}\n"
            self.seen.update(whole.encode("utf-8", "surrogatepass"))
            self.turns += 1


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of every conversation, read from its segments alone.

    ``segments`` is what ``format_conversations`` gives, in its own order. A turn ends at its
    closing mark; what is held back at any time is one turn.
    """
    template = template or Template()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        schema = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), s) for c, s in zip(columns, schema, strict=True)], names)

        def closed(conv_id, r: _Reader) -> tuple:
            return conv_id, r.turns, r.seen.hexdigest(), r.loss_chars, r.masked.hexdigest(), r.formatted, r.valid

        last, reader = None, None
        for batch in batches:
            done = []
            for conv_id, _, _, text, loss, valid in _columns(batch):
                if reader is None or conv_id != last:
                    if reader is not None:
                        done.append(closed(last, reader))
                    last, reader = conv_id, _Reader(template)
                reader.add(text, loss, valid)
            yield batch_of(done)
        if reader is not None:
            yield batch_of([closed(last, reader)])

    return segments.mapInArrow(digests, DIGEST)
