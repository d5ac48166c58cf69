"""Personal data: fixed patterns, and contexts learned from what they find.

Spans that the base patterns find are seeds. The words in front of a seed are a lexical pattern; a
graph joins patterns with the instances that occur behind them, seeds and others of a looser form.
Scores go back and forth over the graph until it is settled which patterns are reliable: a pattern is as
reliable as its instances, an instance as its patterns. What stands behind a reliable pattern is personal
data as well, and behind two of them it becomes a seed of further patterns. Everything here is made
of DataFrame and SQL functions, in time proportional to a text and, for many spans in one text, to
the number of spans times its square root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.llm.common import new_folder, stored

KINDS = ("email", "ip", "card", "phone")
#: Stand in for a character of their own inside texts while a pattern is searched.
DOT, OTHER = "\x01", "\x02"

# The base patterns, written so that a search takes time in proportion to the text: an attempt starts
# where a run of characters does, or where the match before ended, and gives nothing back.
_EMAIL = (
    rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
)
_IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}(?![ -]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Looser forms that count only behind a reliable pattern.
_LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){0,4}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_]{1,2}[0-9]{2,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+.,(/-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9.,/-])",
}
#: Characters in front of a span in which the words of its pattern are looked for, and how many words.
CONTEXT_CHARS, CONTEXT_WORDS = 64, 2
#: A pattern counts from this reliability on, and with so many different seeds.
RELIABILITY, SUPPORT = 0.8, 4
#: An instance that is no seed has this share of its patterns' mean. With it a pattern of s seeds and u instances
#: found nowhere else settles at s / (s + u / 5 + 1): it counts where u <= 1.25 s - 5.
TRUST = 0.8
#: Scores that rise by less in a turn are settled.
LEAST_RISE = 1e-9
#: An instance behind so many reliable patterns becomes a seed.
PROMOTING = 2
#: Texts are cut into blocks of so many characters, so that parts of them are found without a walk from the start.
BLOCK = 1024

_SPANS = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``step`` over an array of numbers from 0 up.

    Parts of the square root of the array's size are run through each, then the results of the parts, so that
    no array that grows by one element at a time is longer than that.
    """

    def plain(part: Column) -> Column:
        start = F.array(F.lit(0)).cast("array<int>")
        return F.aggregate(part, start, lambda done, x: F.array_append(done, step(F.element_at(done, -1), x)))

    def in_parts(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(s["numbers"]) - 1) / s["each"]).cast("int"))
        parts = F.transform(at, lambda i: plain(F.slice(s["numbers"], i * s["each"] + 1, s["each"])))

        def joined(parts: Column) -> Column:
            before = plain(F.transform(parts, lambda part: F.element_at(part, -1)))
            return _let(F.struct(parts.alias("parts"), before.alias("before")), added)

        def added(s: Column) -> Column:
            moved = F.transform(
                s["parts"],
                lambda part, i: F.transform(F.slice(part, 2, F.size(part)), lambda x: step(F.get(s["before"], i), x)),
            )
            return F.flatten(moved)

        return _let(parts, joined)

    each = F.ceil(F.sqrt(F.size(numbers))).cast("int")
    whole = _let(F.struct(numbers.alias("numbers"), each.alias("each")), in_parts)
    return F.when(F.size(numbers) > 0, whole).otherwise(F.array().cast("array<int>"))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _part(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` on of the text that was cut into ``blocks``."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + length) / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.substring(near, start % BLOCK + 1, length)


def _placed(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as (start, end, value), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def measured(s: Column) -> Column:
        lengths = F.transform(s["found"], lambda value, i: F.length(value) + F.length(F.get(s["gaps"], i)))
        return _let(F.struct(s["found"].alias("found"), _running(lengths, lambda a, x: a + x).alias("ends")), spans)

    def spans(s: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            end = F.get(s["ends"], i)
            return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

        return F.transform(s["found"], span)

    return _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), measured).cast(_SPANS)


def _none() -> Column:
    return F.array().cast(_SPANS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """The check sum of card numbers: every second digit from the right counts double, less 9 over 9."""
    digits = F.split(F.reverse(_digits(value)), "")
    numbers = F.filter(digits, lambda x: x != "")

    def weigh(x: Column, i: Column) -> Column:
        doubled = x.cast("int") * (1 + i % 2)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    return F.aggregate(F.transform(numbers, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _card_length(value: Column) -> Column:
    return F.length(_digits(value)).between(12, 19)


def _low_parts(value: Column) -> Column:
    return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans of the base patterns that pass its test."""
    # Dots inside a domain become one character of their own, so that no group has to repeat.
    marked = F.regexp_replace(F.translate(text, DOT, OTHER), r"\.(?=[A-Za-z0-9-])", DOT)
    email = F.when(text.contains("@"), _placed(marked, _EMAIL)).otherwise(_none())
    email = F.transform(
        email,
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.translate(x["value"], DOT, ".").alias("value")),
    )
    ip = F.when(text.rlike(_IP), F.filter(_placed(text, _IP), lambda x: _low_parts(x["value"]))).otherwise(_none())
    card = F.filter(_placed(text, _CARD), lambda x: _luhn(x["value"]))
    card = F.when(text.rlike(_CARD), card).otherwise(_none())
    phone = F.filter(_placed(text, _PHONE), lambda x: F.length(_digits(x["value"])).between(9, 15))
    phone = F.when(text.contains("+"), phone).otherwise(_none())
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def loose_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans of its looser form."""
    at = text.contains("@") | text.contains("(at)") | text.contains("[at]")
    tests = {
        "email": at,
        "ip": text.contains(":") & text.rlike(_LOOSE["ip"]),
        "card": text.rlike(_LOOSE["card"]),
        "phone": text.rlike(_LOOSE["phone"]),
    }
    passes = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike("[0-9]"),
        "card": lambda v: _card_length(v) & _luhn(v),
        "phone": lambda v: F.length(_digits(v)).between(7, 15),
    }

    def passing(kind: str) -> Column:
        return F.filter(_placed(text, _LOOSE[kind]), lambda x: passes[kind](x["value"]))

    return {kind: F.when(tests[kind], passing(kind)).otherwise(_none()) for kind in KINDS}


def _with_context(text: Column, spans: Column, kind: str) -> Column:
    """The spans with their kind's number and the words in front of them, lower-cased."""

    def describe(blocks: Column, x: Column) -> Column:
        chars = F.least(x["start"], F.lit(CONTEXT_CHARS))
        before = _part(blocks, x["start"] - chars, chars)
        words = F.regexp_extract(F.lower(before), rf"((?:\S+\s+){{0,{CONTEXT_WORDS - 1}}}\S+)\s*$", 1)
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            x["end"].alias("end"),
            x["value"].alias("value"),
            F.regexp_replace(words, r"\s+", " ").alias("pattern"),
        )

    def described(s: Column) -> Column:
        return F.transform(s["spans"], lambda x: describe(s["blocks"], x))

    blocks = F.when(F.size(spans) > 0, _blocks(text))
    return _let(F.struct(spans.alias("spans"), blocks.alias("blocks")), described)


def _apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of ``others``, which are looked through in parts."""

    def meet(x: Column, y: Column) -> Column:
        return (x["start"] < y["end"]) & (y["start"] < x["end"])

    def in_parts(s: Column) -> Column:
        each = F.ceil(F.sqrt(F.size(s["others"]))).cast("int")
        at = F.sequence(F.lit(0), F.floor((F.size(s["others"]) - 1) / each).cast("int"))

        def part(i: Column) -> Column:
            rows = F.slice(s["others"], i * each + 1, each)
            start = F.array_min(F.transform(rows, lambda x: x["start"]))
            return F.struct(start.alias("start"), F.array_max(F.transform(rows, lambda x: x["end"])).alias("end"), rows.alias("rows"))

        return _let(F.struct(s["spans"].alias("spans"), F.transform(at, part).alias("parts")), without)

    def without(s: Column) -> Column:
        return F.filter(
            s["spans"],
            lambda x: ~F.exists(s["parts"], lambda p: meet(x, p) & F.exists(p["rows"], lambda y: meet(x, y))),
        )

    apart = _let(F.struct(spans.alias("spans"), others.alias("others")), in_parts)
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), apart).otherwise(spans)


def _scanned(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Base and loose spans of every row, loose ones only where they overlap no base span."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), whole.alias("text"))
    base, loose = base_spans(F.col("text")), loose_spans(F.col("text"))
    df = df.select("*", *[base[k].alias(f"base_{k}") for k in KINDS], *[loose[k].alias(f"loose_{k}") for k in KINDS])

    def together(prefix: str) -> Column:
        return F.concat(*[_with_context(F.col("text"), F.col(f"{prefix}_{k}"), k) for k in KINDS])

    df = df.select("row", F.array_sort(together("base")).alias("base"), together("loose").alias("loose"))
    return df.select("row", "base", _apart(F.col("loose"), F.col("base")).alias("loose"))


def reliable_patterns(scanned: DataFrame, folder: str) -> DataFrame:
    """Patterns (kind, pattern) whose score in the pattern-instance graph is high enough.

    An edge joins a pattern and an instance that occurs behind it, once however often. A seed is
    reliable; a pattern has the mean of its instances, with one unknown instance added; any other
    instance has ``TRUST`` times the mean of its patterns. Copies of a document add no edges, so they prove
    nothing. From 0 the scores only rise, each turn by ``TRUST`` times the turn before at most, until no pattern
    that is still too low can get high enough. Then instances behind ``PROMOTING`` reliable patterns become
    seeds and scores rise again, until there are none. A turn sends three numbers to the driver.
    """

    def edges(column: str, seed: int) -> DataFrame:
        rows = scanned.filter(F.size(column) > 0).select(F.explode(column).alias("x"))
        return rows.select("x.kind", "x.pattern", "x.value", F.lit(seed).alias("seed"))

    graph = edges("base", 1).unionByName(edges("loose", 0)).filter("pattern <> ''")
    graph = graph.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    graph = stored(graph, folder, "graph")
    reliable = (F.col("score") >= RELIABILITY) & (F.col("seeds") >= SUPPORT)
    rated = graph.select("*", F.lit(0.0).alias("before"), F.lit(0.0).alias("mean"))
    turn = 0
    while True:
        own = F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.col("mean"))
        patterns = rated.groupBy("kind", "pattern").agg(
            (F.sum(own) / (F.count(F.lit(1)) + 1)).alias("score"), F.sum("seed").alias("seeds"), F.max("before").alias("before")
        )
        patterns = stored(patterns, folder, f"patterns{turn}")
        seen = patterns.agg(
            F.max(F.col("score") - F.col("before")).alias("rise"),
            F.max(F.when((F.col("seeds") >= SUPPORT) & ~reliable, F.col("score"))).alias("below"),
            F.count(F.when(reliable, 1)).alias("found"),
        ).first()
        may_rise = seen.below is not None and seen.rise > LEAST_RISE
        if not may_rise or seen.below + seen.rise * TRUST / (1 - TRUST) < RELIABILITY:
            found = patterns.filter(reliable).select("kind", "pattern")
            new = graph.filter("seed = 0").join(found, ["kind", "pattern"], "left_semi")
            new = new.groupBy("kind", "value").count().filter(F.col("count") >= PROMOTING)
            new = stored(new.select("kind", "value", F.lit(1).alias("new")), folder, f"promoted{turn}")
            if not seen.found or new.isEmpty():
                return found
            seed = F.greatest("seed", F.coalesce("new", F.lit(0)))
            graph = graph.join(new, ["kind", "value"], "left").select("kind", "pattern", "value", seed.alias("seed"))
            graph = stored(graph, folder, f"graph{turn}")
        rated = graph.join(patterns.select("kind", "pattern", F.col("score").alias("before")), ["kind", "pattern"])
        means = rated.groupBy("kind", "value").agg((TRUST * F.avg("before")).alias("mean"))
        rated = rated.join(means, ["kind", "value"])
        turn += 1


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with ``base`` and ``spans``, arrays of (start, kind, end, value).

    ``kind`` is the number in ``KINDS``; ends are exclusive, positions count code points from 0;
    both are sorted. ``spans`` holds the base spans and those that learned patterns add, which
    overlap no base span. A NULL or empty text has none, an empty table no rows. Repeated rows are searched
    each; a text may be of any length and hold any number of spans. Columns not in ``keep`` are not read.
    """
    folder = new_folder(docs)
    scanned = _scanned(docs, text, keep).withColumn("n", F.monotonically_increasing_id())
    scanned = stored(scanned, folder, "scanned")
    patterns = reliable_patterns(scanned, folder)
    candidates = scanned.filter(F.size("loose") > 0).select("n", F.explode("loose").alias("x"))
    candidates = candidates.select("n", "x", F.col("x.kind").alias("kind"), F.col("x.pattern").alias("pattern"))
    added = candidates.join(patterns, ["kind", "pattern"], "left_semi")
    added = added.groupBy("n").agg(F.collect_list("x").alias("added"))  # of one document

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "end", "value")]))

    joined = scanned.join(added, "n", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.slice("base", 1, 0))))
    return joined.select("row.*", plain(F.col("base")).alias("base"), plain(spans).alias("spans"))


def described(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; of overlapping spans the first names it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(s: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(s["reach"], i - 1), F.lit(0))
            between = _part(s["blocks"], at, x["start"] - at)
            return F.when(x["start"] >= at, F.concat(between, F.get(names, x["kind"]))).otherwise("")

        at = F.element_at(s["reach"], -1)
        return F.concat(F.array_join(F.transform(s["spans"], piece), ""), _part(s["blocks"], at, s["length"] - at))

    reach = _running(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    whole = F.struct(spans.alias("spans"), reach.alias("reach"), _blocks(text).alias("blocks"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, _let(whole, replaced)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` replaced, and ``chars`` counted anew.

    Every row stays, with all its columns whatever their names; texts without personal data, empty and NULL
    ones among them, and their ``chars`` stay as they are.
    """
    found = find(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(text).alias("text")), ["doc"])
    own = F.col("doc").getField(text)
    clean = F.when(F.size("spans") > 0, redacted(own, F.col("spans"))).otherwise(own)
    done = found.select("doc", clean.alias("clean"), (F.size("spans") > 0).alias("changed"))
    columns = []
    for c in docs.columns:
        value = F.col("doc").getField(c)
        if c == text:
            value = F.col("clean")
        elif c == chars:
            value = F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return done.select(*columns)
