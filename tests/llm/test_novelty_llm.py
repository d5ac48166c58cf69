"""Secret scans: fixed patterns by a second reading, novelty by the library, planted strings."""

import hashlib
import random
import re
import string
from collections import Counter

import pytest
import zstandard

from pulsepress.llm import novelty
from pulsepress.llm.registered import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def _assigned(text):
    """Matches of the assign pattern, character by character."""
    out, at = [], 0
    while m := WORD.search(text, at):
        i = m.end()
        i += text[i : i + 1] in ("'", '"')
        while text[i : i + 1] == " ":
            i += 1
        if text[i : i + 1] not in (":", "="):
            at = m.start() + 1
            continue
        i += 1
        while text[i : i + 1] == " ":
            i += 1
        i += text[i : i + 1] in ("'", '"')
        j = i
        while j < len(text) and text[j] in VALUE:
            j += 1
        if j == i:
            at = m.start() + 1
            continue
        if j - i >= 8:
            out.append((m.start(), 0, j))
        at = j
    return out


def _runs(text, kind, least, chars, head=""):
    pattern = re.compile(f"{head}[{chars}]+")
    return [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[0]) >= least]


def brute(text):
    return sorted([*_assigned(text), *_runs(text, 1, 16, "A-Z0-9", "AKIA"), *_runs(text, 2, 32, "0-9a-f")])


def test_fixed_patterns():
    draw = random.Random(1)
    parts = [
        "password", "TOKEN", "api_key", "apikey", "ſecret", "secret", "K", ":", "=", " ", "  ", '"', "'", "abcdefg", "h", "\n",
        "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "é", "-", "x" * 9, "AKIA0",
    ]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert [x[:3] for x in novelty.base_spans(text)] == brute(text), text


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(2)
    parts = ["ri", "ver", "sto", "ne", "gar", "den", "win", "dow", "let", "ter", "ta", "ble", "ing"]
    words = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(400)]
    return [" ".join(draw.choice(words) for _ in range(150)) for _ in range(120)]


KINDS = {
    "alnum24": (string.ascii_letters + string.digits, 24),
    "base64_40": (string.ascii_letters + string.digits + "+/", 40),
    "hex31": ("0123456789abcdef", 31),
    "HEX40": ("0123456789ABCDEF", 40),
}


def test_random_strings_in_sensitive_contexts_are_added(rows, prose):
    draw, planted, clean = random.Random(3), {}, []
    for i, text in enumerate(prose):
        cut = text.index(" ", len(text) // 2)
        chars, n = list(KINDS.values())[i % 4]
        value, other, third = ("".join(draw.choice(chars) for _ in range(n)) for _ in range(3))
        front = ("Authorization: Bearer ", "the private part is ", "ssh-key ", "signature> ")[i % 4]
        planted[i] = (text[: cut + 1] + front + value + text[cut:], cut + 1 + len(front), n)
        clean += [
            text[: cut + 1] + "the key isGardenWindowLetterTable12 and riverStoneGardenTable " + text[cut:],
            # No sensitive word, or one that is on another line.
            text[: cut + 1] + "id " + other + text[cut:],
            text[: cut + 1] + "key\n" + third + text[cut:],
        ]
    schema = "doc_id long, text string, spans string, row string, identifier string"
    data = [(i, t, "s", "r", "i") for i, (t, _, _) in planted.items()]
    data += [(1000 + i, t, "s", "r", "i") for i, t in enumerate(clean)]
    data += [(5000, None, "s", "r", "i"), (5000, "", "s", "r", "i"), (None, "token: abcdefgh " * 2000, None, None, None)]
    got = novelty.find_secrets(rows(schema, *data), ["doc_id", "row"]).collect()
    assert len(got) == len(data)
    added = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == 3] for x in got}
    hit = sum(any(s == at and e == at + n for s, e in added[i]) for i, (_, at, n) in planted.items())
    assert hit >= 0.9 * len(planted)
    wrong = sum(bool(added[1000 + i]) for i in range(len(clean)))
    assert wrong <= 0.02 * len(clean)
    (long,) = [x for x in got if x.doc_id is None]
    assert len(long.spans) == 2000 and all(s.kind == 0 for s in long.spans)
    assert [x.spans for x in got if x.doc_id == 5000] == [[], []]
    assert novelty.find_secrets(rows(schema, *data).limit(0), ["doc_id"]).count() == 0


def test_fixed_patterns_are_confirmed_or_not(rows, prose):
    text = f"{prose[0]} token = 'aaaaaaaaaaaaaaaaaaaaaaaa' {prose[1]} token = 'q8Zr41LmVx0pKd93Tb7w' {prose[2]}"
    (got,) = novelty.find_secrets(rows("doc_id long, text string", (1, text)), ["doc_id"]).collect()
    assert [x.kind for x in got.spans] == [0, 0]
    assert got.spans[0].share < 0.5 and got.spans[1].share >= novelty.NOVEL


def test_dictionary_and_shares_are_those_of_the_library(spark, rows, prose):
    df = rows("doc_id long, text string", *enumerate(prose))
    counts = Counter(w for t in prose for w in set(re.findall("[A-Za-z_]{4,32}", t)))
    best = sorted(((-n * len(w), w) for w, n in counts.items() if n > 1))[:50]
    dictionary = novelty.dictionary_of(df, size=50)
    assert dictionary == " ".join(w for _, w in reversed(best)).encode()
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=novelty.LEVEL, dict_data=own).compress
    text = f"{prose[0]} key Zx81hhQ0pLm4aRt9 {prose[1]}"
    at = text.index("Zx81")
    around = f"{text[at - 256 : at]}\n{text[at + 16 : at + 16 + 256]}\n".encode()
    assert novelty.Novelty(dictionary).added(text, at, at + 16) == len(pack(around + b"Zx81hhQ0pLm4aRt9")) - len(pack(around))
    # A known identifier adds less than an unknown one, a repeated string least.
    known = prose[2] + " key " + best[0][1] * 3
    n = len(best[0][1]) * 3
    assert novelty.Novelty(dictionary).share(known, len(known) - n, len(known)) < novelty.NOVEL


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {x.doc_id: x for x in QUERIES["op12_secret_scan"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        base, x = brute(text or ""), got[doc_id]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        said = [f"{novelty.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert x.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [y for y in x.spans.split(",") if y and not y.startswith("novel")] == said
        assert x.n_confirmed <= len(base)


def test_registered_query_counts_several_spans_of_a_document(spark, rows, tmp_path):
    draw = random.Random(6)
    parts = [
        "password: abcdefgh ", "API_KEY='x9.y8=z7+w6' ", "token=short ", "AKIAABCDEFGH1234 ", "AKIAABCDEFGH123 ",
        "0123456789abcdef" * 2, "0123456789abcdef" * 3 + " ", "é\U0001f600", "words ", "\n",
    ]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(200)]
    data = [*enumerate(texts), (1000, None), (1001, ""), (1002, "AKIAABCDEFGH1234"), (1003, "0123456789abcdef" * 2)]
    rows("doc_id long, text string", *data).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in QUERIES["op12_secret_scan"](spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for doc_id, text in data:
        base, x = brute(text or ""), got[doc_id]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3)), text
        said = ",".join(f"{novelty.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
