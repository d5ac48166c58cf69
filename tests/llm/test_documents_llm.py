"""Packing, personal data, repeated strings, similar documents, and the pipeline, against brute force."""

import random
import re
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pulsepress.llm import jaccard, packing, pii, repeats
from pulsepress.llm.suffixes import common_prefixes, suffix_array

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_packing(rows):
    draw = random.Random(1)
    texts = [" ".join(draw.choice(("Été", "it's", "word.", "x\x1cy", "漢字", "\u2003a", "\x07b\x7f", "İĿ", "Σας")) for _ in range(draw.randint(0, 300))) for _ in range(120)]
    texts += [None, "", "long word " * 3000, texts[0], texts[0]]
    df = rows("doc_id long, text string, row string, length string", *[(i, t, "r", "l") for i, t in enumerate(texts)])
    got = packing.pack_documents(df, PATH, capacity=512).collect()
    tokenizer, by_doc, filled = Tokenizer.from_file(PATH), {}, {}
    for x in got:
        by_doc.setdefault(x.doc_id, []).append(x)
        filled.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda x: x.piece)
        assert [x.start for x in pieces] == list(range(0, len(ids), 512))
        assert b"".join(x.content for x in pieces) == np.array(ids, "<u4").tobytes()
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(filled) <= 1.05 * sum(x.length for x in got) / 512 + 1
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    luhn = sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return {
        "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
        "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15,
    }[kind]


def test_personal_data_base_spans(rows):
    draw = random.Random(2)
    parts = ["a@b.c", "x.y@z-1.co", "..", "@", "\x01", "1.2.3.4", "999.1.1.1", ".5", "4111111111111111", "4111 1111-1111 1111",
             " ", "-", "7", "+1 (017) 555-7713", "+", "é", "word ", "_m@n.o_p@q.rs", "00255.1.1.1"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(400)]
    texts += [None, "1" * 60_000, "a" * 60_000 + "@", "1 " * 30_000, "a@" + "b." * 20_000 + "c"]
    df = rows("doc_id long, text string, spans string, base string", *[(i, t, "s", "b") for i, t in enumerate(texts)])
    got = {x.doc_id: x for x in pii.find(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts[:401]):
        want = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, t or "") if _valid(kind, m[0]))
        assert [(x.start, x.kind, x.end) for x in got[i].base] == want, t
    assert [x.kind for x in got[404].base] == [0] and not got[401].base and not got[402].base
    assert pii.find(df.limit(0), ["doc_id"]).count() == 0


def test_personal_data_behind_learned_contexts(rows):
    seeds = [(i, f"Please call me +1 (017) 555-77{i:02d} today", 1) for i in range(10)]
    more = [(20, "Please call me 017 555 7713 today", 1), (21, "In section 017 555 7713 it says", 1)]
    df = rows("doc_id long, text string, n_chars long", *seeds, *more, (22, None, 0))
    got = {x.doc_id: x.spans for x in pii.find(df, ["doc_id"]).collect()}
    assert [(x.start, x.kind) for x in got[20]] == [(15, 3)] and not got[21]
    clean = {x.doc_id: x for x in pii.redact(df).collect()}
    assert clean[3].text == "Please call me [PHONE] today" and clean[3].n_chars == 28
    assert clean[20].text == "Please call me [PHONE] today" and clean[21].text == more[1][1] and clean[22].text is None


def test_personal_data_by_promoted_seeds_whatever_the_number_of_turns(rows):
    """A chain: each pair of patterns is reliable only through the instances that the pair before makes seeds."""
    texts, number = [], iter(range(1000, 9999))

    def say(words, value):
        texts.append(f"It says {words} {value} here")

    def loose():
        n = next(number)
        return f"0{n % 90 + 10} 5{n % 89 + 10} {n}"

    for words in ("call me", "ring me"):
        for _ in range(60):
            say(words, f"+1 (017) 555-{next(number)}")
    chain = [("call me", "ring me"), ("dial us", "phone us"), ("my cell", "her cell")]
    for (a, b), (c, d), times in zip(chain, chain[1:], (24, 8), strict=False):
        for _ in range(times):
            value = loose()
            for words in (a, b, c, d):
                say(words, value)
    lone = [loose() for _ in range(2)]
    for value in lone:
        say("her cell", value)
    wrong = [loose() for _ in range(40)]
    for value in wrong:
        say("in section", value)
    for _ in range(5):  # seeds there too, outnumbered
        say("in section", f"+1 (017) 555-{next(number)}")
    df = rows("doc_id long, text string", *enumerate(texts))
    got = {x.doc_id: [s.value for s in x.spans] for x in pii.find(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert len(got[i]) == (0 if any(t.endswith(f"{v} here") for v in wrong) else 1), t


def test_personal_data_in_texts_of_many_spans_takes_time_in_proportion(rows):
    draw = random.Random(4)
    parts = ["a.b@c.de", "1.2.3.4", "+1 (017) 555-7713", "4111 1111 1111 1111", "Été", "x\U0001f600", "word " * 300, "\n"]
    texts = [" ".join(draw.choice(parts) for _ in range(n)) for n in (0, 1, 3, 40, 700)]
    many = " ".join(f"u{i}@h{i}.org" for i in range(40_000))
    df = rows("doc_id long, text string, n_chars int", *[(i, t, len(t)) for i, t in enumerate([*texts, many])])
    started = time.time()
    clean = {x.doc_id: x for x in pii.redact(df).collect()}
    spans = {x.doc_id: x.spans for x in pii.find(df, ["doc_id"]).collect()}
    assert time.time() - started < 90  # quadratic: hours
    for i, t in enumerate([*texts, many]):
        out, at = [], 0
        for x in spans[i]:
            assert t[x.start : x.end] == x.value
            if x.start >= at:
                out += [t[at : x.start], f"[{pii.KINDS[x.kind].upper()}]"]
            at = max(at, x.end)
        assert clean[i].text == "".join(out) + t[at:] and clean[i].n_chars == len(clean[i].text)
    assert len(spans[5]) == 40_000


def _removed(texts, length):
    starts = {}
    for i, t in enumerate(texts):
        for q in range(len(t) - length + 1):
            starts.setdefault(t[q : q + length], []).append((i, q))
    covered = [np.zeros(len(t), bool) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for i, q in places:
                covered[i][q : q + length] = True
    return covered


def test_repeats(rows, monkeypatch):
    draw = random.Random(3)

    def noise(n):
        return "".join(draw.choice("abcdefgé ") for _ in range(n))

    shared = [noise(n) for n in (60, 64, 90, 300)]
    texts = [noise(draw.randint(0, 120)) + draw.choice(shared) + noise(draw.randint(0, 120)) for _ in range(60)]
    texts += [texts[0], texts[0], "", None, "ab" * 500, "x" * 700, noise(200)]
    df = rows("doc_id long, text string, spans string, kept string", *[(i, t, "s", "k") for i, t in enumerate(texts)])
    data = [(t or "").encode() for t in texts]
    want = _removed(data, 64)
    for limit in (3000, 4):  # anchors with more contexts are dealt out further
        monkeypatch.setattr(repeats, "ANCHOR_CONTEXTS", limit)
        got = {x.doc_id: x for x in repeats.remove_repeats(df, ["doc_id"], length=64).collect()}
        for i, t in enumerate(data):
            assert bytes(got[i].kept) == np.frombuffer(t, np.uint8)[~want[i]].tobytes(), (limit, i)
            assert got[i].n_bytes == len(t)
            assert len(got[i].spans) == int((np.diff(np.concatenate([[0], want[i].astype(int)])) == 1).sum())
    cut = repeats.cut_repeats(df, chars=None, length=64)
    assert cut.columns == df.columns and all("\ufffd" not in (x.text or "") for x in cut.collect())
    assert repeats.remove_repeats(df.limit(0), ["doc_id"]).count() == 0


def test_suffix_arrays():
    draw = random.Random(5)
    for _ in range(300):
        text = bytes(97 + draw.randrange(draw.choice((1, 2, 4))) for _ in range(draw.randint(0, 60)))
        text += text[: draw.randint(0, len(text))]
        array = np.frombuffer(text, np.uint8)
        order = suffix_array(array, 1000)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = common_prefixes(array, order, 16)
        for a, b in zip(order, order[1:], strict=False):
            n = next((k for k in range(16) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or b + k >= len(text)), 16)
            assert shared[b] == n


def _components(texts):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def _near(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


def _similar_texts():
    draw = random.Random(7)
    base = [[f"b{draw.randrange(10**6)}" for _ in range(n)] for n in (9, 12, 20, 24, 60, 200, 400)]
    texts = [_near(draw, draw.choice(base), draw.randint(0, 4)) for _ in range(160)]
    texts += [" ".join(draw.choice(base)[: draw.randint(5, 400)]) for _ in range(60)]
    return [*texts, None, "", " \t\n", "One two", "one TWO", "one two three", texts[0], texts[0], "É x", "é x"]


def test_similar_documents(rows, monkeypatch):
    texts = _similar_texts()
    table = [(i, t, "n", 1) for i, t in enumerate(texts)]
    df = rows("doc_id long, text string, set string, n long", *table).repartition(5)
    n, root = _components(texts)
    for light, frequent in ((20, 4), (20, 10**9), (0, 2)):
        monkeypatch.setattr(jaccard, "LIST_COST", 8.0 if light else 0.0)
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard, "SAMPLE", 2)
        monkeypatch.setattr(jaccard, "LIST_BLOCK", 4096 if light else 8)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df).collect()}
        assert [got[i] for i in range(len(texts))] == list(zip(n, root, strict=True))
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def _lightly_linked():
    """Texts c, a1, a2, b: c is linked with a1 and a2, which share their first front shingle with b and no more."""
    draw, shingles = random.Random(11), jaccard.Shingler()

    def ordered(words):
        return np.sort(shingles(" ".join(words)).view(np.int64)).tolist()

    while True:
        c, x, y, more = ([f"w{draw.randrange(10**6)}" for _ in range(n)] for n in (11, 1, 1, 8))
        for at in range(7):
            texts = [c, [*c, *x], [*y, *c], [*c[at : at + 5], *more]]
            first, one, two, other = (ordered(t) for t in texts)
            if first[0] == one[0] == two[0] == other[0] and not {one[1], two[1], other[1]} & set(first):
                return [" ".join(t) for t in texts]


def test_sets_joined_by_light_links_alone_are_compared(rows, monkeypatch):
    texts = _lightly_linked()
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, heavier: 8)
    df = rows("doc_id long, text string", *enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df).collect()}
    n, root = _components(texts)
    assert n == [7, 8, 8, 9] and root == [0, 0, 0, 3]
    assert [got[i] for i in range(4)] == list(zip(n, root, strict=True))


def test_links_of_near_copies_grow_with_their_number(rows, monkeypatch):
    draw = random.Random(17)
    base = [f"b{i}" for i in range(400)]
    texts = [_near(draw, base, 5) for _ in range(400)]
    seen, real = {}, jaccard.tested

    def counted(pairs, content, test, folder, name):
        passed = real(pairs, content, test, folder, name)
        seen[name] = passed.count()
        return passed

    monkeypatch.setattr(jaccard, "tested", counted)
    got = jaccard.jaccard_components(rows("doc_id long, text string", *enumerate(texts))).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == list(enumerate(_components(texts)[1]))
    # A few pairs of each document pass or are tested; all pairs are 79,800.
    assert sum(k for name, k in seen.items() if name == "whole" or name.startswith(("linked", "last"))) < 4 * len(texts)
    assert sum(seen.values()) < 20 * len(texts)


def test_pipeline_cuts_passages_of_51_words(spark, rows):
    draw = random.Random(13)

    def words(n, size):
        return " ".join("".join(draw.choice("abcdefgh") for _ in range(size)) for _ in range(n))

    passages = [words(51, 3), words(51, 6), words(48, 6), words(1, 420)]
    own = [(words(30, 7), words(30, 7)) for _ in range(2 * len(passages))]
    texts = [f"{a} {passages[i // 2]} {b}" for i, (a, b) in enumerate(own)]
    df = rows("doc_id long, text string, n_chars long", *[(i, t, len(t)) for i, t in enumerate(texts)])
    got = {x.doc_id: x for x in corpus_pipeline.suffix_array_dedup(spark, df, "").collect()}
    for i, (a, b) in enumerate(own):
        left = texts[i] if i // 2 == 2 else a + b
        assert got[i].text.replace(" ", "") == left.replace(" ", ""), i
        assert got[i].n_chars == len(got[i].text)


def test_pipeline_stages_keep_what_they_should(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns = docs.columns
    good = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert good.columns == columns and 150 < good.count() <= 200
    single = corpus_pipeline.near_duplicates(spark, docs, folder)
    rows = {x.doc_id: x.text for x in docs.collect()}
    ids = sorted(rows)
    _, root = _components([rows[i] for i in ids])
    assert single.columns == columns
    assert sorted(x.doc_id for x in single.collect()) == [i for i, r in zip(ids, root, strict=True) if ids[r] == i]
    cut = corpus_pipeline.suffix_array_dedup(spark, docs, folder)
    covered = _removed([rows[i].encode() for i in ids], 400)
    whole = {i for i, c in zip(ids, covered, strict=True) if len(c) and c.all()}
    assert cut.columns == columns and {x.doc_id for x in cut.collect()} == set(ids) - whole
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "near_duplicates", "suffix_array_dedup", "personal_data", "best_fit_packing",
    ]


