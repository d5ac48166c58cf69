"""Alignment of two tokenizers, against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from pulsepress.llm import alignment
from pulsepress.llm.registered import QUERIES

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1]), {i: t for t, i in alignment.byte_level_tokens(FILES[0]).items()}


def _spans(ids, sizes):
    ends = np.cumsum([sizes(i) for i in ids]).tolist()
    return list(zip([0, *ends[:-1]], ends, ids, strict=True))


def brute(texts, libraries):
    """By text: a, b, groups, links, best links, sum of counts, hash."""
    a, b, names = libraries

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    own = []
    for text in texts:
        whole = f" {text or ''}".encode()
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        if b"".join(map(piece, ids_b)) != whole or b"".join(map(names.get, ids_a)) != whole:
            own.append(None)
            continue
        in_a, in_b = _spans(ids_a, lambda i: len(names[i])), _spans(ids_b, lambda i: len(piece(i)))
        both = sorted({e for _, e, _ in in_a} & {e for _, e, _ in in_b})
        groups, links, start = [], Counter(), 0
        for end in both:
            ga = [x for x in in_a if start <= x[0] < end]
            gb = [x for x in in_b if start <= x[0] < end]
            groups.append(",".join(str(x[2]) for x in ga) + "|" + ",".join(str(x[2]) for x in gb))
            links.update((x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1])
            start = end
        own.append((len(ids_a), len(ids_b), groups, links))
    docs = Counter(pair for x in own if x for pair in x[3])
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    out = []
    for x in own:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        best = sum(n for p, n in links.items() if docs[p] == most[p[0]])
        total = sum(n * docs[p] for p, n in links.items())
        out.append((n_a, n_b, len(groups), sum(links.values()), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, docs, sum((x[3] for x in own if x), Counter())


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "a  b", " lead", "end ", "\n\n x", "a▁b", "▁", "\x00nul\x1c z", "\tid　 b", "漢字 é <0x0A> <s> <|endoftext|>",
    "the river the river", "the river the river", "word " * 1500, "x" * 3000 + " " * 500,
]


def test_counts_of_odd_texts(rows, libraries):
    schema = "doc_id long, text string, n string, row string, a string, chunk string"
    df = rows(schema, *[(i % 14, t, "n", "r", "a", "c") for i, t in enumerate(ODD)], (None, "the river", None, None, None, None))
    want, docs, links = brute([*ODD, "the river"], libraries)
    got = alignment.align(df, *FILES, public_tokenizers.PATTERN, ["doc_id", "a"]).collect()
    ids = [*[(i % 14, "a") for i in range(len(ODD))], (None, None)]
    assert sorted(map(repr, ((x.doc_id, x.a, *(x[c] for c in COLUMNS)) for x in got))) == sorted(
        repr((*i, *w)) for i, w in zip(ids, want, strict=True)
    )
    pairs = alignment.pair_counts(df, *FILES, public_tokenizers.PATTERN).collect()
    assert {(x.a, x.b): (x.docs, x["links"]) for x in pairs} == {p: (docs[p], links[p]) for p in docs}
    assert alignment.align(df.limit(0), *FILES, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_registered_query(spark, libraries):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = brute([x.text for x in docs], libraries)
    got = {x.doc_id: tuple(x[c] for c in COLUMNS) for x in QUERIES["op11_alignment"](spark, SMALL).collect()}
    assert got == {x.doc_id: w for x, w in zip(docs, want, strict=True)}


def test_blocks_and_forgetting_change_nothing(spark, monkeypatch):
    own = alignment.Aligner(*FILES, public_tokenizers.PATTERN)
    texts = ["a b a", "b c", "a  d", "c" * 80]
    once = [own.chunks(t) for t in texts]
    own.learn()
    first = ["".join(own.groups[i] for i in x) for x in once]
    own.forget()
    again = [own.chunks(t) for t in reversed(texts)]
    own.learn()
    assert ["".join(own.groups[i] for i in x) for x in again][::-1] == first


@pytest.mark.parametrize("n", [0, 1, alignment.DENSE, alignment.DENSE + 1, alignment.CHUNK])
def test_bitmaps_unpack(n):
    draw = np.random.default_rng(n)
    low = np.concatenate([np.sort(draw.choice(alignment.CHUNK, k, replace=False)) for k in (3, n, 2)]).astype(np.int64)
    row = np.repeat([0, 1, 2], [3, n, 2])
    sizes, bits = alignment.pack(row, low, 3)
    assert sizes.tolist() == [3, n, 2]
    got = sorted(zip(*(x.tolist() for x in alignment.unpack(bits)), strict=True))
    assert got == list(zip(row.tolist(), low.tolist(), strict=True))


def test_merging_is_an_or():
    _, one = alignment.pack(np.array([0, 0]), np.array([1, 5]), 1)
    _, two = alignment.pack(np.zeros(1500, int), np.arange(1500), 1)
    lists = pa.ListArray.from_arrays(pa.array([0, 2], pa.int32()), pa.concat_arrays([one, two]))
    key = [pa.array([0])] * 4
    (got,) = alignment._merged(iter([pa.RecordBatch.from_arrays([*key, lists], names=["a", "b", "chunk", "plane", "parts"])]))
    assert got.column(5).to_pylist() == [1500]
    assert alignment.unpack(got.column(4))[1].tolist() == list(range(1500))
