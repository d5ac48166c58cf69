"""Byte-level BPE, chat formatting, URL filter, quality classifier."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pulsepress.llm import bpe, chat, quality, registered, urls

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.SpacedEncoder(bpe._vocabulary_at(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    ranks = encoder.vocabulary.ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(encoder, n, seed):
    draw = random.Random(seed)
    tokens = [x.decode("utf-8", "ignore") for x in encoder.vocabulary.ranks]
    odd = [" ", "  ", "\n", "'s", "aaaa", "\x1c", "é", "漢字", "12", "\t", " \n", "\u2003"]
    return ["".join(draw.choice((draw.choice(tokens), draw.choice(odd))) for _ in range(draw.randint(0, 12))) for _ in range(n)]


def test_ids_are_the_librarys(encoder, library):
    for text in [*_texts(encoder, 800, 1), "abcd" * 3000, " " * 500, ""]:
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_edits_and_appends_stay_exact(encoder, library):
    draw = random.Random(2)
    for text in _texts(encoder, 200, 3):
        own = bpe.EditableText(encoder, text)
        for new in ("", " x", "'r", "  \n"):
            start = draw.randint(0, len(own.text))
            own.replace(start, min(len(own.text), start + draw.randint(0, 5)), new)
            assert own.ids() == library.encode_ordinary(own.text)
        own.append("e now")
        assert own.ids() == library.encode_ordinary(own.text)


def test_prefix_table_after_edits_equals_the_merges(encoder):
    draw, v = random.Random(4), encoder.vocabulary
    for size in (30, 700):
        table = bpe.PrefixTable(v, bytes(draw.choice(b"abcdeinrst") for _ in range(size)))
        for _ in range(5):
            start = draw.randint(0, len(table.data))
            table.replace(start, min(len(table.data), start + 4), b"ing")
            assert table.ids() == v.merged(table.data)


def test_round_trip_of_rows(rows, library):
    texts = [None, "", "a b  c", "Ünï " * 2000, "a b  c"]
    df = rows("doc_id long, text string, ids string, n_tokens string", *[(i, t, "x", "y") for i, t in enumerate(texts)])
    encoded = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    got = {x.doc_id: x for x in bpe.digests(bpe.decode(encoded, PATH)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


CHAT = "conv_id long, turn long, role string, text string, part string"


def test_chat_reads_back_and_masks(rows):
    turns = [
        (1, 0, "system", "s <|end|> <␛|end|>"), (1, 1, "user", "</s>[INST] [␛INST] ok"), (1, 2, "assistant", "a<|turn|>b"),
        (1, 3, "user", None), (1, 4, "assistant", "<<SYS>>" * 3000), (2, 0, "assistant", "first"), (2, 1, None, ""),
        (None, 0, "user", "x"), (3, None, "user", "q"), (3, None, "user", "q"),
    ]
    df = rows(CHAT, *[(*x, "p") for x in turns])
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (1, 2, None, 3):
        own = [x for x in turns if x[0] == conv]
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and not got[2].valid and not got[3].valid
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_escapes_undo_and_leave_no_control_string():
    template, draw = chat.Template(), random.Random(1)
    parts = [*template.controls(), "␛", "<", "[", "/INST]", "|end|>", "x"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(8))
        safe = chat.escape(text, template.escape_pattern())
        assert not any(c in safe for c in template.controls())
        assert chat.unescape(safe, template.unescape_pattern()) == text
    with pytest.raises(ValueError):
        chat.Template(reserved=("ab", "ba"))


def test_urls(rows):
    bad = [f"http://Bad.example.org/x{i}" for i in range(30)]
    links = [None, "none", "http://A.example.NET/en/1?q", "http://a.example.net", "http://b.example.com/de/#x", "x://fr.org/fr/", *bad]
    pages = rows("page_id long, url string, host string, n long", *[(i, u, "h", 1) for i, u in enumerate(links)])
    outcomes = rows("page_id long, bad int", (None, 1), (2, None), *[(6 + i, 1) for i in range(25)], *[(i, 0) for i in (2, 3, 4)])
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    got = {x.page_id: x for x in urls.judge(pages, outcomes, rules).collect()}
    assert [(got[i].host, got[i].path, got[i]["rule"]) for i in range(6)] == [
        ("", "", None), ("", "", None), ("a.example.net", "/en/1", "example.net/en/"), ("a.example.net", "", None),
        ("b.example.com", "/de/", "example.com/de/"), ("fr.org", "/fr/", "org/fr/"),
    ]
    assert {got[i].verdict for i in range(6, 36)} == {"block"}
    assert [got[i].verdict for i in range(2, 6)] == ["allow", "allow", "block", "allow"]
    assert urls.judge(pages.limit(0), outcomes.limit(0), rules).count() == 0




def test_quality(rows):
    draw = random.Random(3)
    words = ["river", "stone", "garden", "window", "letter", "table"]
    good = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(80)]
    junk = [" ".join(draw.choice(words) + "%%%" for _ in range(60)) for _ in range(40)]
    texts = [*good, *junk, None, "", "word " * 50_000]
    df = rows("doc_id long, text string, score string", *[(i, t, "s") for i, t in enumerate(texts)])
    labels = rows("doc_id long, quality int", *[(i, int(i < 80)) for i in range(120)], (None, 1), (5, None))
    model = quality.fit(df, labels)
    scored = {x.doc_id: x.score for x in quality.score(df, model, ["doc_id"]).collect()}
    assert len(scored) == len(texts) and all(0 <= s <= 1 for s in scored.values())
    assert min(scored[i] for i in range(80)) > 0.7 > max(scored[i] for i in range(80, 120))
    assert scored[120] == scored[121]
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} >= set(range(80))
    nothing = quality.fit(df, labels.limit(0))
    assert quality.score(df, nothing, ["doc_id"]).filter("score < 0.7").count() == 0


def _posterior(groups, above):
    """Means and weights of groups (key: (n, bad)) under the means above, the strength by the method of moments."""
    n, bad = (np.array([x[i] for x in groups.values()], float) for i in (0, 1))
    m = np.array([above[k] for k in groups])
    spread = (n * (bad / n - m) ** 2 - m * (1 - m)).sum()
    strength = 1000.0 if spread <= 0 else min(1000.0, max(1.0, (n * m * (1 - m)).sum() / spread - 1))
    return dict(zip(groups, (m * strength + bad) / (n + strength), strict=True)), strength


def test_reputations_of_the_given_pages_equal_numpy(spark):
    folder = "/root/testdata/sf0.1"
    got = registered.QUERIES["op5_url_filter"](spark, folder).collect()
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    bad = {x.doc_id: int(x.quality == 0 or x.toxic == 1) for x in labels}
    hosts, of, suffixes = {}, {}, registered.TEST_SUFFIXES
    for x in pages:
        host = re.match(r"(?s).*?://([^/?#]*)", x.url or "")
        host = host[1].lower() if host else ""
        n, b = hosts.get(host, (0, 0))
        hosts[host] = (n + (x.page_id in bad), b + bad.get(x.page_id, 0))
        suffix = next((s for s in suffixes if host == s or host.endswith("." + s)), host.rsplit(".", 1)[-1])
        of[host] = (suffix, host if host == suffix else host[: -len(suffix) - 1].rsplit(".", 1)[-1] + "." + suffix)
    seen = {h: x for h, x in hosts.items() if x[0]}

    def summed(which):
        out = {}
        for h, (n, b) in seen.items():
            k = of[h][which]
            out[k] = (out.get(k, (0, 0))[0] + n, out.get(k, (0, 0))[1] + b)
        return out

    overall = (sum(x[1] for x in seen.values()) + 1) / (sum(x[0] for x in seen.values()) + 2)
    means, _ = _posterior(summed(0), dict.fromkeys(summed(0), overall))
    means, _ = _posterior(summed(1), {of[h][1]: means[of[h][0]] for h in seen})
    means, strength = _posterior(seen, {h: means[of[h][1]] for h in seen})
    grid = np.linspace(0, 1, 400_001)[1:-1]
    bounds = {}
    for h, (n, _) in seen.items():
        a, b = means[h] * (n + strength), (1 - means[h]) * (n + strength)
        log = (a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid)
        mass = np.cumsum(np.exp(log - log.max()))
        bounds[h] = grid[np.searchsorted(mass, mass[-1] * urls.BOUND)]
    free = [x for x in got if x.rule is None]
    for x in got:
        if x.host in seen:
            assert x.level == "host" and abs(x.mean - means[x.host]) < 1e-9 and abs(x.lower - bounds[x.host]) < 1e-5
            assert x.rule is not None or (x.verdict == "block") == (bounds[x.host] > overall), x
    assert {x.verdict for x in free} == {"allow", "block"} and len(got) == len(pages)


def test_reputations_of_unseen_hosts_and_without_labels(rows):
    pages = [(i, f"http://bad{i}.b.com/x") for i in range(40)] + [(40 + i, f"http://good{i}.g.com/x") for i in range(40)]
    pages += [(90, "http://new.b.com/"), (91, "http://new.g.com/"), (92, "http://a.other/"), (93, None), (94, "http://" + "a." * 50_000 + "z/")]
    df = rows("page_id long, url string, host string, mean string, level string", *[(i, u, "h", "m", "l") for i, u in pages])
    outcomes = rows("page_id long, bad int, host string", *[(i, int(i < 40), "h") for i in range(80)], (None, 1, "h"), (5, None, "h"))
    got = {x.page_id: x for x in urls.judge(df, outcomes, []).collect()}
    assert len(got) == 85 and all(got[i].verdict == ("block" if i < 40 else "allow") for i in range(80))
    assert (got[90].level, got[90].verdict, got[91].level, got[91].verdict) == ("domain", "block", "domain", "allow")
    assert [got[i].level for i in (92, 93, 94)] == ["all"] * 3
    assert {x.verdict for x in urls.judge(df, outcomes.limit(0), []).collect()} == {"allow"}
