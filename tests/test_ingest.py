"""Keyed ingest, cleaning and filters on small hand-written tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from pulsepress.operators import cleaning, filters, ingest, joins, ordering, search


def as_dict(df, key="k", value="v"):
    return {r[key]: r[value] for r in df.collect()}


def test_repeats_inside_a_batch(rows):
    table = rows("k string, v int", ("a", 1))
    batch = rows("k string, v int, n int", ("b", 2, 1), ("b", 3, 2), ("a", 9, 3), ("c", 4, 4))
    kept = ingest.deduplicate(table, batch, ["k"]).collect()
    assert sorted((r["k"], r["v"]) for r in kept) == [("b", 2), ("b", 3), ("c", 4)]
    assert ingest.deduplicate(table, batch, []).count() == 4
    fresh = ingest.new_rows(table, batch, ["k"], [F.col("n").desc()])
    assert as_dict(fresh) == {"b": 3, "c": 4}
    assert as_dict(ingest.insert_if_absent(table, batch.drop("n"), ["k"]).filter("k <> 'b'")) == {"a": 1, "c": 4}
    assert [r["k"] for r in ingest.new_keys(table, batch, ["k"]).orderBy("k").collect()] == ["b", "c"]


def test_shuffled_match_equals_broadcast_match(rows, monkeypatch):
    table = rows("k string, v int", *[(f"k{i}", i) for i in range(50)])
    batch = rows("k string, v int", *[(f"k{i}", -i) for i in range(40, 60)], *[("k59", 0)] * 30)
    small = sorted(map(tuple, ingest.deduplicate(table, batch, ["k"]).collect()))
    for module in (joins, ingest):
        monkeypatch.setattr(module, "fits_broadcast", lambda *a, **k: False)
    assert ingest.insert_if_absent(table, batch, ["k"]).count() == 60
    assert sorted(map(tuple, ingest.deduplicate(table, batch, ["k"]).collect())) == small
    assert len(small) == 40


def test_attach_spreads_a_hot_key(rows):
    facts = rows("url string, source string", *[(f"u{i}", "hot" if i % 3 else f"s{i}") for i in range(300)], ("n", None))
    lookup = rows("source string, name string", ("hot", "H"), ("s0", "zero"))
    expected = sorted(map(repr, joins.attach(facts, lookup, "source").select("url", "name").collect()))
    salted = joins.attach(facts, lookup, "source", limit=-1)
    assert sorted(map(repr, salted.select("url", "name").collect())) == expected
    assert salted.count() == 301 and "__salt" not in salted.columns


def test_update_modes(rows):
    table = rows("k string, v string, w string", ("a", "1", "x"), ("b", "2", "y"))
    batch = rows("k string, v string, w string", ("a", None, "z"), ("zz", "9", "9"))
    assert as_dict(ingest.update(table, batch, ["k"])) == {"a": None, "b": "2"}
    assert as_dict(ingest.update(table, batch, ["k"], nulls="keep")) == {"a": "1", "b": "2"}
    assert as_dict(ingest.update(table, batch, ["k"], ["w"])) == {"a": "1", "b": "2"}
    assert as_dict(ingest.update_present_columns(table, batch.filter("k = 'a'"), ["k"])) == {"a": "1", "b": "2"}
    assert as_dict(ingest.update_present_columns(table, batch, ["k"])) == {"a": None, "b": "2"}
    twice = rows("k string, v string, n int", ("a", "5", 1), ("a", "6", 2))
    assert as_dict(ingest.update(table, twice, ["k"], ["v"], order=[F.col("n").desc()])) == {"a": "6", "b": "2"}


def test_sets_gain_elements(rows):
    table = rows("k string, v array<string>, w string", ("a", ["x", "y"], "old"), ("b", None, "old"), ("c", ["q"], "old"))
    batch = rows("k string, v array<string>, w string", ("a", ["y", "z"], ""), ("b", ["n"], "new"), ("c", [], None))
    result = ingest.add_to_sets(table, batch, ["k"], ["v"])
    assert as_dict(result) == {"a": ["x", "y", "z"], "b": ["n"], "c": ["q"]}
    assert as_dict(result, value="w") == {"a": "old", "b": "new", "c": "old"}


def test_retention_keeps_rows_without_a_time(rows):
    table = rows(
        "k string, collected timestamp_ntz",
        ("old", datetime(2023, 7, 31, 23, 59)), ("edge", datetime(2023, 8, 1)), ("none", None), ("new", datetime(2024, 1, 1)),
    )
    kept = ingest.keep_recent(table, "2024-02-01 15:00:00")
    assert {r["k"] for r in kept.collect()} == {"edge", "none", "new"}
    assert {r["k"] for r in ingest.keep_recent(table, "2024-02-01", "2 years").collect()} == {"old", "edge", "none", "new"}


def test_unprocessed_cleanup_minds_nulls(rows):
    table = rows(
        "k string, kind string, collected timestamp_ntz, cluster_id string, gist string",
        ("stale", "news", datetime(2024, 1, 1), None, None),
        ("no kind", None, datetime(2024, 1, 1), None, None),
        ("made", "AI Generated", datetime(2024, 1, 1), None, None),
        ("clustered", "news", datetime(2024, 1, 1), "c", None),
        ("no time", "news", None, None, None),
        ("fresh", "news", datetime(2024, 1, 30), None, None),
    )
    kept = {r["k"] for r in ingest.drop_unprocessed(table, "2024-02-01").collect()}
    assert kept == {"made", "clustered", "no time", "fresh"}


def test_last_row_counts_even_when_incomplete(rows):
    texts = "url string, kind string, source string, title string, summary string, content string, image_url string, author string"
    batch = rows(
        texts + ", created timestamp_ntz, collected timestamp_ntz, n int",
        ("a", "news", "s", "t", None, "one two\tthree", None, "Ann", None, None, 1),
        ("a ", "news", "s", "  ", None, None, None, "x", None, None, 2),
        (" b", " news", "s", "t\n", " ", "w", None, " ADMIN ", None, None, 3),
    )
    clean = {r["url"]: r for r in cleaning.clean_articles(batch, "2024-02-01", F.col("n")).collect()}
    assert clean.keys() == {"b"}
    assert clean["b"]["author"] is None and clean["b"]["title"] == "t" and clean["b"]["summary"] is None
    assert clean["b"]["summary_length"] == 0 and clean["b"]["created"] == datetime(2024, 2, 1)


def test_word_count_has_a_maximum(rows):
    from pulsepress.functions.text import count_words

    df = rows("t string", ("w " * 40000,), (" a  b ",), (None,))
    assert sorted(r[0] for r in df.select(count_words("t")).collect()) == [0, 2, 32767]


def test_validation_names_the_fields(rows):
    batch = rows(
        "chatter_url string, url string, likes string, comments bigint",
        ("p", "u", "3", 4), ("", "u", "x", -1), (None, None, None, 4294967296),
    )
    good, bad = cleaning.split_valid(batch, "mentions")
    assert [(r["likes"], r["comments"], r["shares"]) for r in good.collect()] == [(3, 4, None)]
    assert sorted(r["problems"] for r in bad.collect()) == [["chatter_url", "likes", "comments"], ["chatter_url", "url", "comments"]]


def test_filters_with_null_elements(rows):
    df = rows(
        "url string, regions array<string>, entities array<string>, categories array<string>",
        ("a", ["US", None], None, ["x"]), ("b", [None], ["New York"], None), ("c", None, None, None),
    )

    def keep(**wanted):
        return {r["url"] for r in df.filter(filters.article_filter(**wanted)).collect()}

    assert keep(tags=["US"]) == {"a"} and keep(tags=["New York", "x"]) == {"a", "b"}
    assert keep(tags=["york new"], match="all") == {"b"} and keep(tags=["us", "X"], match="all") == {"a"}
    assert keep(regions=["us"]) == set() and keep() == {"a", "b", "c"}
    not_us = df.filter(~F.coalesce(filters.overlaps("regions", ["DE"]), F.lit(False)))
    assert not_us.count() == 3


def test_field_tests(rows):
    df = rows("url string, kind string, created timestamp_ntz", ("a", "x", datetime(2024, 1, 1)), ("b", None, None), ("c", "y", datetime(2024, 1, 2)))

    def keep(**wanted):
        return {r["url"] for r in df.filter(filters.match_fields(**wanted)).collect()}

    assert keep(kind={"ne": "x"}) == {"b", "c"} and keep(kind={"exists": True, "ne": "y"}) == {"a"}
    assert keep(created={"lt": date(2024, 1, 2)}) == {"a"} and keep(url=["a", "b"], kind={"exists": False}) == {"b"}


def test_long_key_list_equals_short_one(rows):
    df = rows("url string", *[(f"u{i}",) for i in range(3000)])
    wanted = [f"u{i}" for i in range(0, 6000, 2)]
    assert filters.keep_keys(df, "url", wanted).count() == 1500
    assert filters.keep_keys(df, "url", wanted[:10]).count() == 10


def test_offset_without_limit(rows):
    df = rows("url string, created int", *[(f"u{i:02}", i // 3) for i in range(20)])
    order = [F.col("created").desc(), F.col("url")]
    whole = [r["url"] for r in ordering.page(df, order).collect()]
    assert [r["url"] for r in ordering.page(df, order, offset=7).collect()] == whole[7:]
    assert [r["url"] for r in ordering.page(df, order, limit=5, offset=7).collect()] == whole[7:12]
    assert ordering.page(df, order, offset=50).count() == 0


def test_sample_is_repeatable(rows):
    df = rows("url string", *[(f"u{i}",) for i in range(100)])
    one, two = search.sample(df, 10, seed=1), search.sample(df.repartition(7), 10, seed=1)
    assert {r["url"] for r in one.collect()} == {r["url"] for r in two.collect()}
    assert {r["url"] for r in search.sample(df, 10, seed=2).collect()} != {r["url"] for r in one.collect()}


def test_equal_values_rerank_to_zero(rows):
    df = rows("url string, created timestamp_ntz", ("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1)))
    for bounded in (True, False):
        assert [r["relevance"] for r in search.rerank(df, bounded=bounded).collect()] == [0.0, 0.0]


def test_text_search_counts_standing_words(rows):
    df = rows(
        "url string, title string, summary string, regions array<string>, entities array<string>, categories array<string>",
        ("a", "The cat", "cat cat concatenate", None, None, None),
        ("b", "dogs", None, ["Cat"], None, None),
        ("c", "concat", "category", None, None, None),
    )
    found = {r["url"]: r["search_score"] for r in search.text_search(df, "CAT!").collect()}
    assert found.keys() == {"a", "b"}
    assert abs(found["a"] / found["b"] - 4 / 3) < 1e-9
    assert search.text_search(df, "...").count() == 0


def test_strip_takes_what_python_takes(rows):
    from pulsepress.functions.text import strip

    ends = "".join(chr(i) for i in range(0x3100) if chr(i).isspace())
    texts = [ends + "a b" + ends, ends, "", "​x", "plain", None]
    df = rows("t string", *[(t,) for t in texts])
    expected = [(t.strip() or None) if t else None for t in texts]
    assert [r[0] for r in df.select(strip("t")).collect()] == expected


def test_words_are_what_python_splits(rows):
    from pulsepress.functions.text import count_words

    texts = ["".join(f"x{chr(i)}" for i in range(0x3100) if chr(i).isspace()), " a​b c ", "", None]
    df = rows("t string", *[(t,) for t in texts])
    assert [r[0] for r in df.select(count_words("t")).collect()] == [len(t.split()) if t else 0 for t in texts]
