"""The inverted index against plain Python, and vector search with vectors that cannot be scored."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import postings, search, shards


def bm25(n, df, tf, length, mean):
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (mean or 1.0)))


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def expected(docs, query):
    """Scores by a scan of all documents."""
    parts = [p for p in map(words_of, query.split()) if p]
    terms = {i: words_of(t) for i, t in docs}
    mean = sum(map(len, terms.values())) / len(terms)
    count = lambda t, p: sum(t[k : k + len(p)] == p for k in range(len(t)))
    tfs = [{i: c for i, t in terms.items() if (c := count(t, p))} for p in parts]
    return {i: sum(bm25(len(docs), len(tf), tf[i], len(terms[i]), mean) for tf in tfs) for i in terms if tfs and all(i in tf for tf in tfs)}


@pytest.fixture(scope="module")
def docs():
    r = random.Random(1)
    return [(i, " ".join(r.choice(["ant", "bee", "cat", "dog", "Elk"]) + r.choice(["", "", "!", "-"]) for _ in range(r.randrange(1, 40)))) for i in range(80)] + [(80, None), (81, ""), (82, "rare word")]


def scores(frame):
    return {q: {r["id"]: pytest.approx(r["score"]) for r in rows} for q, rows in by_query(frame).items()}


def by_query(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_keywords_and_phrases(spark, docs):
    queries = ["ant", "ant bee", "ant-bee", "bee-bee-cat dog", "elk-elk", "rare", "zebra ant", "ant-zebra", "", "- !", "ANT cat-dog-elk", "ant ant"]
    index = postings.build(spark.createDataFrame(docs, "id long, text string").repartition(5), "id", "text")
    got = scores(postings.keyword_scores(index, spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")))
    for q, text in enumerate(queries):
        assert expected(docs, text) == got.get(q, {}), text


def test_more_queries_than_are_named_to_the_scan(spark, docs, monkeypatch):
    monkeypatch.setattr(postings, "NAMED", 1)
    index = postings.build(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    got = scores(postings.keyword_scores(index, spark.createDataFrame([(1, "ant bee"), (2, "cat-dog")], "query_id long, query string")))
    assert got == {1: expected(docs, "ant bee"), 2: expected(docs, "cat-dog")}


def test_shards_find_what_the_index_finds(spark, docs, monkeypatch):
    """And pass on no more than each query's best."""
    queries = ["ant", "ant bee", "bee cat dog", "rare", "zebra ant", "", "ant ant bee", "rare elk"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    monkeypatch.setattr(shards, "SHARD", 20)
    frame = spark.createDataFrame(docs, "id long, text string").withColumn("held", F.col("id") % 3 > 0)
    got = by_query(shards.best(shards.pack(frame), asked, 5))
    for q, text in enumerate(queries):
        want = sorted((-round(s, 6), i) for i, s in expected(docs, text).items() if i % 3)[:5]
        assert [(r["id"], r["rank"]) for r in sorted(got.get(q, []), key=lambda r: r["rank"])] == [(i, n + 1) for n, (_, i) in enumerate(want)], text
    assert shards.best(shards.pack(frame.limit(0)), asked, 5).count() == 0
    twice = spark.createDataFrame([(1, "ant"), (1, "ant bee"), (None, "ant"), (2, "bee")], "id long, text string").withColumn("held", F.lit(True))
    assert sorted((r["query_id"], r["id"]) for r in shards.best(shards.pack(twice), asked, 5).collect()) == [(0, 1), (1, 1), (6, 1)]


def test_index_of_the_asked_terms_alone(spark, docs, monkeypatch):
    """It finds what the whole index finds, and holds no posting besides."""
    queries = ["ant", "bee-cat dog", "rare", "zebra", ""]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    frame = spark.createDataFrame(docs, "id long, text string")
    for named in (postings.NAMED, 1):
        monkeypatch.setattr(postings, "NAMED", named)
        index = postings.build(frame, "id", "text", asked=postings.asked_words(asked))
        assert {r["term"] for r in index.postings.select("term").collect()} == {"ant", "bee", "cat", "dog", "rare"}
        got = scores(postings.keyword_scores(index, asked))
        for q, text in enumerate(queries):
            assert expected(docs, text) == got.get(q, {}), text
        pieces = spark.createDataFrame([(1, "nt b"), (2, "beebee")], "query_id long, query string")
        index = postings.build(frame, "id", "text", postings.trigram_terms, asked=postings.query_trigrams(pieces))
        got = scores(postings.substring_scores(index, pieces))
        assert substrings(docs, "nt b") == got.get(1, {}) and substrings(docs, "beebee") == got.get(2, {})


def substrings(docs, query):
    texts = {i: (t or "").lower() for i, t in docs}
    pieces = [p for p in query.lower().split() if len(p) >= 3]
    mean = sum(max(0, len(t) - 2) for t in texts.values()) / len(texts)
    count = lambda t, p: sum(t.startswith(p, k) for k in range(len(t)))
    tfs = [{i: c for i, t in texts.items() if (c := count(t, p))} for p in pieces]
    return {i: sum(bm25(len(docs), len(tf), tf[i], max(0, len(texts[i]) - 2), mean) for tf in tfs) for i in texts if tfs and all(i in tf for tf in tfs)}


def test_substrings_of_any_script(spark, docs):
    more = [(90, "すべての人間は生れながらにして自由であり"), (91, "모든 인류 구성원의 천부의 존엄성과"), (92, "人人生而自由在尊严和权利上一律平等"), (93, "自由であり自由であり"), (94, "aaaaaa"), (95, "x\n\ny😀z😀z😀")]
    rows = docs + more
    queries = ["自由であり", "生れながら", "自由", "인류 구성원의", "aaa", "aaaa", "nt b", "ant! cat", "z😀z", "at dog", "bee-", "nothing here", "x\n", "", None, "tbee"]
    index = postings.build(spark.createDataFrame(rows, "id long, text string"), "id", "text", postings.trigram_terms)
    got = scores(postings.substring_scores(index, spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")))
    for q, text in enumerate(queries):
        assert substrings(rows, text or "") == got.get(q, {}), text


def test_empty_table_and_repeated_ids(spark):
    queries = spark.createDataFrame([(1, "ant"), (2, "ant-bee")], "query_id long, query string")
    for terms_of, find in ((postings.word_terms, postings.keyword_scores), (postings.trigram_terms, postings.substring_scores)):
        for rows in ([], [(1, None)]):
            index = postings.build(spark.createDataFrame(rows, "id long, text string"), "id", "text", terms_of)
            assert find(index, queries).count() == 0
    twice = postings.build(spark.createDataFrame([(1, "ant bee"), (1, "ant bee"), (1, "ant ant bee cat"), (2, "cat")], "id long, text string"), "id", "text")
    assert sorted((r["query_id"], r["id"]) for r in postings.keyword_scores(twice, queries).collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_vectors_that_cannot_be_scored_take_no_part(spark, metric):
    r = random.Random(3)
    nan, inf = float("nan"), float("inf")
    good = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    bad = [(1000, [nan] * 4), (1001, [1.0, None, 1.0, 1.0]), (1002, [inf, 0.0, 0.0, 0.0]), (1003, None), (1004, []), (None, [9.0, 9.0, 9.0, 9.0]), (1005, [1.0, nan, -inf, 0.0])]
    asked = [(1, good[0][1]), (2, good[7][1]), (3, [nan, 1.0, 1.0, 1.0]), (4, None), (None, good[1][1])]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    queries = frame(asked, "query_id long, q array<double>")
    both = [sorted(map(tuple, search.nearest(frame(rows, "vec_id long, embedding array<double>"), queries, 5, metric).collect())) for rows in (good, good + bad * 20)]
    assert both[0] == both[1]
    assert {x[0] for x in both[0]} == {1, 2} and len(both[0]) == 10
    assert search.nearest(frame(bad, "vec_id long, embedding array<double>"), queries, 5, metric).count() == 0
