"""Words and phrases counted in the text: against plain Python, the index, and the SQL of search_phrases."""

import random

import duckdb
import pytest
from test_postings import by_query, expected, scores

from tidemark.jobs import registry
from tidemark.operators import phrases, postings

QUERIES = ["ant", "ant bee", "ant-bee", "bee-bee-cat dog", "elk-elk", "elk-elk-elk", "rare-word", "rare", "zebra ant", "ant-zebra", "", "- !", "ANT cat-dog-elk", "ant ant", "cat-dog cat-dog-elk-ant-bee", None]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(2)
    texts = [" ".join(r.choice(["ant", "bee", "cat", "dog", "Elk"]) + r.choice(["", "", "!", "-"]) for _ in range(r.randrange(40))) for _ in range(300)]
    return [*enumerate(texts), (300, None), (301, ""), (302, "rare word"), (303, "word"), (304, "ant")]


@pytest.mark.parametrize("most", [phrases.MOST_ASKED, 1])
def test_every_word_and_phrase_is_counted(spark, docs, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST_ASKED", most)
    frame = spark.createDataFrame(docs, "doc long, body string").repartition(3)
    got = scores(phrases.scores(frame, "doc", "body", spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")))
    for q, text in enumerate(QUERIES):
        assert expected(docs, text or "") == got.get(q, {}), text


def test_no_queries_no_texts_and_repeated_ids(spark):
    ask = lambda rows, *queries: by_query(phrases.scores(spark.createDataFrame(rows, "id long, text string"), "id", "text", spark.createDataFrame([*enumerate(queries)], "query_id long, query string")))
    assert ask([], "ant", "ant-bee") == {} and ask([(1, None)], "ant", "ant-bee") == {} and ask([(1, "ant")], "", "!") == {}
    got = ask([(1, "ant bee"), (1, "ant ant bee cat"), (2, "cat"), (None, "ant-bee")], "ant", "ant-bee", "bee cat")
    assert {q: sorted(r["id"] for r in rows if r["id"] is not None) for q, rows in got.items()} == {0: [1], 1: [1], 2: [1]}


def test_search_phrases_makes_no_row_of_a_place(spark, tmp_path, monkeypatch):
    """It equals its SQL, and neither builds an index of positions nor joins them."""
    for name in ("build", "occurrences"):
        monkeypatch.delattr(postings, name)
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "the", "a", "lamp", "Übung", "x9"])
    texts = [" ".join(word() for _ in range(r.randrange(60))) for _ in range(200)]
    rows = [(i, text) for i, text in enumerate([*texts, None, "", "the"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [" ".join(word() for _ in range(r.randrange(8))) + "." for _ in range(40)] + [None, "none of these words", texts[5] or "the of the a"]
    spark.createDataFrame([*enumerate(asked)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = registry.queries()["search_phrases"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()['search_phrases']}) ORDER BY 1, 2").fetchall()
    rows = sorted(map(tuple, got.collect()))
    assert [x[:3] for x in rows] == [x[:3] for x in want] and len(want) > 50
    assert [x[3] for x in rows] == pytest.approx([x[3] for x in want], abs=2e-6)
