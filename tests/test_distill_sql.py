"""Distilled texts against their SQL, on documents whose sentences begin and end with digits of their own number."""

import random
from collections import Counter

import duckdb
import pytest

from tidemark.jobs import registry

TEXTS = [
    "0 of 10",
    "0.5 is more than 0. 16.1.2.31 is what this one of the lines says 1. 2 must stand before 22. It is 3",
    "Short one. 10.0.0.1",
    "Red. Blue. 2 of the lines that a table holds must stand in one row of 12. No. 4 is 4. 5 and 5.",
    "# 0 Title 0\nA key is 1. 1 is a key. The service must validate each input before it is stored in table 3",
    "0 Red Fox 0",
    "",
    None,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("distill")
    rows = [(i, text, f"s{i % 2}") for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def equal_to_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    got = registry.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return Counter(map(tuple, got.collect())) == Counter(want) and len(want) > 0


@pytest.mark.parametrize(
    "name",
    ["distill_answer", "distill_question", "distill_summary", "distill_themes", "distill_title", "published_unit_lookups", "semantic_records", "bundle_diagnostics", "approval_gate"],
)
def test_equals_sql(spark, folder, name):
    assert equal_to_sql(spark, folder, name)


def test_bundles_read_documents_once(spark, tmp_path):
    """Each text is read and scored once; units without a source are a bundle too."""
    texts = ["", " ", "#", "A!!! B???", "LOUD WORDS HERE and ONE", "NOt ABc", "12 34 56 x", "a b c d e f", "One. Two.  Three! Four?", "x\n\nx", "  # T \nbody", "1. 22) go", "the of", "äbc-DEF_g ABCä"]
    texts += ["word " * 30 + "end. " + t for t in texts] + ["go on with it. " * 60 + t for t in texts]
    rows = [(i, text, ("s", "t", None)[i % 3]) for i, text in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("bundle_diagnostics", "approval_gate", "noise_flags", "quality_signals", "dedup_key"):
        assert equal_to_sql(spark, str(tmp_path), name), name
    for name in ("bundle_diagnostics", "approval_gate"):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan


def test_texts_are_cut_and_scored_once(spark, folder):
    """A plan that names a step twice takes it twice for every text."""
    first_sentence, score = "[.!?](?= )", "(must|should|"
    wanted = {
        "distill_title": {first_sentence: 1},
        "distill_question": {first_sentence: 1},
        "distill_summary": {score: 1},
        "distill_answer": {score: 1},
        "semantic_records": {first_sentence: 1, score: 1},
        "published_unit_lookups": {"(?<=[.!?]) ": 1},
    }
    for name, steps in wanted.items():
        plan = registry.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert {step: plan.count(step) for step in steps} == steps, name


def test_long_runs_of_names(spark, tmp_path):
    """Names without end, by words and by hyphens, and names that break off in a longer word."""
    texts = ["Word " * 20_000, "Abc1\n\n" * 20_000 + "d", "AB" + "-C2" * 20_000, "Foo Bar BazX", "Foo Bar_ Qux", "AB-CDx EF-GH- IJ-K", "ABc AB_ AB-", "A Bc D Ef9 9Gh", "A1B Cc-Dd EE FFf"]
    r = random.Random(1)
    texts += ["".join(r.choice(["A", "B", "c", "d", "7", "_", "-", " ", " ", "\n"]) for _ in range(r.randrange(80))) for _ in range(400)]
    spark.createDataFrame([(i, text, "s") for i, text in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("distill_themes", "distill_entities", "quality_signals", "bundle_diagnostics"):
        assert equal_to_sql(spark, str(tmp_path), name), name
