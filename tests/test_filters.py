import pytest

from tidemark.functions.filters import Field, cli_filter, compile_filter, filter_errors


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(
        [(1, 2020.0, "draft", True), (2, 2023.0, "final", False), (3, None, None, None)], "id int, year double, status string, open boolean"
    )
    return df, {"year": Field(df.year, "number"), "status": Field(df.status, "string"), "open": Field(df.open, "boolean")}


@pytest.mark.parametrize(
    ("document", "ids"),
    [
        ({"status": "draft"}, {1}),
        ({"status": ["draft", "final", 5]}, {1, 2}),
        ({"status": None}, {1, 2, 3}),
        ({"year": {"$gte": 2020, "$lt": 2023}}, {1}),
        ({"year": {"$gt": 2020}}, {2}),
        ({"year": {"$gt": "2020"}}, set()),
        ({"year": "2020"}, set()),
        ({"status": {"$gt": "e"}}, {2}),
        ({"status": {"$ne": "draft"}}, {2, 3}),
        ({"year": {"$in": [2020, 1]}}, {1}),
        ({"year": {"$in": 2020}}, set()),
        ({"year": {"$nin": [2020]}}, {2, 3}),
        ({"year": {"$nin": 2020}}, {1, 2, 3}),
        ({"year": {"$like": 1}}, set()),
        ({"open": True}, {1}),
        ({"open": 1}, set()),
        ({"absent": 1}, set()),
        ({"absent": {"$ne": 1}}, {1, 2, 3}),
        ({"status": "final", "year": {"$gt": 2000}}, {2}),
        ("no document", {1, 2, 3}),
        ({}, {1, 2, 3}),
    ],
)
def test_truth_table(rows, document, ids):
    df, fields = rows
    assert {r.id for r in df.where(compile_filter(document, fields)).collect()} == ids


def test_plain_comparisons_reach_the_scan(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = e.where(compile_filter({"event_type": "click"}, {"event_type": Field(e.event_type, "string")}))._jdf.queryExecution().toString()
    assert "EqualTo(event_type,click)" in plan


def test_command_line_options():
    assert cli_filter("a", None, "table") == {"source_uri": "a", "chunk_label": "table"}
    with pytest.raises(ValueError):
        cli_filter(content_type="exe", known_types=("txt",))


def test_filter_errors():
    good = {"a": "x", "b": 1, "c": None, "d": True, "e": ["x", 2], "f": {"$gt": 1, "$ne": None, "$in": ["x"], "$like": {}}}
    assert filter_errors(good) == [] == filter_errors({})
    assert filter_errors([1]) == ["a filter is a mapping"]
    bad = {"a": [True], "b": {"$gt": True, "$in": "x", "$nin": [None], "$ne": [1]}, 3: "x", "c": object()}
    assert filter_errors(bad) == ["a: unfit value", "b.$gt: unfit value", "b.$in: unfit value", "b.$nin: unfit value", "b.$ne: unfit value", "3: a field name is a string", "c: unfit value"]
