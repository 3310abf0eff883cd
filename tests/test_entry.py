"""The driver contract: what is registered runs, and equals its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(map(show, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, sql, name):
    got = registry.queries()[name](spark, sf_dir)
    want = sql.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 10


def test_library_does_not_import_the_llm_subpackage():
    root = Path(contract.__file__).parent
    for path in (root / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text(), path
