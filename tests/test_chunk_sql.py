"""The chunkers against their SQL on texts with headings, fences, tables, lists and time stamps."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from tidemark.jobs import registry
from tidemark.operators.chunking import CHUNKERS

LINES = [
    "# One", "## Two  x", "#no", "", "", "   ", "```py", "```", "  ```", "| a | b |", "|x|", "- item", "1. first", "-", "* s",
    "2024-01-01 10:00:00 start", "[2024-01-01T10:00:00] go", "  trace", "A sentence. Another one? ä ö – three!", "word " * 60,
    "long. " * 40, "x" * 900, "Columns: a, b", "a: 1, b: 2",
]


def texts():
    rng = random.Random(5)
    made = ["", " ", "\n", "Columns: a", "Columns: a\n", "y" * 2500, "p. q\n\n" * 400, "2024-01-01 10:00:00", "Columns: " + "c" * 900 + "\nr\ns"]
    made += ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return made + ["Columns: a, b\n" + "\n".join("a: 1, b: " + "z" * rng.randint(0, 99) for _ in range(40)) for _ in range(5)]


@pytest.mark.parametrize("name", sorted(CHUNKERS))
def test_chunker_equals_sql(name):
    made = texts()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(len(made)), "text": made, "source": ["s"] * len(made)}))
    want = con.execute(f'SELECT doc_id, pos, label, "offset", length, text_sha256 FROM ({registry.oracle_sql()[f"chunk_{name}"]})').fetchall()
    got = [
        (i, pos, label, at, len(chunk), hashlib.sha256(chunk.encode()).hexdigest())
        for i, text in enumerate(made)
        for pos, (chunk, label, at) in enumerate(CHUNKERS[name](text, 800, 120) if text else [])
    ]
    assert sorted(want) == got
