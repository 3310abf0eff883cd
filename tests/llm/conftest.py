import random

import pytest
from pyspark.sql import types as T

CLASHING = ["row", "id", "digest", "text_sha256", "best", "heavy", "place", "hash", "kept_id", "copies", "spans", "t", "r", "live_id", "rewritten", "__n", "__id", "__digest", "units"]
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use themselves
        T.StructField("kept", T.StringType()),
        T.StructField("row_no", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        *[T.StructField(name, T.StringType()) for name in CLASHING],
    ]
)


@pytest.fixture(scope="session")
def table(spark):
    """A documents table, with clashing columns, from texts or (doc_id, text) pairs."""

    def make(texts, lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 3}", "x", 7, None, *CLASHING) for i, t in rows], DOCUMENTS).repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    """A maker of texts of n words from a small vocabulary, so that shorter runs repeat."""

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
