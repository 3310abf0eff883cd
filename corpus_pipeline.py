"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.

Defined results: a text that is null, empty or without a letter goes with the first stage. Of rows with equal texts
the one with the largest doc_id stays (a null id is smaller than any other), of rows that repeat id and text exactly
one. Of near copies the least doc_id stays; texts of fewer than five words are near copies only of the same words.
A null ``source`` is an owner of its own, a null ``lang`` is not learned from, and with no ``lang`` at all every
text with a letter stays. Texts of any length are taken whole. An empty table gives no sequence. Further columns,
whatever their names, travel along to the last stage and play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.jaccard_join import drop_near_copies
from tidemark.llm.packing import pack
from tidemark.llm.queries import vocabulary_path
from tidemark.llm.secret_scan import redact_live
from tidemark.session import materialize, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, those that are null or have no letter, go."""
    model = langid.train(docs.select("doc_id", "text", "lang"), vocabulary_path())
    return langid.keep_identified(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one with the least doc_id stays."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced in the text; every document stays."""
    return redact_live(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 4096 tokens."""
    return pack(docs, vocabulary_path())


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("sequences", sequences),
]

#: The stages on language, near copies and packing have no form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
