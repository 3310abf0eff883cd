"""Session memory: filtered listing, the last entries, assembled context, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"


def last_entries(records: DataFrame, limit: int | None = None, **equal: str) -> DataFrame:
    """Records (session_id, created, text, ...) that match, the last ``limit`` of each session."""
    for name, value in equal.items():
        records = records.where(F.col(name) == value)
    if limit is None:
        return records
    newest = Window.partitionBy("session_id").orderBy(F.desc("created"))
    return records.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= limit).drop("__n")


def assemble(records: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """The texts of each session in the order of their creation, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created", "text"))), lambda x: x["text"])
    return records.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), F.array_join(ordered, separator).alias("context"))


def prompt(question: Column, context: Column, memory: Column) -> Column:
    """The request for an answer from the given context only."""
    said = F.when(F.trim(memory) != "", F.concat(F.lit("Memory context:\n\n"), F.trim(memory), F.lit("\n\n"))).otherwise("")
    return F.concat(
        F.lit("You are a helpful assistant. Answer the question using only the provided context. If the answer cannot be found in the context, say so.\n\n"),
        said,
        F.lit("Retrieved context:\n\n"),
        context,
        F.lit("\n\nQuestion: "),
        question,
        F.lit("\n\nAnswer:"),
    )
