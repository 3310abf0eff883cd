"""Ranking of keyword results: the best per query, and scores from 0 to 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best per query by rounded score, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rounded = scores.withColumn("score", F.round("score", digits))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_max(ranked: DataFrame) -> DataFrame:
    """Scores of each result list from 0 (worst) to 1 (best); 1 where all are equal."""
    own = Window.partitionBy("query_id")
    low, span = F.min("score").over(own), F.max("score").over(own) - F.min("score").over(own)
    return ranked.withColumn("score", F.when(span == 0, F.lit(1.0)).otherwise((F.col("score") - low) / span))
