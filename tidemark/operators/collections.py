"""The registry of collections: requests to create and delete, in order, and the collections that remain.

requests: (seq, collection_id, action, dimension, metric, model, schema_version, quantization, m, ef_construction, ef_search), of
which a deletion needs the first three. Deletion is soft: the rows of the requests stay, and an id may be created again.

Defined results: null parameters are refused like those out of range; requests of one ``seq`` and id are taken in the order create, delete;
an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a collection may be created with.
METRICS = ("cosine", "l2", "dot")
QUANTIZATIONS = ("fp16", "sq8")
RANGES = {"m": (4, 64), "ef_construction": (50, 800), "ef_search": (10, 500)}


def create_error() -> Column:
    """Why a request to create is refused, or null."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = (
        F.when(blank("collection_id"), "no collection")
        .when(F.coalesce("dimension", F.lit(0)) <= 0, "dimension is not positive")
        .when(~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False)), "unknown metric")
        .when(blank("model"), "no model")
        .when(blank("schema_version"), "no schema version")
        .when(~F.coalesce(F.col("quantization").isin(*QUANTIZATIONS), F.lit(False)), "unknown quantization")
    )
    for name, (low, high) in RANGES.items():
        why = why.when(~F.coalesce(F.col(name).between(low, high), F.lit(False)), f"{name} is not from {low} to {high}")
    return why


def judge(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``requests`` with their outcome: created, deleted, or why they are refused; known: ids (collection_id) that are live beforehand.

    After any valid request its action alone tells whether the id is live, so the last valid one before a request decides it.
    """
    rows = requests.withColumn("error", F.when(F.col("action") == "create", create_error()).when(F.coalesce(F.col("action") != "delete", F.lit(True)), "unknown action"))
    before = Window.partitionBy("collection_id").orderBy("seq", "action").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("error").isNull(), F.col("action")), ignorenulls=True).over(before)
    rows = rows.withColumn("before", last)
    if known is not None:
        rows = rows.join(known.select("collection_id").distinct().withColumn("known", F.lit("create")), "collection_id", "left")
        rows = rows.withColumn("before", F.coalesce("before", "known")).drop("known")
    is_live = F.coalesce(F.col("before") == "create", F.lit(False))
    creates = F.when(is_live, "already exists").otherwise("created")
    outcome = F.coalesce("error", F.when(F.col("action") == "create", creates).when(is_live, "deleted").otherwise("not found"))
    return rows.withColumn("outcome", outcome).drop("error", "before")


def live(judged: DataFrame) -> DataFrame:
    """The request that created each collection which the requests leave live."""
    order = Window.partitionBy("collection_id").orderBy(F.desc("seq"), F.desc("action"))
    done = judged.where(F.col("outcome").isin("created", "deleted"))
    return done.withColumn("__n", F.row_number().over(order)).where("__n = 1 AND outcome = 'created'").drop("__n", "outcome")
