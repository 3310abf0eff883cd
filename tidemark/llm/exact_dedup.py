"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Digests of all texts are written once. A Misra-Gries summary (Spark's ``freqItems``, which merges
bounded counters per partition) names the digests that may hold more than ``support`` of the rows;
an exact, map-side combined count verifies them. The verified winners number at most
``1 / support``, so they are broadcast and their groups are settled without a shuffle. All other
digests go through an ordinary shuffle, where no group can be large: the support falls as the table
grows, so that a group left to it has ``LIGHT_ROWS`` rows at most, down to the least that the summary
takes; beyond 5e8 rows it is that share of the rows, which the window spills to disk.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays (a
null id is smaller than any other); rows that repeat id and text form one group of which exactly one
row stays; an empty table gives an empty result; further columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Share of all rows from which a group of copies is settled map-side; at most 1 / share groups.
SUPPORT, LEAST_SUPPORT = 0.001, 0.0001
#: Rows that a group settled by a shuffle should not exceed.
LIGHT_ROWS = 50_000


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def heavy_groups(digests: DataFrame, support: float) -> DataFrame:
    """Digest, row count and best row of each digest that holds ``support`` of the rows or more."""
    total = digests.count()
    support = min(support, max(LEAST_SUPPORT, LIGHT_ROWS / max(1, total)))
    candidates = digests.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    return (
        digests.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("heavy_size"), F.max(F.struct("doc_id", "row_no")).alias("heavy_best"))
        .where(F.col("heavy_size") >= max(2, int(support * total)))
    )


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(
        df.select(
            df[id_col].alias("doc_id"),
            text_digest(df[text_col]).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    heavy = materialize(heavy_groups(digests, support), "heavy-digests")
    marked = digests.join(F.broadcast(heavy), "text_sha256", "left")
    group = Window.partitionBy("text_sha256")
    light = marked.where("heavy_size IS NULL").select(
        "doc_id",
        "row_no",
        "text_sha256",
        F.count(F.lit(1)).over(group).alias("group_size"),
        F.max(F.struct("doc_id", "row_no")).over(group).alias("best"),
    )
    settled = marked.where("heavy_size IS NOT NULL").select(
        "doc_id", "row_no", "text_sha256", F.col("heavy_size").alias("group_size"), F.col("heavy_best").alias("best")
    )
    return light.unionByName(settled).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """The rows of ``df`` that stay, with their columns."""
    digests = materialize(
        df.select(
            df[id_col].alias("doc_id"),
            text_digest(df[text_col]).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    heavy = heavy_groups(digests, support).select("text_sha256", F.col("heavy_best.doc_id").alias("best"), F.lit(True).alias("heavy"))
    # The row travels as one struct, so that none of its columns can clash with those beside it.
    rows = df.select(F.struct("*").alias("row"), df[id_col].alias("doc_id"), text_digest(df[text_col]).alias("text_sha256"))
    best_first = Window.partitionBy("text_sha256").orderBy(F.col("doc_id").desc_nulls_last())
    return (
        rows.join(F.broadcast(materialize(heavy, "heavy-digests")), "text_sha256", "left")
        .where(F.col("heavy").isNull() | F.col("doc_id").eqNullSafe(F.col("best")))
        .withColumn("place", F.row_number().over(best_first))
        .where("place = 1")
        .select("row.*")
    )
