"""Publication of semantic bundles as table transformations.

bundles: (bundle_id, doc_id, status, collection_id, published_at), the last two null while unpublished.
Requests hold one row per bundle; of several for one document and collection the first by bundle id
counts, the others are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_bundles(bundles: DataFrame) -> DataFrame:
    """The published bundle of each document and collection: the latest, then the greatest id."""
    order = Window.partitionBy("doc_id", "collection_id").orderBy(F.desc("published_at"), F.desc("bundle_id"))
    return bundles.where("collection_id IS NOT NULL").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def unit_lookups(units: DataFrame, bundles: DataFrame, spans: DataFrame) -> DataFrame:
    """Record id, source and provenance of every published unit: inner joins on bundle and first span."""
    first = spans.where("span_index = 0").select("bundle_id", "unit_id", "source_uri", F.col("chunk_id").alias("dedupe_key"))
    live = bundles.where("collection_id IS NOT NULL").select("bundle_id", "collection_id")
    return (
        units.join(live, "bundle_id")
        .join(first, ["bundle_id", "unit_id"])
        .select(F.concat(F.lit("semantic:"), F.col("unit_id")).alias("chunk_id"), "collection_id", "title", "source_uri", "dedupe_key")
    )


def judge(bundles: DataFrame, requests: DataFrame, action: str = "publish") -> DataFrame:
    """Requests (bundle_id, to_collection, replace) with the bundle they replace and why they are refused."""
    live = live_bundles(bundles).select(F.col("doc_id").alias("d"), F.col("collection_id").alias("c"), F.col("bundle_id").alias("live_id"))
    rows = requests.join(bundles.select("bundle_id", "doc_id", "status"), "bundle_id").join(
        live, (F.col("doc_id") == F.col("d")) & (F.col("to_collection") == F.col("c")), "left"
    )
    turn = F.row_number().over(Window.partitionBy("doc_id", "to_collection").orderBy("bundle_id"))
    other = F.col("live_id").isNotNull() & (F.col("live_id") != F.col("bundle_id"))
    reason = F.when(F.col("status") != "approved", "not approved")
    if action == "rollback":
        reason = reason.when(F.col("live_id").isNull(), "nothing to roll back").when(~other, "already live")
    reason = reason.when(other & ~F.col("replace"), "another bundle is live").when(F.col("turn") > 1, "another request comes first")
    return rows.withColumn("turn", turn).select(
        "bundle_id", "doc_id", "to_collection", F.when(other, F.col("live_id")).alias("replaced_id"), reason.alias("refused")
    )


def publish(bundles: DataFrame, judged: DataFrame, published_at: Column) -> DataFrame:
    """``bundles`` after the requests that weren't refused: theirs live, those they replace cleared."""
    done = judged.where("refused IS NULL")
    new = done.select("bundle_id", F.col("to_collection").alias("new_collection"))
    gone = done.where("replaced_id IS NOT NULL").select(F.col("replaced_id").alias("bundle_id")).distinct().withColumn("cleared", F.lit(True))
    rows = bundles.join(new, "bundle_id", "left").join(gone, "bundle_id", "left")
    fresh = F.col("new_collection").isNotNull()
    return rows.select(
        "bundle_id",
        "doc_id",
        "status",
        F.when(fresh, F.col("new_collection")).when(F.col("cleared"), F.lit(None)).otherwise(F.col("collection_id")).alias("collection_id"),
        F.when(fresh, published_at).when(F.col("cleared"), F.lit(None)).otherwise(F.col("published_at")).alias("published_at"),
    )


def published_entries(judged: DataFrame, actor: str, at: Column, action: str = "publish") -> DataFrame:
    """Audit entries of the requests that weren't refused."""
    done = judged.where("refused IS NULL")
    return done.select("bundle_id", F.col("to_collection").alias("collection_id"), F.lit(action).alias("action"), "replaced_id", F.lit(actor).alias("actor"), at.alias("at"))


def unpublished_entries(bundles: DataFrame, ids: DataFrame, actor: str, at: Column) -> DataFrame:
    """Audit entries of the bundles that are live and are cleared."""
    gone = bundles.where("collection_id IS NOT NULL").join(ids.select("bundle_id").distinct(), "bundle_id", "left_semi")
    return gone.select("bundle_id", "collection_id", F.lit("unpublish").alias("action"), F.lit(None).cast("long").alias("replaced_id"), F.lit(actor).alias("actor"), at.alias("at"))


def audit_log(entries: DataFrame, bundle_id: int | None = None, collection_id: str | None = None) -> DataFrame:
    """The entries of one bundle or collection, or of all, in the order of their time, then bundle and action."""
    if bundle_id is not None:
        entries = entries.where(F.col("bundle_id") == bundle_id)
    if collection_id is not None:
        entries = entries.where(F.col("collection_id") == collection_id)
    return entries.orderBy("at", "bundle_id", "action")


def unpublish(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """``bundles`` with these cleared."""
    rows = bundles.join(ids.select("bundle_id").distinct().withColumn("cleared", F.lit(True)), "bundle_id", "left")
    keep = lambda c: F.when(F.col("cleared"), F.lit(None)).otherwise(F.col(c)).alias(c)
    return rows.select("bundle_id", "doc_id", "status", keep("collection_id"), keep("published_at"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Overwrite by bundle id; an absent review keeps the former, publication lasts only while approved."""
    a, b = old.alias("o"), new.alias("n")
    rows = a.join(b, "bundle_id", "full_outer")
    status = F.coalesce("n.status", "o.status")
    still = F.when(status == "approved", F.col("o.collection_id"))
    return rows.select(
        "bundle_id",
        F.coalesce("n.doc_id", "o.doc_id").alias("doc_id"),
        status.alias("status"),
        still.alias("collection_id"),
        F.when(still.isNotNull(), F.col("o.published_at")).alias("published_at"),
    )
