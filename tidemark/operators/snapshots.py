"""Versioned snapshots: segments, manifests and tombstones as tables.

A manifest (collection_id, version, segment_ids) names the segments of a version. Tombstones are rows
(collection_id, chunk_id, born, gone): an id is dead in the versions from ``born`` to before ``gone``, or for
good. A snapshot is the rows of its segments (semi-join) without its tombstones (anti-join). Publishing,
rolling back and compacting append; nothing is rewritten in place, so any version can be read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(manifests: DataFrame) -> DataFrame:
    """The newest manifest of each collection."""
    newest = manifests.groupBy("collection_id").agg(F.max_by(F.struct(*[c for c in manifests.columns if c != "collection_id"]), "version").alias("m"))
    return newest.select("collection_id", "m.*")


def at_version(manifests: DataFrame, version: int) -> DataFrame:
    return manifests.where(F.col("version") == version)


def dead_at(tombstones: DataFrame, manifest: DataFrame) -> DataFrame:
    """(collection_id, chunk_id) of what is dead in the manifests' versions."""
    held = tombstones.join(manifest.select("collection_id", "version"), "collection_id")
    return held.where("born <= version AND (gone IS NULL OR version < gone)").select("collection_id", "chunk_id")


def _of_segments(records: DataFrame, manifest: DataFrame) -> DataFrame:
    return records.join(manifest.select("collection_id", F.explode("segment_ids").alias("segment_id")), ["collection_id", "segment_id"], "left_semi")


def snapshot(records: DataFrame, manifest: DataFrame, tombstones: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the manifest's segments without its tombstones."""
    dead = dead_at(tombstones, manifest).withColumnRenamed("chunk_id", key)
    return _of_segments(records, manifest).join(dead, ["collection_id", key], "left_anti")


def publish(manifests: DataFrame, segments: DataFrame, tombstones: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next manifest of each collection that has ready segments, and the tombstones it adds.

    All ready segments; the pending ids that aren't dead yet; one version more than the last, from 0.
    """
    ready = segments.where("status = 'ready'").groupBy("collection_id").agg(F.array_sort(F.collect_set("segment_id")).alias("segment_ids"))
    last = latest(manifests).select("collection_id", "version")
    new = ready.join(last, "collection_id", "left").select("collection_id", (F.coalesce("version", F.lit(-1)) + 1).alias("version"), "segment_ids")
    fresh = pending.select("collection_id", "chunk_id").distinct().join(dead_at(tombstones, last), ["collection_id", "chunk_id"], "left_anti")
    added = fresh.join(new.select("collection_id", F.col("version").alias("born")), "collection_id")
    return new, added.select("collection_id", "chunk_id", "born", F.lit(None).cast("int").alias("gone"))


def rollback(manifests: DataFrame, tombstones: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """The manifests that publish an older version's content as a new one, and all tombstones after that.

    Tombstones younger than the version end; those that ended since begin anew.
    """
    top = manifests.groupBy("collection_id").agg((F.max("version") + 1).alias("next"))
    back = at_version(manifests, version).join(top, "collection_id").select("collection_id", F.col("next").alias("version"), "segment_ids")
    held = tombstones.join(back.select("collection_id", F.col("version").alias("next")), "collection_id", "left")
    ends = F.when(F.col("gone").isNull() & (F.col("born") > version), F.col("next")).otherwise(F.col("gone"))
    again = held.where((F.col("born") <= version) & (F.col("gone") > version) & F.col("next").isNotNull())
    return back, held.select("collection_id", "chunk_id", "born", ends.cast("int").alias("gone")).unionByName(
        again.select("collection_id", "chunk_id", F.col("next").cast("int").alias("born"), F.lit(None).cast("int").alias("gone"))
    )


def compaction(records: DataFrame, manifest: DataFrame, tombstones: DataFrame, pending: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Per collection what compacting keeps and removes."""
    dead = dead_at(tombstones, manifest).unionByName(pending.select("collection_id", F.col(key).alias("chunk_id"))).distinct().withColumnRenamed("chunk_id", key)
    marked = _of_segments(records, manifest).join(dead.withColumn("dead", F.lit(1)), ["collection_id", key], "left")
    return marked.groupBy("collection_id").agg(
        F.count_if(F.col("dead").isNull()).alias("kept"),
        F.count_if(F.col("dead").isNotNull()).alias("removed"),
        F.count_distinct("segment_id").alias("segments"),
    )


def compact(records: DataFrame, manifest: DataFrame, tombstones: DataFrame, pending: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of the one segment that replaces a manifest's segments: what is alive, under its new segment id."""
    dead = dead_at(tombstones, manifest).unionByName(pending.select("collection_id", F.col(key).alias("chunk_id"))).withColumnRenamed("chunk_id", key)
    live = _of_segments(records, manifest).join(dead, ["collection_id", key], "left_anti")
    new_id = F.concat(F.col("collection_id"), F.lit("-compact-"), F.col("version") + 1)
    named = manifest.select("collection_id", new_id.alias("compacted_id"))
    return live.join(named, "collection_id").withColumn("segment_id", F.col("compacted_id")).drop("compacted_id")


def add_tombstones(tombstones: DataFrame, more: DataFrame) -> DataFrame:
    """Insert if absent: an id that is dead already keeps its row."""
    return tombstones.unionByName(more.dropDuplicates(["chunk_id"]).join(tombstones.select("chunk_id"), "chunk_id", "left_anti").select(tombstones.columns))


def checksum(segment_ids: Column, n_tombstones: Column, tombstone_bits: Column, version: Column) -> Column:
    """Over a manifest; its tombstones go in as their number and a combined hash that does not depend on their order."""
    fields = {"segment_ids": segment_ids, "n_tombstones": n_tombstones, "tombstone_bits": tombstone_bits, "version": version}
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])), 256)


def budget_action(percent: Column) -> Column:
    """What a storage use of this percentage calls for; the limits themselves are still below."""
    return F.when(percent > 95, "skip").when(percent > 85, "compact").when(percent > 70, "warn").otherwise("normal")


def compaction_decision(action: Column, tombstones: Column, records: Column, cycles: Column) -> Column:
    """Why to compact: budget before density (0.3 or more, of 5 tombstones or more) before 20 cycles."""
    density = F.when(records > 0, tombstones / records).otherwise(F.lit(0.0))
    return (
        F.when(action.isin("compact", "skip"), "budget")
        .when((tombstones >= 5) & (density >= 0.3), "density")
        .when(cycles >= 20, "cycles")
        .otherwise("none")
    )
