"""Periodic re-ingestion with Structured Streaming.

The stream only says when to run: a file source never reports deletions, so each cycle compares a
full listing with the registry. A file of the same size and time as before isn't read. What is new or changed
is read once, extracted, chunked and embedded to records; the chunks that a changed or deleted file had become
tombstones; then storage use and tombstones decide whether the records are compacted. All a cycle makes goes
into folders of the batch's number, the registry last, so a batch that runs again after a failure overwrites
its own folders and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import normalize_text
from tidemark.operators import chunking, snapshots
from tidemark.operators.ingest import build_records, change_set, list_files, mock_embedding, pipeline_signature, read_files
from tidemark.sources.extract import extract_files

REGISTRY = "path string, size long, modified timestamp, fingerprint string, status string, error string"
RECORDS = "path string, chunk_id string, chunk_text string, vector array<double>, batch int"
TOMBSTONES = "chunk_id string, path string, reason string, bytes long, batch int"
DECISIONS = "batch int, records long, tombstones long, bytes long, budget string, reason string"
#: Bytes of records that count as a full storage, and dimension of the embedding.
BUDGET_BYTES, DIMENSION = 1 << 40, 16


def _versions(spark: SparkSession, registry: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(registry)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def read_registry(spark: SparkSession, registry: str, before: int | None = None) -> DataFrame:
    """The newest version, or the newest of an earlier batch."""
    found = [v for v in _versions(spark, registry) if before is None or v < before]
    if not found:
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).parquet(f"{registry}/batch={found[-1]}")


def _read(spark: SparkSession, registry: str, name: str, schema: str, since: int = -1, before: int | None = None) -> DataFrame:
    """The rows that the batches wrote, one folder each."""
    folders = [f"{registry}/{name}/batch={v}" for v in _versions(spark, f"{registry}/{name}") if v >= since and (before is None or v < before)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def live_records(spark: SparkSession, registry: str, before: int | None = None, compacted_before: int | None = None) -> DataFrame:
    """Records since the last compaction, which wrote all that was alive, without their tombstones."""
    until = before if compacted_before is None else compacted_before
    whole = [v for v in _versions(spark, f"{registry}/compacted") if until is None or v < until]
    since = whole[-1] if whole else -1
    base = spark.read.schema(RECORDS).parquet(f"{registry}/compacted/batch={since}") if whole else spark.createDataFrame([], RECORDS)
    records = base.unionByName(_read(spark, registry, "records", RECORDS, since + 1, before))
    dead = _read(spark, registry, "tombstones", TOMBSTONES, since + 1, before).select("chunk_id", F.col("batch").alias("died"))
    # A chunk that comes back in or after the batch of its tombstone is alive.
    gone = (records["chunk_id"] == dead["chunk_id"]) & (records["batch"] < dead["died"])
    return records.join(dead, gone, "left_anti")


def _records_of(texts: DataFrame, batch: int) -> DataFrame:
    """Records of (path, content_type, text): each file by the chunker that suits it."""
    docs = texts.select("path", "content_type", normalize_text(F.col("text")).alias("text"), chunking.strategy(F.col("path")).alias("strategy"))
    made = None
    for name in ("markdown", "structured", "fixed"):
        own = chunking.chunk(docs.where(F.col("strategy") == name).drop("strategy"), "text", name)
        made = own if made is None else made.unionByName(own)
    chunks = made.select(F.sha2("path", 256).alias("doc_id"), F.lit("1.0.0").alias("doc_version"), F.col("path").alias("source_uri"), "content_type", "text", "label", "offset")
    signature = pipeline_signature("1.0.0", "1.0.0", chunking.SIZE, chunking.OVERLAP, "auto")
    records = build_records(chunks, signature, f"mock-{DIMENSION}")
    return records.select(
        F.col("metadata.source_uri").alias("path"), "chunk_id", "chunk_text", mock_embedding(F.col("chunk_text"), DIMENSION).alias("vector"), F.lit(batch).alias("batch")
    )


def _size() -> Column:
    """Bytes that a record counts for."""
    return (F.octet_length("chunk_text") + 8 * F.size("vector")).cast("long")


def _decide(spark: SparkSession, registry: str, batch: int, budget_bytes: int) -> None:
    """Why to compact, if at all, and the compacted records.

    Counts go from one batch's decision to the next, so that a cycle reads its own records and tombstones alone;
    all live records are read only where no decision stands yet, and to compact them.
    """
    last = max((v for v in _versions(spark, f"{registry}/compacted") if v < batch), default=-1)
    told = [v for v in _versions(spark, f"{registry}/decisions") if v < batch]
    counts = lambda df, sign, size, dead: df.agg(
        (sign * F.count(F.lit(1))).alias("records"), (sign * F.coalesce(F.sum(size), F.lit(0))).alias("bytes"), (dead * F.count(F.lit(1))).alias("tombstones")
    )
    if told:
        # The tombstones before a compaction are gone with it.
        since = F.when(F.col("batch") > last, F.col("tombstones")).otherwise(0).alias("tombstones")
        base = spark.read.schema(DECISIONS).parquet(f"{registry}/decisions/batch={told[-1]}").select("records", "bytes", since)
    else:
        base = counts(live_records(spark, registry, before=batch), 1, _size(), 0)
    fresh = counts(_read(spark, registry, "records", RECORDS, batch, batch + 1), 1, _size(), 0)
    dead = counts(_read(spark, registry, "tombstones", TOMBSTONES, batch, batch + 1), -1, F.col("bytes"), 1)
    total = base.unionByName(fresh).unionByName(dead).agg(*[F.sum(c).cast("long").alias(c) for c in ("records", "tombstones", "bytes")])
    budget = snapshots.budget_action(F.col("bytes") * 100 / budget_bytes)
    reason = snapshots.compaction_decision(budget, F.col("tombstones"), F.col("records") + F.col("tombstones"), F.lit(batch - last))
    decided = total.select(F.lit(batch).alias("batch"), "records", "tombstones", "bytes", budget.alias("budget"), reason.alias("reason"))
    decided.write.mode("overwrite").parquet(f"{registry}/decisions/batch={batch}")
    if spark.read.schema(DECISIONS).parquet(f"{registry}/decisions/batch={batch}").first()["reason"] != "none":
        # A batch that runs again must not read the compaction that it is about to write anew.
        live_records(spark, registry, before=batch + 1, compacted_before=batch).write.mode("overwrite").parquet(f"{registry}/compacted/batch={batch}")


def run_cycle(spark: SparkSession, root: str, registry: str, batch: int, budget_bytes: int = BUDGET_BYTES) -> DataFrame:
    """One cycle, from listing to compaction. Returns the changes (path, change_type).

    A file whose extraction fails is registered with its error; it is tried again when it changes.
    """
    known = read_registry(spark, registry, before=batch)
    listed = list_files(spark, root)
    stat = known.select("path", F.col("size").alias("s"), F.col("modified").alias("m"), F.col("fingerprint").alias("was"))
    listed = listed.join(stat, "path", "left")
    same_stat = F.coalesce((F.col("size") == F.col("s")) & (F.col("modified") == F.col("m")), F.lit(False))
    touched = read_files(spark, root, listed.where(~same_stat))
    staged = f"{registry}/staged/batch={batch}"
    extract_files(touched.withColumn("fingerprint", F.sha2("content", 256))).write.mode("overwrite").parquet(staged)
    read = spark.read.parquet(staged)
    unread = listed.where(same_stat).select("path", "size", "modified", F.col("was").alias("fingerprint"))
    scan = read.select("path", "size", "modified", "fingerprint").unionByName(unread)
    change_set(scan, known).write.mode("overwrite").parquet(f"{registry}/changes/batch={batch}")
    changes = spark.read.parquet(f"{registry}/changes/batch={batch}")
    fresh = read.join(changes.where("change_type IN ('added', 'modified')"), "path", "left_semi")
    _records_of(fresh.where("error IS NULL"), batch).write.mode("overwrite").parquet(f"{registry}/records/batch={batch}")
    left = changes.where("change_type IN ('modified', 'deleted')").select("path", F.concat(F.lit("file_"), F.when(F.col("change_type") == "deleted", "deleted").otherwise("updated")).alias("reason"))
    dead = live_records(spark, registry, before=batch).join(left, "path").select("chunk_id", "path", "reason", _size().alias("bytes"), F.lit(batch).alias("batch"))
    dead.write.mode("overwrite").parquet(f"{registry}/tombstones/batch={batch}")
    _decide(spark, registry, batch, budget_bytes)
    status = F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status")
    new = fresh.select("path", "size", "modified", "fingerprint", status, "error")
    same = changes.where("change_type = 'unchanged'").select("path")
    # A file that was read but is the same keeps its status under its new time.
    kept = known.select("path", "fingerprint", "status", "error").join(scan.join(same, "path", "left_semi").select("path", "size", "modified"), "path")
    new.unionByName(kept.select(new.columns)).write.mode("overwrite").parquet(f"{registry}/batch={batch}")
    return changes


def start(spark: SparkSession, root: str, registry: str, checkpoint: str, interval: str | None = "10 minutes", on_cycle=None) -> StreamingQuery:
    """Cycles at an interval; without one, what is there now and then an end."""

    def cycle(_: DataFrame, batch: int) -> None:
        changes = run_cycle(spark, root, registry, batch)
        if on_cycle:
            on_cycle(changes, batch)

    if interval is None:
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        trigger = {"once": True}
    else:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        trigger = {"processingTime": interval}
    return ticks.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
