"""Scanning, change detection, record assembly and ingest statistics."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import CONTENT_TYPES, chunk_hash, chunk_id

#: Larger files are left out.
MOST_BYTES = 1 << 30
#: Files from this size on are fingerprinted by so many bytes of each end.
SAMPLED_FROM, SAMPLE = 100 << 20, 64 << 10
#: Files that are named one by one to the reader.
MOST_NAMED = 10_000


def _binary(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(CONTENT_TYPES) + "}").load(root)
    return files.where((F.col("length") <= MOST_BYTES) & ~F.col("path").rlike(r"/\.[^/]+"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size and modified of the files that an extractor reads; no content is read."""
    return _binary(spark, root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """path, size, modified, content of the wanted (path) files: by name if they are few, else those of the whole folder."""
    names = [r["path"] for r in wanted.select("path").limit(MOST_NAMED + 1).collect()]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not names:
        found = reader.load(root).where(F.lit(False))
    elif len(names) <= MOST_NAMED:
        found = spark.read.format("binaryFile").load(names)
    else:
        found = reader.load(root).join(wanted.select("path"), "path", "left_semi")
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def ends_of(path: str, size: int, sample: int = SAMPLE) -> tuple[bytes, bytes]:
    """The first and the last bytes of a file, read as two ranges; nothing else is read."""
    store, name = fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path))
    with store.open_input_file(name) as file:
        return file.read_at(min(sample, size), 0), file.read_at(min(sample, size), max(0, size - sample))


@F.arrow_udf(T.StringType())
def sampled_fingerprint(path: pa.Array, size: pa.Array, modified: pa.Array) -> pa.Array:
    """SHA-256 of a large file's two ends, size and time of change in milliseconds."""

    def one(p: str, n: int, ms: int) -> str:
        head, tail = ends_of(p, n)
        return hashlib.sha256(head + tail + f"{n}:{ms}".encode()).hexdigest()

    return pa.array([one(*x) for x in zip(path.to_pylist(), size.to_pylist(), modified.to_pylist(), strict=True)], pa.string())


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified and fingerprint of the files that an extractor reads: of large files only the ends are read."""
    files = list_files(spark, root)
    small = _binary(spark, root).where(F.col("length") <= SAMPLED_FROM)  # the reader skips the content of files that this leaves out
    whole = small.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("fingerprint"))
    ends = files.where(F.col("size") > SAMPLED_FROM).withColumn("fingerprint", sampled_fingerprint("path", "size", F.unix_millis("modified")))
    return whole.unionByName(ends)


def known_fingerprint(fingerprint: Column, signature: Column, current: Column) -> Column:
    """A registered fingerprint; marked, so that it never matches, where another pipeline made it."""
    return F.when(signature == current, fingerprint).otherwise(F.concat(fingerprint, F.lit("::stale-pipeline")))


def change_set(scan: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """Full outer join of two (key, fingerprint) tables: key and change_type."""
    a, b = scan.select(key, F.col("fingerprint").alias("now")), known.select(key, F.col("fingerprint").alias("was"))
    kind = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "unchanged").otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, kind.alias("change_type"))


def pipeline_signature(extractor: str, normalizer: str, size: int, overlap: int, strategy: str) -> Column:
    chunker = f"1.0.0|size={size}|overlap={overlap}|strategy={strategy}"
    return F.sha2(F.lit(f"{extractor}{normalizer}{chunker}"), 256)


def build_records(chunks: DataFrame, signature: Column, model_id: str) -> DataFrame:
    """Records of chunks (doc_id, doc_version, source_uri, content_type, text, label, offset)."""
    text_hash = chunk_hash(F.col("text"))
    return chunks.select(
        chunk_id(F.col("doc_id"), F.col("doc_version"), F.col("offset"), text_hash).alias("chunk_id"),
        "doc_id",
        "doc_version",
        text_hash.alias("chunk_hash"),
        signature.alias("pipeline_signature"),
        F.lit(model_id).alias("embedding_model_id"),
        F.struct("source_uri", "content_type", "offset", F.col("label").alias("chunk_label")).alias("metadata"),
        F.col("text").alias("chunk_text"),
    )


def record_errors(dimension: int, vector: Column, *ids: Column) -> Column:
    """Why a record is refused, or null."""
    blank = F.lit(False)
    for i in ids:
        blank = blank | i.isNull() | (i == "")
    return F.when(blank, "empty id").when(vector.isNull() | (F.size(vector) != dimension), "wrong dimension")


def mock_embedding(text: Column, dimension: int = 128) -> Column:
    """A deterministic unit vector from the bytes of the text's hash."""
    digest = F.sha2(text, 256)
    cell = lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), cell)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm == 0, x).otherwise(x / norm))
