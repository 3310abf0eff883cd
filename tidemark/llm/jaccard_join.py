"""N-gram Jaccard self-join by MinHash banding, with verification on the full n-gram sets.

Rows of equal n-gram sets are one class copy and go on as one representative with a weight. The
numbers of bands and rows are chosen for a target recall at the threshold. Representatives are
shuffled on their band hashes; buckets of one are dropped, as are buckets whose members another
band's bucket holds alike. The members' n-gram sets are then compared in blocks: a large bucket is
dealt into parts, and each pair of parts is one task's work, so neither a task nor a row grows with
the bucket. Parts of a large bucket hold sets of like size, and only those meet whose sizes the threshold
allows. A block returns one row per member, its number of links and the root of its local
tree, never pairs. A pair that meets in several bands counts in the first. The local trees are joined
to classes by distributed connected components.

Defined results: a text without words (null, empty or blank) has no links and is a class of its own;
a text of fewer than n words has one n-gram, all its words; rows that repeat are linked like other
copies; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.wordhash import Words, mix, row_ngrams, word_blocks
from tidemark.llm.worker import releasing
from tidemark.session import materialize

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: A part of a bucket holds about so many rows and n-grams at most (a single row may hold more).
PART_ROWS, PART_GRAMS = 1024, 1_000_000


def choose_bands(threshold: float, recall: float, most_hashes: int = 64) -> tuple[int, int]:
    """Bands and rows: the most rows per band whose banding finds pairs at the threshold with this recall."""
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def _sorted_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each row in order, and where each row's begin."""
    grams, first = row_ngrams(words, n)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[fresh], np.searchsorted(row[fresh], np.arange(len(first)))


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in word_blocks(batch.column(2)):
                grams, first = _sorted_sets(words, n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                keys = np.zeros((len(size), 2), np.uint64)
                hashes = np.zeros((len(size), bands), np.uint64)
                if len(some):
                    at = first[some]
                    keys[some, 0] = np.add.reduceat(mix(grams), at)
                    keys[some, 1] = np.bitwise_xor.reduceat(mix(grams + np.uint64(77)), at)
                    for band in range(bands):
                        total = np.full(len(some), np.uint64(band + 1))
                        for i in range(band * rows, (band + 1) * rows):
                            least = np.minimum.reduceat(grams * factors[i] + shifts[i], at)
                            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + least)
                        hashes[some, band] = total
                yield pa.record_batch(
                    [
                        batch.column(0).slice(start, stop - start),
                        batch.column(1).slice(start, stop - start),
                        pa.array(size, pa.int64()),
                        pa.array(keys[:, 0].view(np.int64)),
                        pa.array(keys[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * bands, pa.array(hashes.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "text_hash", "n_grams", "key1", "key2", "bands"],
                )

    return releasing(run)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in word_blocks(batch.column(1)):
                grams, first = _sorted_sets(words, n)
                grams = grams.astype("<u8")
                sets = [grams[first[i] : first[i + 1]].tobytes() for i in range(stop - start)]
                yield pa.record_batch([batch.column(0).slice(start, stop - start), pa.array(sets, pa.binary())], names=["rep", "grams"])

    return releasing(run)


def _overlaps(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    if len(left) == 1 and len(right) == 1:
        return np.array([[len(np.intersect1d(sets[left[0]], sets[right[0]], assume_unique=True))]])
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    same = np.zeros(len(grams) + 1, bool)
    same[1:-1] = grams[1:] == grams[:-1]
    shared = same[1:] | same[:-1]  # n-grams of one set only add nothing
    column = np.cumsum(~same[:-1])[shared]
    owner = owner[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        cells = np.zeros((len(sets), width), np.float32)
        cells[owner[a:b], column[a:b] - k * width] = 1
        out += cells[left] @ cells[right].T
    return out.astype(np.int64)


def _block_links(group: list[dict], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per member of one block its links and the least member of its local tree."""
    sets = [np.frombuffer(r["grams"], "<u8") for r in group]
    sizes = np.array([len(s) for s in sets])
    weight = np.array([r["weight"] for r in group])
    part = np.array([r["part"] for r in group])
    band = group[0]["band"]
    hashes = np.array([r["bands"] for r in group], np.int64)
    one_part = group[0]["i"] == group[0]["j"]
    left = np.arange(len(group)) if one_part else np.flatnonzero(part == group[0]["i"])
    right = left if one_part else np.flatnonzero(part == group[0]["j"])
    links, root = np.zeros(len(group), np.int64), np.arange(len(group))
    if not len(left) or not len(right):
        return links, root
    if len(group) == 2:
        left, right = np.array([0]), np.array([1])
    common = _overlaps(sets, sizes, left, right)
    near = common >= threshold * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-9
    if one_part and len(group) > 2:
        near &= ~np.eye(len(left), dtype=bool)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    first = np.ones(len(a), bool)
    for k in range(band):
        first &= hashes[a, k] != hashes[b, k]
    np.add.at(links, a[first], weight[b[first]])
    if not one_part or len(group) == 2:
        np.add.at(links, b[first], weight[a[first]])
    while True:
        was = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == was).all():
            return links, root


def _blocks(threshold: float):
    """Over rows sorted by block: the links and local roots of each block's members."""

    def told(group: list[dict]) -> pa.RecordBatch:
        group.sort(key=lambda r: r["rep"])
        links, root = _block_links(group, threshold)
        reps = np.array([r["rep"] for r in group], np.int64)
        return pa.record_batch([pa.array(reps), pa.array(links), pa.array(reps[root])], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"], row["i"], row["j"]) != (held[0]["bucket"], held[0]["i"], held[0]["j"]):
                    yield told(held)
                    held = []
                held.append(row)
        if held:
            yield told(held)

    return releasing(run)


def jaccard_classes(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    n: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """Per row: doc_id, class_id (least doc_id of the class), n_links, class_size, kept, and text_hash.

    ``n_links`` is the number of other rows whose n-gram sets are as similar as the threshold or more.
    One row of each class has ``kept``: the one whose doc_id is the class_id.
    """
    bands, rows = choose_bands(threshold, recall)
    kind = df.select(df[id_col].alias("doc_id")).schema[0].dataType.simpleString()
    keyed = df.select(df[id_col].alias("doc_id"), F.xxhash64(df[text_col]).alias("text_hash"), df[text_col].cast("string").alias("text"))
    signed = materialize(
        keyed.mapInArrow(
            _signatures(n, bands, rows), f"doc_id {kind}, text_hash long, n_grams long, key1 long, key2 long, bands array<long>"
        ).select("*", F.monotonically_increasing_id().alias("row_no")),
        "signatures",
    )
    worded = signed.where("n_grams > 0")
    reps = materialize(
        worded.groupBy("key1", "key2")
        .agg(
            F.min(F.struct("doc_id", "row_no", "text_hash")).alias("best"),
            F.count(F.lit(1)).alias("weight"),
            F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"),
        )
        .select("key1", "key2", "weight", "n_grams", "bands", F.col("best.row_no").alias("rep"), F.col("best.doc_id").alias("rep_doc"), F.col("best.text_hash").alias("rep_hash")),
        "representatives",
    )
    placed = reps.select("rep", "n_grams", F.posexplode("bands").alias("band", "hash"))
    # A bucket's members as a sum: buckets of other bands with the same members are the same work.
    buckets = (
        placed.groupBy("band", "hash")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum("n_grams").alias("grams"),
            F.sum(F.xxhash64("rep").bitwiseAND(F.lit(2**40 - 1))).alias("sum1"),
            F.bit_xor(F.xxhash64("rep", F.lit(3))).alias("sum2"),
        )
        .where("members > 1")
        .groupBy("members", "sum1", "sum2")
        .agg(F.min(F.struct("band", "hash", "grams")).alias("at"))
        .select(
            "at.band",
            "at.hash",
            ((F.col("members") > PART_ROWS) | (F.col("at.grams") > PART_GRAMS)).alias("large"),
            F.monotonically_increasing_id().alias("bucket"),
        )
    )
    buckets = materialize(buckets, "buckets")
    # Sets whose Jaccard similarity reaches the threshold lie in the same or in neighbouring classes of size.
    like = F.floor(F.log("n_grams") / (-log(threshold) * (1 + 1e-9))) if threshold < 1 else F.col("n_grams")
    members = materialize(
        placed.select("rep", "band", "hash", "n_grams")
        .join(buckets, ["band", "hash"])
        .select("rep", "band", "bucket", "large", "n_grams", F.when(F.col("large"), like).otherwise(0).cast("int").alias("size_class")),
        "members",
    )
    # Of the large buckets only, so that this table is small beside the members and its size is known to the join.
    grid = materialize(
        members.where("large")
        .groupBy("bucket", "size_class")
        .agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("n_grams") / PART_GRAMS)).cast("int").alias("parts"))
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("size_class", "parts")).alias("classes")),  # a hundred classes reach sets of 5e9 n-grams
        "large-buckets",
    )
    active = members.select("rep").distinct()
    wanted = materialize(reps.join(active, "rep").select("rep", "weight", "bands", "rep_doc", "rep_hash"), "active")
    texts = keyed.join(
        wanted.select("rep", "rep_doc", "rep_hash"), F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("text_hash") == F.col("rep_hash"))
    ).select("rep", "text")
    sets = texts.mapInArrow(_sets(n), "rep long, grams binary").groupBy("rep").agg(F.first("grams").alias("grams"))
    own_parts = F.element_at(F.filter("classes", lambda c: c["size_class"] == F.col("size_class")), 1)["parts"]
    near = F.filter("classes", lambda c: F.abs(c["size_class"] - F.col("size_class")) <= 1)
    label = lambda size_class, n: (size_class.cast("long") * 2**32 + n).cast("long")
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["parts"] - 1), lambda n: label(c["size_class"], n))))
    blocks = (
        members.join(grid, "bucket", "left")
        .withColumn("classes", F.coalesce("classes", F.array(F.struct(F.lit(0).alias("size_class"), F.lit(1).alias("parts")))))
        .withColumn("part", label(F.col("size_class"), F.pmod(F.xxhash64("rep", "bucket"), own_parts)))
        .withColumn("other", F.explode(others))
        .select("rep", "band", "bucket", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .join(wanted.select("rep", "weight", "bands"), "rep")
        .join(sets, "rep")
    )
    found = materialize(
        blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_blocks(threshold), "rep long, links long, root long"),
        "links",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = (
        reps.join(links, "rep", "left")
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("rep", "key1", "key2", "weight", "rep_doc", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "rep").alias("label"))
    )
    told = materialize(told, "labelled")
    classes = told.groupBy("label").agg(F.min(F.struct("rep_doc", "rep")).alias("head"), F.sum("weight").alias("class_size"))
    per_key = materialize(
        told.join(classes, "label").select("key1", "key2", "head", "class_size", (F.col("links") + F.col("weight") - 1).alias("n_links")), "classes"
    )
    alone = signed.where("n_grams = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "text_hash"
    )
    return (
        worded.join(per_key, ["key1", "key2"])
        .select("doc_id", F.col("head.rep_doc").alias("class_id"), "n_links", "class_size", (F.col("row_no") == F.col("head.rep")).alias("kept"), "text_hash")
        .unionByName(alone)
    )


def drop_near_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``df`` with one row of each class."""
    kept = jaccard_classes(df, text_col, id_col, **options).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    kept = materialize(kept.groupBy("kept_id", "kept_hash").agg(F.count(F.lit(1)).alias("copies")), "kept")
    # The row travels as one struct, so that none of its columns can clash with those beside it.
    keyed = df.select(F.struct("*").alias("row"), df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("hash"))
    joined = keyed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    one = Window.partitionBy("kept_id", "kept_hash").orderBy(F.lit(1))
    return joined.withColumn("place", F.row_number().over(one)).where("place <= copies").select("row.*")
