"""Exact top-k search by integer inner product, as tiled matrix products.

Candidates are packed into shards and queries into blocks, both as binary matrices of bounded size.
Each pair of a query block and a shard is one tile: one matrix product and a partial selection of k
per query, so no score leaves its tile unless it is among the tile's k best. Blocks and shards meet in a
grid whose cells hold about ``GRID`` of each: a shard is sent once per column of the grid, a block once
per row, and the cells spread the tiles over the tasks however few blocks there are. The lists are
merged in a tree: shards are numbered densely, and each level merges the lists of ``FAN_IN`` neighbours.

Defined results: a component x counts as floor(scale * x); vectors that are null or hold null or
non-finite components take no part; vectors of different lengths are never compared; rows that share
an id are candidates each, and one query, with one of their vectors; a query's own id is no candidate;
fewer than k candidates give fewer rows; ties go to the smaller id; an empty table gives an empty
result; other columns play no part. Scores are exact. One that leaves the range of a long, or a
component whose multiple leaves that of a double, ends the job with an ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.worker import releasing
from tidemark.session import materialize

#: Rows of a shard and of a query block: a tile takes SHARD_ROWS * BLOCK_ROWS * 8 bytes at most.
SHARD_ROWS, BLOCK_ROWS = 8192, 512
#: Blocks and shards in a cell of the grid.
GRID = 16
#: Lists merged together at each level of the tree.
FAN_IN = 32

_BLOCK = "dim int, part int, ids binary, cells binary"


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


def _pack(rows: int, scale: int):
    """Packs (id, vector, part) rows into blocks of one dimension and part."""

    def block(dim: int, part: int, ids: list, cells: list) -> pa.RecordBatch:
        body = np.concatenate(cells) if cells else np.zeros((0, dim))
        return pa.record_batch(
            [
                pa.array([dim], pa.int32()),
                pa.array([part], pa.int32()),
                pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                pa.array([body.astype("<f8").tobytes()], pa.binary()),
            ],
            names=["dim", "part", "ids", "cells"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list, int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors, parts = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            for dim in np.unique(lengths):
                for part in np.unique(parts[lengths == dim]):
                    pick = np.flatnonzero((lengths == dim) & (parts == part))
                    # Whole numbers as doubles: any double times a power of two, cut, is one.
                    cells = np.floor(flat[starts[pick][:, None] + np.arange(dim)] * scale)
                    if not np.isfinite(cells).all():
                        raise OverflowError("a component times the scale leaves the range of a double")
                    for at in range(0, len(pick), rows):
                        key = (int(dim), int(part))
                        some_ids, some_cells, n = held.pop(key, ([], [], 0))
                        take = min(rows - n, len(pick) - at)
                        spans = [(at, at + take)] + ([(at + take, min(at + rows, len(pick)))] if take < min(rows, len(pick) - at) else [])
                        for a, b in spans:
                            some_ids.append(ids[pick[a:b]])
                            some_cells.append(cells[a:b])
                            n += b - a
                            if n >= rows:
                                yield block(*key, some_ids, some_cells)
                                some_ids, some_cells, n = [], [], 0
                        if n:
                            held[key] = (some_ids, some_cells, n)
        for key, (some_ids, some_cells, _) in held.items():
            yield block(*key, some_ids, some_cells)

    return releasing(run)


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: highest score, then smallest id."""
    if len(ids) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _products(q: np.ndarray, x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The inner products of the pairs in ``other`` as longs, exactly; q and x hold whole numbers as doubles."""
    dim = max(q.shape[1], 1)
    most_q, most_x = np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0)
    bound = most_q.max(initial=0) * most_x.max(initial=0) * dim
    if bound < 2**53:  # doubles hold such sums exactly
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.where(np.abs(a) < 2**62, a, 0).astype(np.int64)
    scores = whole(q) @ whole(x).T
    # Pairs that may leave the range of a long are added up in Python's integers.
    for i, j in zip(*np.nonzero((most_q[:, None] * most_x * dim >= 2**62) & other), strict=True):
        own = sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True))
        if not -(2**63) < own < 2**63:
            raise OverflowError("a score leaves the range of a long")
        scores[i, j] = own
    return scores


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                query_ids, ids = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q = np.frombuffer(row["query_cells"], "<f8").reshape(len(query_ids), dim)
                x = np.frombuffer(row["cells"], "<f8").reshape(len(ids), dim)
                other = query_ids[:, None] != ids
                scores, out = _products(q, x, other), []
                for i, query_id in enumerate(query_ids):
                    best, score = _best_of(scores[i][other[i]], ids[other[i]], k)
                    out.append((np.full(len(best), query_id), best, score))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                if columns:
                    yield pa.record_batch(
                        [pa.array([row["shard"]] * len(columns[0]), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)],
                        names=["shard", "query_id", "vec_id", "score"],
                    )

    return releasing(run)


def _numbered(shards: DataFrame) -> DataFrame:
    """Shards with dense numbers, in the order of partitions; only a count per partition leaves the executors."""
    part = F.shiftright("shard", 33)
    counts = sorted(shards.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    known = F.broadcast(shards.sparkSession.createDataFrame(offsets, "p long, before long"))  # a row per partition
    return shards.join(known, part == F.col("p")).select("dim", "ids", "cells", (F.col("before") + F.col("shard").bitwiseAND(F.lit(2**33 - 1))).alias("shard"))


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per query its k best candidates: query_id, rank, vec_id, score."""
    asked = queries.where(usable(queries[vector_col])).select(queries[id_col].cast("long").alias("id"), queries[vector_col].alias("v"))
    asked = materialize(asked.groupBy("id").agg(F.first("v").alias("v")), "queries")
    n_blocks = max(1, -(-asked.count() // block_rows))
    blocks = (
        asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("part"))
        .repartition(n_blocks, "part")
        .mapInArrow(_pack(block_rows, scale), _BLOCK)
        .select("dim", "part", F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"))
    )
    shards = (
        vectors.where(usable(vectors[vector_col]))
        .select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"), F.lit(0).alias("part"))
        .where("id IS NOT NULL")
        .mapInArrow(_pack(shard_rows, scale), _BLOCK)
        .select("dim", "ids", "cells", F.monotonically_increasing_id().alias("shard"))
    )
    shards = _numbered(materialize(shards, "shards"))
    blocks = materialize(blocks, "query-blocks")
    n_shards = shards.count()
    rows, columns = (max(1, -(-n // GRID)) for n in (n_shards, n_blocks))
    placed = shards.withColumn("row", F.pmod(F.xxhash64("shard"), F.lit(rows))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    sent = blocks.withColumn("column", F.expr(f"int(part div {GRID})")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    tiles = placed.join(sent.withColumn("row", F.col("row").cast("long")), ["dim", "row", "column"])
    lists = tiles.select("shard", "dim", "query_ids", "query_cells", "ids", "cells").mapInArrow(
        _tiles(k), "shard long, query_id long, vec_id long, score long"
    )
    width = n_shards
    while True:
        width = -(-width // FAN_IN)
        branch = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("shard", F.expr(f"shard div {FAN_IN}")).withColumn("rank", F.row_number().over(branch)).where(F.col("rank") <= k)
        if width <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
