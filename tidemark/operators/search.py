"""Ranked search: vector, hybrid and layered, all over batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Queries of a block and rows of a shard: the scores of the two take BLOCK * TILE * 8 bytes at most.
BLOCK, TILE = 256, 4096
#: Bytes of queries up to which their blocks are broadcast; beyond, blocks and shards meet in a grid of cells.
MOST_BROADCAST = 32 << 20
#: Blocks and shards in a cell of the grid.
GRID = 16
#: Digits of the scores that results are ranked by.
DIGITS = 6


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, norm, out=m.copy(), where=norm != 0)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs, greater being better."""
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        return _unit(q) @ _unit(x).T
    out = np.empty((len(q), len(x)))
    for i, one in enumerate(q):  # by differences: the expanded square loses digits between near vectors
        out[i] = 1.0 / (1.0 + np.sqrt(np.square(x - one).sum(axis=1)))
    return out


def scorable(rows: DataFrame) -> DataFrame:
    """The rows (id, v) that have an id and a vector of finite components."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & whole)


_BLOCK = "dim int, ids binary, cells binary"


def _packed(size: int):
    """(id, vector) rows as matrices of one dimension and at most ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                for at in range(0, len(own), size):
                    some = own[at : at + size]
                    cells = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    yield pa.record_batch(
                        [pa.array([dim], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()]), pa.array([cells.tobytes()])], names=["dim", "ids", "cells"]
                    )

    return run


def _tiles(metric: str, k: int, digits: int):
    """Per query and tile the k best rows by rounded score, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                # Matrices are read where they stand in the batch, which may hold many tiles.
                dim, *buffers = (batch.column(c)[at] for c in ("dim", "query_ids", "ids", "query_cells", "cells"))
                query_ids, ids = (np.frombuffer(b.as_buffer(), "<i8") for b in buffers[:2])
                q, x = (np.frombuffer(b.as_buffer(), "<f8").reshape(-1, dim.as_py()) for b in buffers[2:])
                scores = np.round(_scores(q, x, metric), digits) + 0.0
                rows, picks = [], []
                for i, own in enumerate(scores):
                    pick = np.arange(len(ids))
                    if len(pick) > 4 * k:
                        pick = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k])
                    pick = pick[np.lexsort((ids[pick], -own[pick]))][:k]
                    rows.append(np.full(len(pick), i))
                    picks.append(pick)
                row, pick = np.concatenate(rows), np.concatenate(picks)
                yield pa.record_batch([pa.array(query_ids[row]), pa.array(ids[pick]), pa.array(scores[row, pick])], names=["query_id", "id", "score"])

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", digits: int = DIGITS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per query (query_id, q) its k best vectors: query_id, id, score, rank.

    Rows and queries are packed into matrices and scored in tiles, with selection within the tile, so that no score
    leaves it unless it is among the tile's k best. Rows and queries without an id, and vectors that are null, empty or hold null or
    non-finite components, take no part; a query without any result has no row; repeated ids are results of their own. Few queries are broadcast, their bytes being counted first; else
    shards and blocks meet in a grid, so that each is sent once per ``GRID`` of the others.
    """
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    rows = scorable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    asked = scorable(queries.select(F.col("query_id").cast("long").alias("id"), F.col("q").cast("array<double>").alias("v")))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v") * 8), F.lit(0))).first()
    n_blocks = max(1, -(-n // BLOCK))
    shards = rows.mapInArrow(_packed(TILE), _BLOCK)
    blocks = asked.repartition(n_blocks).mapInArrow(_packed(BLOCK), _BLOCK).select("dim", F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"))
    if size <= MOST_BROADCAST:
        tiles = shards.join(F.broadcast(blocks), "dim")
    else:
        n_shards = max(1, -(-rows.count() // TILE))
        down, across = max(-(-n_shards // GRID), min(n_shards, 4 * parallel)), -(-n_blocks // GRID)
        cell = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        placed = shards.withColumn("down", cell(down)).withColumn("across", every(across))
        tiles = placed.join(blocks.withColumn("across", cell(across)).withColumn("down", every(down)), ["dim", "down", "across"])
    found = tiles.select("dim", "query_ids", "query_cells", "ids", "cells").mapInArrow(_tiles(metric, k, digits), "query_id long, id long, score double")
    return top_k(found, k, digits)


def top_k(scores: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """The k best per query by rounded score, ties to the smaller id, with ranks from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_item(results: DataFrame) -> DataFrame:
    """Of several rows of one item per query the best; committed rows win ties."""
    extra = [F.desc("committed")] if "committed" in results.columns else []
    order = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), *extra)
    return results.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def rrf(*lists: tuple[DataFrame, float], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, id, rank) with weights: query_id, id, score."""
    union = None
    for ranked, weight in lists:
        part = ranked.select("query_id", "id", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("share"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id", "id").agg(F.sum("share").alias("score"))


def explain(fused: DataFrame, near: DataFrame, words: DataFrame, queries: DataFrame, texts: DataFrame, preview: int = 200) -> DataFrame:
    """Why each result of a fused list is where it is: its score and rank in either list, a preview and the query's terms.

    fused, near and words: (query_id, id, rank, score); queries: (query_id, query); texts: (id, text). What a list doesn't
    hold is null; an id without a text has no preview; a null query has no terms.
    """
    side = lambda rows, name: rows.select("query_id", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    terms = F.filter(F.split(F.coalesce("query", F.lit("")), r"\s+"), lambda x: x != "")
    shown = texts.join(fused.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.substring("text", 1, preview)).alias("preview"))
    out = fused.select("query_id", "id", "rank", F.col("score").alias("rrf_score"))
    out = out.join(side(near, "vector"), ["query_id", "id"], "left").join(side(words, "keyword"), ["query_id", "id"], "left")
    return out.join(shown, "id", "left").join(queries.select("query_id", F.array_join(terms, " ").alias("matched_terms")), "query_id", "left")


def fuse_layers(raw: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fusion of two layers by provenance key (query_id, key, id, rank): score, layers and the item shown.

    A key found in both layers shows the raw layer's item.
    """
    both = raw.withColumn("layer", F.lit("raw")).unionByName(semantic.withColumn("layer", F.lit("semantic")))
    return both.groupBy("query_id", "key").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"),
        F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"),
        F.min_by("id", "layer").alias("id"),
    )


def resolve_layer(requested: Column, semantic_ready: Column) -> Column:
    """auto is fused where a semantic collection is ready; without one everything is raw."""
    return F.when(~semantic_ready, "raw").when(requested == "auto", "fused").otherwise(requested)


def requested_layer(fuse: bool = False, semantic: bool = False, layer: str | None = None) -> str:
    """What the flags ask for: fuse before semantic before the named layer before auto."""
    return "fused" if fuse else "semantic" if semantic else layer or "auto"


def request_error(collection: Column, top_k: Column, mode: Column, vector: Column, text: Column) -> Column:
    """Why a search request is refused, or null: modes are vector, keyword and hybrid; missing values are refused."""
    no_vector, no_text = F.coalesce(F.size(vector) <= 0, F.lit(True)), ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))
    return (
        F.when(F.coalesce(collection, F.lit("")) == "", "no collection")
        .when(F.coalesce(top_k, F.lit(0)) <= 0, "top_k is not positive")
        .when(~F.coalesce(mode.isin("vector", "keyword", "hybrid"), F.lit(False)), "unknown mode")
        .when((mode != "keyword") & no_vector, "no vector")
        .when((mode != "vector") & no_text, "no text")
    )
