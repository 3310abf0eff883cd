"""Packing documents into fixed-length sequences as a cutting-stock problem.

A document's ids are cut into pieces of the full length and one remainder. Short pieces are bundled, those
that a task meets one after the other, so that rounding costs little: a bundle is placed as one piece, and is filled up
with the first part of the next short piece, which is cut, unless less than a unit is left. Lengths of
bundles and of other pieces are rounded up to units; their histogram, at most capacity / unit counts, is all that reaches the driver. There
a linear program over patterns (multisets of lengths that fit one sequence) is solved by column
generation: a knapsack dynamic program prices new columns. The patterns' use is rounded down, the
pieces left over, a few per pattern, are placed largest first, and each pattern gets a range of
sequence numbers. Pieces and bundles are ranked within their length without gathering one length in one task (a
count per partition gives the offset, a local rank the rest), and the rank alone decides their
pattern, sequence and slot.

Defined results: a null text counts as empty and is one piece that holds the end id; pieces of one
document may lie in different sequences; repeated rows are packed as often as they occur; an empty
table gives no sequence; other columns play no part.
"""

from __future__ import annotations

import logging
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunk_table import ChunkTable, portions
from tidemark.llm.vocabulary import byte_alphabet
from tidemark.llm.worker import PAIR_BYTES, held, releasing
from tidemark.session import materialize

CAPACITY, UNIT, END_ID = 4096, 16, 2
#: Parts of the capacity: up to the first a piece is bundled, the second is what a bundle holds. With 4096 places, pieces of up to
#: 128 tokens come in bundles of 1024, of which fewer than a unit stay empty.
SHORT, BUNDLE = 32, 4

#: Lower-case Latin-1 text without the marker of special tokens, and the pieces that it is cut into.
_PLAIN = re.compile(r"(?!.*<\|)[\x00-\x7fÀ-ÖØ-öø-ÿ]*", re.DOTALL)
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x09-\x0d\x20]+")


class _Encoder:
    """Chunks to ids with the ``tokenizers`` library; plain chunks by the pieces they are cut into."""

    def __init__(self, path: str, budget: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._merge = self._tokenizer.model.tokenize
        alphabet = byte_alphabet()
        self._alphabet = {c: "".join([alphabet[b] for b in chr(c).encode()]) for c in range(256)}
        self._pieces: dict[str, bytes] = {}
        self._left = budget

    def _whole(self, chunk: str) -> bytes:
        return np.array(self._tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        tokens = self._merge(piece.translate(self._alphabet))
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        self._left -= PAIR_BYTES + len(piece) + len(ids)
        if self._left > 0:
            self._pieces[piece] = ids
        return ids

    def __call__(self, chunks: list[bytes]) -> list[bytes]:
        get, out = self._pieces.get, []
        for chunk in chunks:
            if chunk.isalpha():  # letters of ASCII are one piece
                piece = chunk.decode().lower()
                out.append(get(piece) or self._piece(piece))
                continue
            text = chunk.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text):
                out.append(b"".join([get(p) or self._piece(p) for p in _PIECE.findall(text.lower())]))
            else:
                out.append(self._whole(text))
        return out


#: What a worker keeps from task to task: the tokenizer, and chunks and pieces up to these bytes. Learning them
#: anew in each task would take a third more CPU time.
CHUNK_BYTES, PIECE_BYTES = 130_000_000, 100_000_000


def _table(path: str) -> ChunkTable:
    loaded = held("packing")
    if path not in loaded:
        loaded[path] = ChunkTable(_Encoder(path, PIECE_BYTES), budget=CHUNK_BYTES)
    return loaded[path]


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "item", "item_tokens", "item_at")


def _cut(path: str, capacity: int, end_id: int, unit: int):
    """Pieces, with the item that each is placed in: its number in the task, its tokens and the piece's place there."""
    end = np.array([end_id], "<u4").tobytes()
    short, bundle = capacity // SHORT, max(unit, capacity // BUNDLE // unit * unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, items, kind = _table(path), 0, pa.null()
        waiting, filled = [], 0  # the bundle that is being filled, at most ``bundle`` pieces

        def rows(some: list[tuple]) -> pa.RecordBatch:
            ids, *numbers = zip(*some, strict=True) if some else [()] * len(_COLUMNS)
            return pa.record_batch([pa.array(ids, kind), *(pa.array(n, pa.int64()) for n in numbers)], names=list(_COLUMNS))

        def close() -> list[tuple]:
            nonlocal waiting, filled, items
            out = [(*piece, items, filled, at) for piece, at in waiting]
            items += 1
            waiting, filled = [], 0
            return out

        for batch in batches:
            kind, keys = batch.column(0).type, batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for first, some in portions(texts):
                done = []
                for i, values in enumerate(table.look_up(some)):
                    ids = b"".join([*values, end])
                    n = len(ids) // 4
                    at = 0
                    while at < n:
                        length = min(capacity, n - at)
                        bundled = length <= short
                        if bundled and bundle - filled < length:  # fill the bundle up, or close it as it is
                            if bundle - filled < unit:
                                done += close()
                            length = min(length, bundle - filled)
                        piece = (keys[first + i], at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n)
                        at += length
                        if not bundled:
                            done.append((*piece, items, length, 0))
                            items += 1
                            continue
                        waiting.append((piece, filled))
                        filled += length
                        if filled == bundle:
                            done += close()
                yield rows(done)
        if waiting:
            yield rows(close())

    return releasing(run, "packing")


def _best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of sizes within capacity that is worth most."""
    worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        worth[c] = worth[c - 1]
        if len(fits):
            options = worth[c - sizes[fits]] + values[fits]
            best = int(options.argmax())
            if options[best] > worth[c]:
                worth[c], chosen[c] = options[best], fits[best]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            pattern[chosen[c]] += 1
            c -= int(sizes[chosen[c]])
    return float(worth[capacity]), pattern


def _inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination, in elementwise operations: threaded LAPACK may hang in a driver process that has forked."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        best = k + int(np.abs(both[k:, k]).argmax())
        if best != k:
            both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (as columns) and their use, which minimise the number of sequences: simplex with priced columns.

    Stops at the optimum, or after ``rounds`` pivots with a feasible plan, and then logs how far it may be from the optimum.
    """
    gain = 1.0
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    use = _times(inverse, demand)
    for turn in range(rounds):
        gain, pattern = _best_pattern(inverse.sum(axis=0), sizes, capacity)
        if gain <= 1 + 1e-9:
            break
        move = _times(inverse, pattern)
        rising = move > 1e-10
        ratio = np.full(len(sizes), np.inf)
        ratio[rising] = use[rising] / move[rising]
        out = int(ratio.argmin())
        step = ratio[out]
        use -= step * move
        use[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        columns[:, out] = pattern
        if turn % 200 == 199:
            inverse = _inverse_of(columns)
            use = np.maximum(_times(inverse, demand), 0)
    else:
        # The prices divided by the best pattern's worth are a dual solution, so that no plan needs fewer than use / gain.
        logging.getLogger(__name__).warning("packing: stopped after %d rounds, at most %.4f times the least number of sequences", rounds, gain)
    return columns, np.maximum(use, 0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {units: number} and how often each is used, which hold exactly the histogram's pieces."""
    left = {s: n for s, n in histogram.items() if n}
    if not left:
        return []
    sizes = np.array(sorted(left))
    columns, use = solve_patterns(sizes, np.array([left[s] for s in sizes], float), capacity)
    made: list[tuple[dict[int, int], int]] = []
    for column, x in sorted(zip(columns.T.round().astype(int).tolist(), use, strict=True), key=lambda p: -p[1]):
        pattern = {int(s): a for s, a in zip(sizes, column, strict=True) if a}
        times = min([int(x + 1e-6), *(left[s] // a for s, a in pattern.items())])
        if times:
            made.append((pattern, times))
            for s, a in pattern.items():
                left[s] -= a * times
    while any(left.values()):
        pattern, room = {}, capacity
        for s in sorted(left, reverse=True):
            if take := min(left[s], room // s):
                pattern[s] = take
                room -= take * s
        times = min(left[s] // a for s, a in pattern.items())
        made.append((pattern, times))
        for s, a in pattern.items():
            left[s] -= a * times
    return made


def pack(
    df: DataFrame,
    path: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    capacity: int = CAPACITY,
    unit: int = UNIT,
    end_id: int = END_ID,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    kind = df.select(df[id_col].alias("doc_id")).schema[0].dataType.simpleString()
    pieces = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(
        _cut(path, capacity, end_id, unit), f"doc_id {kind}, {', '.join(f'{c} long' for c in _COLUMNS[1:])}"
    )
    pieces = materialize(
        pieces.select("*", F.expr(f"int(({unit - 1} + item_tokens) div {unit})").alias("units"), F.spark_partition_id().alias("part")).drop("item_tokens"),
        "pieces",
    )
    counts = pieces.where("item_at = 0").groupBy("units", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "length-counts")
    histogram = {r["units"]: r["n"] for r in counts.groupBy("units").agg(F.sum("n").alias("n")).collect()}
    slots, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in plan(histogram, capacity // unit):
        for units, each in pattern.items():
            slots.append((units, used[units], used[units] + each * times, each, sequence))
            used[units] += each * times
        sequence += times
    table = spark.createDataFrame(slots, "units int, low long, high long, each long, first_sequence long")
    before = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("units", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("units", "part").orderBy("item")
    ranked = (
        pieces.withColumn("local", F.dense_rank().over(local))
        .join(offsets, ["units", "part"])
        .withColumn("place", F.col("before") + F.col("local") - 1)
    )
    # The pattern table has a few rows per pattern, and there are at most twice as many patterns as lengths.
    placed = ranked.join(F.broadcast(table.withColumnRenamed("units", "u")), F.expr("units = u AND place >= low AND place < high")).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "units",
        "item_at",
        F.expr("first_sequence + (place - low) div each").alias("sequence_id"),
        F.expr("(place - low) % each").alias("slot"),
    )
    within = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "slot", "item_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"),
    )
