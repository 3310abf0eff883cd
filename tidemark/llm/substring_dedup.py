"""Exact removal of repeated passages: windows of words found by FM-indexes over content shards.

A window (``WINDOW`` consecutive words) is repeated if its words also start earlier. Consecutive
windows with the same anchor, the least hash of the 8-grams in the window, form one passage, and equal
windows have equal anchors. So passages are sharded by anchor, and no document need be held against
any shard but those of its own anchors.

Passages whose anchor no other has are left alone. Of the others each different one is sent to its anchor's
shard with its words, once; further places of an equal passage follow without words. The shard builds a
compressed FM-index (wavelet matrix) over its passages, in the order of the documents, and streams each place
against it by backward search, whose matching statistics give the runs of windows that occur earlier.

A hot anchor, as in a passage that a third of all documents hold, has no shard of its own: its windows go one
by one to the shard of the window's hash, so that equal windows still meet, and a task sends a window once for
each block of texts that it reads; the later places in the block are repeated and need no search. The same holds
for an anchor that turns out to have many different passages.

Words are compared by 64-bit hashes, windows by twenty of them. Places of an equal passage are told by 64 bits
of a hash of all its words and by the anchor's shard and 32 bits more: 1e13 passages in 2**24 shards would
have some 1e-10 false pairs.

Defined results: a null text has no words; documents are ordered by id, null ids first, and rows that
share an id by a hash of their text; rows that repeat id and text are one document, each with the
same result; a text shorter than a window loses nothing; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.fm_index import FmIndex
from tidemark.llm.wordhash import Words, mix, ngrams, span_hashes, word_blocks
from tidemark.llm.worker import releasing
from tidemark.session import materialize

WINDOW, ANCHOR = 20, 8
#: Bytes of text per shard of anchors; shards that one task may take, one after the other.
SHARD_BYTES, SHARDS_A_TASK = 6_000_000, 16
#: Different passages of one anchor from which its windows are dealt out one by one, by their own hash.
SPREAD_FROM = 200
#: Share of a block's passages from which an anchor is hot. One row in ``HOT_SAMPLE`` is read to find such
#: anchors. This only balances tasks; no result depends on it.
HOT_SHARE, HOT_SAMPLE = 0.001, 16


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value among the ``width`` from each place."""
    place, span = np.arange(len(values)), 1
    while span < width:
        move = min(span, width - span)
        a, b = place[: len(place) - move], place[move:]
        place = np.where(values[b] < values[a], b, a)
        span += move
    return place


def passages(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Row, start in the row, windows, anchor hash and content hash of each passage of a block."""
    n = len(words.hash)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    counts = np.diff(words.first)
    row = np.repeat(np.arange(len(counts)), counts)[: n - window + 1]
    grams = ngrams(words.hash, anchor)
    place = _least_places(grams, window - anchor + 1)
    start = np.arange(n - window + 1)
    whole = start + window <= words.first[1:][row]  # windows that lie within one row
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    head = np.flatnonzero(fresh & whole)
    group = np.cumsum(fresh & whole)[whole] - 1
    size = np.bincount(group, minlength=len(head)).astype(np.int64)
    content = span_hashes(words.hash, head, head + size + window - 1)
    return row[head], head - words.first[row[head]], size, grams[place[head]], content


def _later(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of passages by their keys and then by document and start; each one's group; which are not the earliest place."""
    by = np.lexsort((*order[::-1], *keys))
    if not len(by):
        return by, by, np.zeros(0, bool)
    fresh = np.ones(len(by), bool)
    fresh[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    group = np.cumsum(fresh) - 1
    head = np.flatnonzero(fresh)[group]
    return by, group, np.any([o[by] != o[by][head] for o in order], axis=0)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of equal values."""
    if len(values):
        bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield int(values[a]), a, b


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


_PACKED = "part int, shard int, repeated boolean, n int, body binary"
_PACKED_TYPES = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
#: Of places that repeat an earlier one of their block the shard needs no more than where they are and what they equal.
_KINDS = ("<u4", "<u8", "<i8", "<u4", "<u4", "u1")


def _unpack(row: dict) -> list[np.ndarray]:
    out, at, n = [], 0, row["n"]
    for kind in _KINDS:
        out.append(np.frombuffer(row["body"], kind, n, at))
        at += out[-1].nbytes
    return out


def _hot_anchors(window: int, anchor: int, share: float):
    """Anchors that hold this share of a block's passages: at most 1 / share a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_blocks(batch.column(0)):
                anchors, n = np.unique(passages(words, window, anchor)[3], return_counts=True)
                keep = n >= max(3, share * n.sum())
                yield pa.record_batch([pa.array(anchors[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

    return releasing(run)


def _find_passages(shards: int, parts: int, window: int, anchor: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, words in word_blocks(batch.column(2), block=8 << 20):
                row, start, size, grams, content = passages(words, window, anchor)
                calm = ~np.isin(grams, hot)
                row, start, size, grams, content = (x[calm] for x in (row, start, size, grams, content))
                places = (doc[row + first], tag[row + first], start)
                by, _, later = _later((content, grams), places)
                # Anchors are least hashes and so crowd at the low end; mixed anew they are even.
                even = mix(grams[by])
                columns = [even & np.uint64(2**32 - 1), *(x[by] for x in (content, *places, size))]
                shard, rows = _shard_of(even, shards), []
                for repeated in (False, True):
                    some = np.flatnonzero(later == repeated)
                    some = some[np.argsort(shard[some], kind="stable")]
                    for k, a, b in _runs(shard[some]):
                        body = b"".join([x[some[a:b]].astype(kind).tobytes() for x, kind in zip(columns, _KINDS, strict=True)])
                        rows.append((k * parts // shards, k, repeated, b - a, body))
                cells = zip(*rows, strict=True) if rows else [[]] * len(_PACKED_TYPES)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, _PACKED_TYPES, strict=True)], names=["part", "shard", "repeated", "n", "body"])

    return releasing(run)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard, from rows sorted by shard."""
    number, held = None, []
    for batch in batches:
        for k, a, b in _runs(batch.column("shard").to_numpy(zero_copy_only=False)):
            if held and k != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = k
            held.append(batch.slice(a, b - a))
    if held:
        yield number, pa.Table.from_batches(held)


_MARKS = "shard int, doc long, tag long, start int, windows int, same int, kind byte"
WANTED, COPY, SPREAD, REPEATED = range(4)


def _marks(shard: int, doc, tag, start, windows, same, kind: int) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch(
        [
            pa.array(np.full(n, shard, np.int32)),
            pa.array(np.asarray(doc, np.int64)),
            pa.array(np.asarray(tag, np.int64)),
            pa.array(np.asarray(start, np.int32)),
            pa.array(np.asarray(windows, np.int32)),
            pa.array(np.broadcast_to(np.asarray(same, np.int32), n).copy()),
            pa.array(np.full(n, kind, np.int8)),
        ],
        names=["shard", "doc", "tag", "start", "windows", "same", "kind"],
    )


def _settle(spread_from: int):
    """Per shard the passages whose anchor others have too.

    ``WANTED`` are the first places of each different passage, whose words are to be fetched, ``COPY`` the later
    places of one (``same`` is its number in the shard), ``SPREAD`` all places of an anchor with many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in _by_shard(batches):
            anchor, content, doc, tag, start, size = (np.concatenate(c) for c in zip(*map(_unpack, table.select(["n", "body"]).to_pylist()), strict=True))
            by, group, later = _later((content, anchor), (doc, tag, start))
            anchor, doc, tag, start, size = (x[by] for x in (anchor, doc, tag, start, size))
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            _, own, n = np.unique(anchor[heads], return_inverse=True, return_counts=True)
            copied = np.bincount(group, later) > 0
            different = n[own][group]
            frequent = different > spread_from
            # A passage is of concern if its anchor has another one, or if it has a later place itself.
            shared = ((different > 1) | copied[group]) & ~frequent
            for kind, some in ((WANTED, shared & ~later), (COPY, shared & later), (SPREAD, frequent)):
                yield _marks(shard, doc[some], tag[some], start[some], size[some], group[some], kind)

    return releasing(run)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_WORDS = "part int, shard int, doc long, tag long, start int, same int, words binary"


def _rows_with_words(parts: int, shards: int, shard, doc, tag, start, same, flat: np.ndarray, lengths: np.ndarray, without: np.ndarray) -> pa.RecordBatch:
    """Rows with the words of each place, none where ``without``."""
    offsets = np.concatenate([[0], np.cumsum(lengths * 8)]).astype(np.int64)
    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.astype("<u8").tobytes())])
    words = pc.if_else(pa.array(without), pa.scalar(None, pa.large_binary()), body).cast(pa.binary())
    shard = np.asarray(shard, np.int64)
    return pa.record_batch(
        [
            pa.array((shard * parts // shards).astype(np.int32)),
            pa.array(shard.astype(np.int32)),
            pa.array(np.asarray(doc, np.int64)),
            pa.array(np.asarray(tag, np.int64)),
            pa.array(np.asarray(start, np.int32)),
            pa.array(np.asarray(same, np.int32)),
            words,
        ],
        names=["part", "shard", "doc", "tag", "start", "same", "words"],
    )


def _windows(parts: int, shards: int, window: int, words: Words, at: np.ndarray, doc, tag, start) -> pa.RecordBatch:
    """Windows one by one, each to the shard of its hash; the words go along with the first place of each in this block.

    The later places are repeated, whatever other blocks hold; they go to any shard, to be passed on.
    """
    h = ngrams(words.hash, window)[at]
    by, _, later = _later((h,), (doc, tag, start))
    h, at, doc, tag, start = (x[by] for x in (h, at, doc, tag, start))
    lengths = np.where(later, 0, window)
    shard = np.where(later, (doc + start) % shards, _shard_of(h, shards))
    flat = words.hash[_ragged(at[~later], lengths[~later])]
    return _rows_with_words(parts, shards, shard, doc, tag, start, np.full(len(h), -1), flat, lengths, later)


def _hot_windows(shards: int, parts: int, window: int, anchor: int, hot: np.ndarray):
    """The windows of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, words in word_blocks(batch.column(2)):
                row, start, size, grams, _ = passages(words, window, anchor)
                some = np.isin(grams, hot)
                row, start, size = row[some], start[some], size[some]
                at = _ragged(words.first[row] + start, size)
                row = np.repeat(row, size)
                yield _windows(parts, shards, window, words, at, doc[row + first], tag[row + first], at - words.first[row])

    return releasing(run)


def _fetch(window: int, shards: int, parts: int):
    """The words of the wanted passages of each document; those of an anchor with many passages go window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            offsets, cells = wanted.offsets.to_numpy(), wanted.flatten()
            offsets = offsets - offsets[0]
            shard, start, size, same, spread = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for first, stop, words in word_blocks(batch.column("text")):
                some = np.arange(offsets[first], offsets[stop])
                row = np.repeat(np.arange(first, stop), np.diff(offsets[first : stop + 1]))
                at = words.first[row - first] + start[some]
                for many in (False, True):
                    own = spread[some] == many
                    r, k, a = row[own], some[own], at[own]
                    if many:
                        n = size[k].astype(np.int64)
                        a = _ragged(a, n)
                        r = np.repeat(r, n)
                        yield _windows(parts, shards, window, words, a, doc[r], tag[r], a - words.first[r - first])
                    else:
                        n = size[k].astype(np.int64) + window - 1
                        yield _rows_with_words(parts, shards, shard[k], doc[r], tag[r], start[k], same[k], words.hash[_ragged(a, n)], n, np.zeros(len(k), bool))

    return releasing(run)


def _search(window: int):
    """Per shard: an FM-index over its passages, and the runs of windows of each place that occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in _by_shard(batches):
            doc, tag, start, same = (table.column(c).to_numpy() for c in ("doc", "tag", "start", "same"))
            words = table.column("words").combine_chunks()
            bare = words.is_null().to_numpy(zero_copy_only=False)
            passed = bare & (same < 0)
            if passed.any():
                yield _marks(shard, doc[passed], tag[passed], start[passed], np.ones(passed.sum()), 0, REPEATED)
            held = np.flatnonzero(~bare)
            if not len(held):
                continue
            # In the order of the documents; rows that repeat a document bring its passages again.
            held = held[np.lexsort((start[held], tag[held], doc[held]))]
            again = np.all([x[held][1:] == x[held][:-1] for x in (doc, tag, start)], axis=0)
            held = held[np.concatenate([[True], ~again])]
            body = words.take(pa.array(held))
            lengths = np.diff(np.frombuffer(body.buffers()[1], np.int32, len(body) + 1, body.offset * 4)) // 8
            index = FmIndex(np.frombuffer(body.buffers()[2], "<u8")[: lengths.sum()], lengths)
            passage, first, size = index.repeated_windows(window)
            at = held[passage]
            yield _marks(shard, doc[at], tag[at], start[at] + first, size, 0, REPEATED)
            # The later places of a passage are streamed as one: the first place is earlier than all of them.
            copies = np.flatnonzero(bare & (same >= 0))
            if not len(copies):
                continue
            numbered = np.flatnonzero(same[held] >= 0)
            numbered = numbered[np.argsort(same[held][numbered], kind="stable")]
            place = np.searchsorted(same[held][numbered], same[copies])
            of = numbered[place]
            passage, first, size = index.repeated_windows(window, np.unique(of), anywhere=True)
            turn = np.argsort(passage, kind="stable")
            passage, first, size = passage[turn], first[turn], size[turn]
            low, high = np.searchsorted(passage, of), np.searchsorted(passage, of, side="right")
            run_ = _ragged(low, high - low)
            copies = np.repeat(copies, high - low)
            yield _marks(shard, doc[copies], tag[copies], start[copies] + first[run_], size[run_], 0, REPEATED)

    return releasing(run)


def _keep(window: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column("text").cast(pa.binary()), batch.column("marks").to_pylist()
            count, removed, kept = [], [], []
            for i, spans in enumerate(marks):
                words = (texts[i].as_py() or b"").split()
                keep = np.ones(len(words), bool)
                for s in spans or ():
                    keep[s["start"] : s["start"] + s["windows"] + window - 1] = False
                out = b" ".join(compress(words, keep.tolist()) if spans else words)
                count.append(len(words))
                removed.append(int(len(words) - keep.sum()))
                kept.append(hashlib.sha256(out).hexdigest() if digests else out.decode("utf-8", "replace"))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256" if digests else "kept"],
            )

    return releasing(run)


def remove_repeats(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
    digests: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and the kept words (or their digest) joined by spaces."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(df[text_col].cast("string")))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    parts = min(shards, max(4 * spark.sparkContext.defaultParallelism, -(-shards // SHARDS_A_TASK)))
    text = df[text_col].cast("string")
    docs = df.select(
        F.coalesce(df[id_col].cast("long"), F.lit(-(2**63))).alias("doc"),
        F.coalesce(F.xxhash64(text), F.lit(0)).bitwiseAND(F.lit(2**32 - 1)).alias("tag"),
        df[id_col].cast("long").alias("doc_id"),
        text.alias("text"),
    )
    # Rows that repeat id and text are one document up to the last join.
    again = materialize(docs.groupBy("doc", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "tag"), "repeated-rows")
    every = docs
    if not again.isEmpty():
        once = docs.join(again, ["doc", "tag"], "left_semi").groupBy("doc", "tag").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        docs = docs.join(again, ["doc", "tag"], "left_anti").unionByName(once)
    some = docs.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(HOT_SAMPLE)) == 0).select("text")
    often = some.mapInArrow(_hot_anchors(window, anchor, HOT_SHARE), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    hot = np.array([r["h"] for r in often.orderBy(F.desc("n"), "h").limit(int(1 / HOT_SHARE)).collect()], np.int64).view(np.uint64)
    places = docs.select("doc", "tag", "text")
    marks = materialize(
        places.mapInArrow(_find_passages(shards, parts, window, anchor, hot), _PACKED)
        .repartitionById(parts, "part")
        .sortWithinPartitions("shard")
        .mapInArrow(_settle(SPREAD_FROM), _MARKS),
        "marks",
    )
    # Both joins below bring the texts together with marks of their documents by the same shuffle.
    wanted = F.struct("shard", "start", "windows", "same", (F.col("kind") == SPREAD).alias("spread"))
    wanted = marks.where(F.col("kind") != COPY).groupBy("doc", "tag").agg(F.collect_list(wanted).alias("wanted"))
    fetched = docs.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "wanted").mapInArrow(_fetch(window, shards, parts), _WORDS)
    copies = marks.where(F.col("kind") == COPY).select(
        F.expr(f"int(bigint(shard) * {parts} div {shards})").alias("part"), "shard", "doc", "tag", "start", "same", F.lit(None).cast("binary").alias("words")
    )
    sent = fetched.unionByName(copies)
    if len(hot):
        sent = sent.unionByName(places.mapInArrow(_hot_windows(shards, parts, window, anchor, hot), _WORDS))
    searched = sent.repartitionById(parts, "part").sortWithinPartitions("shard").mapInArrow(_search(window), _MARKS)
    spans = searched.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    out = f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digests else 'kept'} string"
    return every.join(spans, ["doc", "tag"], "left").select("doc", "tag", "doc_id", "text", "marks").mapInArrow(_keep(window, digests), out)
