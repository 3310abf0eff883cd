"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from mapped files.

Counting: each task counts the n-grams of its rows a slice at a time, so a frequent n-gram is one entry per
slice, and sends them in blocks with their own dictionary of words. N-grams meet by the hash of their
context in key ranges; a range's task adds them up, keeps its sorted hash arrays (n-grams with counts,
contexts with their totals) and passes on, per suffix, the number of distinct n-grams that end in it and
their count. So level by level: the counts of a lower order are those numbers of distinct n-grams, down to
single words. Ranges are sized by the text; several go through one task, one after the other, and into one
file. The followers of frequent contexts are spread over all ranges.

Scoring: workers map the arrays into memory and look up the keys of a slice a range at a time. They keep
the parts that they used last, so neither memory nor open files grow with the model.

Tokens are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]+`` and one end per text; what lies before the first
token is the start, ``order - 1`` times. Words are told apart by 64-bit hashes, n-grams by 64 bits within a
range of some million entries.

Defined results: a null text counts as empty, whose one token is the end; with no training text every
probability is one; repeated rows are learned and scored as often as they occur; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngram_store import PartWriter, part_of
from tidemark.llm.wordhash import Words, mix, word_blocks
from tidemark.llm.worker import releasing
from tidemark.session import scratch_path

#: Words of the longest n-grams. Three take seven times the input of disk (README has the figures), two take three times.
ORDER = 2
#: Bytes of text per key range; ranges that one task may take, one after the other.
RANGE_BYTES, RANGES_A_TASK = 6_000_000, 16
#: Share of the sampled tokens from which a context is spread.
SPREAD_SHARE = 0.003
#: One row in so many is read to find frequent contexts. This only balances tasks; no count depends on it.
SPREAD_SAMPLE = 16

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_SALT = np.uint64(0xD1342543DE82EF95)
_CHAIN = np.uint64(0xA0761D6478BD642F)


def _columns(words: Words, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each token's n-gram, first to last, each row's end included, and where each row begins."""
    n_rows = len(words.first) - 1
    first = words.first + np.arange(n_rows + 1)
    token = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner], token[ends] = words.hash, END
    return _shifted(token, first, order, START), first


def _shifted(token: np.ndarray, first: np.ndarray, order: int, start) -> list[np.ndarray]:
    place = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for back in range(order - 1, 0, -1):
        own = np.full_like(token, start)
        own[back:] = token[:-back]
        own[place < back] = start
        out.append(own)
    return [*out, token]


def _context(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the words but the last."""
    out = columns[0]
    for c in columns[1:-1]:
        out = mix(out * _CHAIN + c)
    return out


def _keys(columns: list[np.ndarray], spread: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per n-gram its key, its context, and its range: by context, or by key where the context is spread. A word's key is its hash."""
    if len(columns) == 1:
        return columns[0], columns[0], _range_of(columns[0], ranges)
    context = _context(columns)
    key = mix(context * _SALT + columns[-1])
    by = np.where(np.isin(context, spread), key, context) if len(spread) else context
    return key, context, _range_of(by, ranges)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more in a list behind."""
    body = np.minimum(counts, 255).astype("u1")
    return body.tobytes() + counts[body == 255].astype("<u8").tobytes()


def _unsmall(body: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(body, "u1", n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, "<u8", offset=n)
    return counts


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _slices(batch: pa.RecordBatch, most: int = 24_000_000) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(batch):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a slice, and where each row begins."""
    tokens, sizes = [], []
    for _, _, words in word_blocks(part.column("text"), lower=True):
        columns, first = _columns(words, 1)
        tokens.append(columns[-1])
        sizes.append(np.diff(first))
    return np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _coded(token: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Dictionary of a slice's words, the start last, and per token the codes of its n-gram's words."""
    words, code = np.unique(token, return_inverse=True)
    return np.append(words, START), _shifted(code.astype(np.int32), first, order, np.int32(len(words)))


def _distinct(codes: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exactly distinct rows of codes below ``size``: places of one of each, per row its number, and their counts."""
    name = codes[0].astype(np.int64)
    names = size
    for c in codes[1:]:
        if names * size >= 2**62:
            own, name = np.unique(name, return_inverse=True)
            names = len(own)
        name = name * size + c
        names *= size
    _, at, name, n = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    return at, name, n


_PACKED = "at int, n int, words binary, codes binary, before binary, counts binary"
_PACKED_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 4]


def _pack(at: np.ndarray, words: np.ndarray, codes: list[np.ndarray], before: np.ndarray | None, counts: np.ndarray) -> pa.RecordBatch:
    """A row per value of ``at``: its n-grams as codes in a dictionary of their own, with their counts."""
    order = np.argsort(at.astype(np.uint16) if int(at.max(initial=0)) < 2**16 else at, kind="stable")
    at, codes, counts = at[order], [c[order] for c in codes], counts[order]
    before = None if before is None else before[order]
    bounds, rows, place = _runs(at), [], np.zeros(len(words), np.int32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.concatenate([c[a:b] for c in codes])
        if len(own) * 16 > len(words):
            held = np.zeros(len(words), bool)
            held[own] = True
            used = np.flatnonzero(held)
            place[used] = np.arange(len(used))
            own = place[own]
        else:
            used, own = np.unique(own, return_inverse=True)
        body = own.astype("<u2" if len(used) <= 2**16 else "<u4").tobytes()
        rows.append((int(at[a]), b - a, words[used].tobytes(), body, b"" if before is None else _small(before[a:b]), _small(counts[a:b])))
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PACKED_TYPES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _PACKED_TYPES, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Words, their places in the n-grams (a row per column), numbers of predecessors if any, and counts of a packed row."""
    words, n = np.frombuffer(row["words"], np.uint64), row["n"]
    codes = np.frombuffer(row["codes"], "<u2" if len(words) <= 2**16 else "<u4").reshape(-1, n)
    return words, codes, _unsmall(row["before"], n) if row["before"] else None, _unsmall(row["counts"], n)


def _count(order: int, ranges: int, parts: int, spread: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                words, codes = _coded(*_tokens_of(part), order)
                at, _, n = _distinct(codes, len(words))
                codes = [c[at] for c in codes]
                range_ = _keys([words[c] for c in codes], spread, ranges)[2]
                yield _pack(range_ * parts // ranges, words, codes, None, n)

    return releasing(run)


def _split(level: int, ranges: int, spread: np.ndarray):
    """Rows of a part into rows of its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes, before, counts = _unpack(row)
                own = [c.astype(np.int32) for c in codes]
                yield _pack(_keys([words[c] for c in own], spread, ranges)[2], words, own, before, counts)

    return releasing(run)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows of one range, from rows sorted by range."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["at"] != held[0]["at"]:
                yield held[0]["at"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["at"], held


def _with_escapes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as bytes, 255 where a value of the row is larger; the places and values of those rows."""
    big = np.flatnonzero(values >= 255 if values.ndim == 1 else (values >= 255).any(axis=1))
    small = np.minimum(values, 254).astype("u1")
    small[big] = 255
    return small, big, values[big]


def _read_escaped(small: np.ndarray, big_at: np.ndarray, big: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = small[at].astype(np.int64)
    large = np.flatnonzero((out if out.ndim == 1 else out[:, 0]) == 255)
    if len(large):
        out[large] = big[np.searchsorted(big_at, at[large])]
    return out


def _told(kind: int, key: int, values) -> np.ndarray:
    return np.array([[kind, key, *values, *[0] * (5 - len(values))]], np.int64)


def _reduce(level: int, folder: str, ranges: int, parts: int, spread: np.ndarray, ranges_below: int, spread_below: np.ndarray):
    """Per range of a level: its arrays into the part's file, and its n-grams' suffixes for the level below."""

    def gathered(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray | None, np.ndarray]:
        columns, before, counts = [], [], []
        for row in rows:
            words, codes, b, n = _unpack(row)
            columns.append(words[codes])
            counts.append(n)
            before.append(b)
        rows.clear()
        return list(np.concatenate(columns, axis=1)), None if before[0] is None else np.concatenate(before), np.concatenate(counts)

    def added(columns: list[np.ndarray], before: np.ndarray | None, counts: np.ndarray):
        key, context, _ = _keys(columns, spread[:0], 1)
        order = np.argsort(key)
        key = key[order]
        first = _runs(key)[:-1]
        at = order[first]
        add = lambda x: np.add.reduceat(x[order], first)
        return key[first], context[at], [c[at] for c in columns], None if before is None else add(before), add(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: PartWriter | None = None
        for r, rows in _grouped(batches):
            if out is None or out.part != r * parts // ranges:
                if out is not None:
                    out.close()
                out = PartWriter(folder, level, r * parts // ranges)
            key, context, columns, before, n = added(*gathered(rows))
            held = n if before is None else before  # what counts at this level
            of_counts = [int((held == k).sum()) for k in (1, 2, 3, 4)]
            if level == 1:
                out.add(r, {"keys": key, "before": held, "n": n})
                out.told += [_told(0, 0, [len(key), *of_counts]), _told(1, 0, [held.sum(), n.sum()])]
                continue
            own, at = np.unique(context, return_inverse=True)
            one = [np.bincount(at, held == k if k < 3 else held > 2, len(own)).astype(np.int64) for k in (1, 2, 3)]
            stats = np.stack([np.bincount(at, held, len(own)).astype(np.int64), *one], 1)
            often = np.isin(own, spread)
            out.told += [_told(0, 0, [len(key), *of_counts])]
            out.told += [np.concatenate([np.full((often.sum(), 1), 2), own[often].view(np.int64)[:, None], stats[often], np.zeros((often.sum(), 1), int)], 1)]
            own, stats = own[~often], stats[~often]
            lone = stats[:, 0] == 1
            counts, big_at, big = _with_escapes(held)
            few, big_context_at, big_stats = _with_escapes(stats[~lone])
            out.add(
                r,
                {"keys": key, "counts": counts, "big_at": big_at, "big": big, "lone": own[lone], "contexts": own[~lone], "stats": few,
                 "big_context_at": big_context_at, "big_stats": big_stats},
            )
            # Each distinct n-gram is one predecessor of its suffix.
            words, codes = np.unique(np.concatenate(columns[1:]), return_inverse=True)
            codes = codes.astype(np.int32).reshape(level - 1, -1)
            at, name, before = _distinct(list(codes), len(words))
            suffix = [c[at] for c in codes]
            total = np.bincount(name, n, len(at)).astype(np.int64)
            range_ = _keys([words[c] for c in suffix], spread_below, ranges_below)[2]
            yield _pack(range_ * parts // ranges_below, words, suffix, before, total)
        if out is not None:
            out.close()

    return releasing(run)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discount for counts 0, 1, 2, and 3 or more; bounded where the counts of counts give none."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [0.0]
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * high / low if low else 0.75
        found.append(min(max(d, 0.1), k - 0.1))
    return np.array(found)


@dataclass
class NgramModel:
    folder: str
    order: int
    ranges: int
    parts: int
    words: int  # V
    tokens: int  # N
    distinct: dict[int, int]  # n-grams of each level
    discount: dict[int, np.ndarray]  # of each level's counts
    total: int  # of the single words' numbers of predecessors
    rest: float  # what the discounts of single words leave to the uniform distribution
    spread: dict[int, np.ndarray]  # frequent contexts of each level, and their totals
    spread_stats: dict[int, np.ndarray]


def _frequent_contexts(order: int, share: float):
    """Contexts of each level that hold this share of a slice's tokens: at most 1 / share a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                token, first = _tokens_of(part)
                columns = _shifted(token, first, order, START)
                for level in range(2, order + 1):
                    context, n = np.unique(_context(columns[order - level :]), return_counts=True)
                    keep = n >= max(2, share * len(token))
                    yield pa.record_batch(
                        [pa.array(np.full(keep.sum(), level, np.int32)), pa.array(context[keep].view(np.int64)), pa.array(n[keep])], names=["level", "h", "n"]
                    )

    return releasing(run)


def _read_told(folder: str, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for level in range(1, order + 1):
                    told = part_of(folder, level, part).told
                    columns = [np.full(len(told), level), *told.T]
                    yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["level", "kind", "h", "a", "b", "c", "d", "e"])

    return releasing(run)


def train(df: DataFrame, text_col: str = "text", range_bytes: int = RANGE_BYTES, order: int = ORDER) -> NgramModel:
    """Count the n-grams of all rows, up to ``order`` words (two or more)."""
    spark = df.sparkSession
    texts = df.select(df[text_col].cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    parts = min(ranges, max(4 * spark.sparkContext.defaultParallelism, -(-ranges // RANGES_A_TASK)))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SPREAD_SAMPLE)) == 0)
    often = some.mapInArrow(_frequent_contexts(order, SPREAD_SHARE), "level int, h long, n long").groupBy("level", "h").agg(F.sum("n").alias("n"))
    spread = {}
    for level in range(2, order + 1):
        top = often.where(F.col("level") == level).orderBy(F.desc("n"), "h").limit(int(1 / SPREAD_SHARE)).collect()
        spread[level] = np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))
    spread[1] = np.zeros(0, np.uint64)
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "ngram-model"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    folder = fs.makeQualified(path).toString()
    rows = texts.mapInArrow(_count(order, ranges, parts, spread[order]), _PACKED)
    for level in range(order, 0, -1):
        rows = rows.repartitionById(parts, "at")
        if parts < ranges:
            rows = rows.mapInArrow(_split(level, ranges, spread[level]), _PACKED)
        rows = rows.sortWithinPartitions("at").mapInArrow(
            _reduce(level, folder, ranges, parts, spread[level], ranges, spread.get(level - 1, spread[1])), _PACKED
        )
    rows.write.format("noop").mode("overwrite").save()
    told = (
        spark.range(parts, numPartitions=min(parts, 2 * spark.sparkContext.defaultParallelism))
        .mapInArrow(_read_told(folder, order), "level long, kind long, h long, a long, b long, c long, d long, e long")
        .groupBy("level", "kind", "h")
        .agg(*[F.sum(c).alias(c) for c in "abcde"])
        .collect()  # two rows a level, and one per spread context
    )
    of = {(r["level"], r["kind"], r["h"]): [r[c] for c in "abcde"] for r in told}
    distinct = {level: of.get((level, 0, 0), [0] * 5)[0] for level in range(1, order + 1)}
    found = {level: discounts(*of.get((level, 0, 0), [0] * 5)[1:]) for level in range(1, order + 1)}
    stats = {
        level: np.array([of.get((level, 2, int(h)), [0] * 5)[:4] for h in spread[level].view(np.int64)], np.int64).reshape(-1, 4) for level in range(2, order + 1)
    }
    total, tokens = of.get((1, 1, 0), [0] * 5)[:2]
    n1, n2 = of.get((1, 0, 0), [0] * 5)[1:3]
    d = found[1]
    rest = (d[1] * n1 + d[2] * n2 + d[3] * (distinct[1] - n1 - n2)) / total if total else 1.0
    return NgramModel(folder, order, ranges, parts, distinct[1], tokens, distinct, found, total, rest, spread, stats)


def _look_up(model: NgramModel, level: int, range_: np.ndarray, read) -> None:
    """Calls ``read`` with the arrays of each range that is met and the places that meet it."""
    order = np.argsort(range_, kind="stable")
    bounds = _runs(range_[order])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        r = int(range_[order[a]])
        arrays = part_of(model.folder, level, r * model.parts // model.ranges).arrays(r)
        if arrays is not None:
            read(arrays, order[a:b])


def _hits(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys that are among the sorted ``own`` the places in both."""
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.argsort(keys)
    at = np.minimum(np.searchsorted(own, keys[turn]), len(own) - 1)
    hit = np.flatnonzero(own[at] == keys[turn])
    return turn[hit], at[hit]


def _words(model: NgramModel, words: np.ndarray) -> np.ndarray:
    """Per word its number of predecessors and its count."""
    out = np.zeros((len(words), 2))

    def read(arrays, places):
        hit, at = _hits(arrays["keys"], words[places])
        out[places[hit], 0], out[places[hit], 1] = arrays["before"][at], arrays["n"][at]

    _look_up(model, 1, _range_of(words, model.ranges), read)
    return out


def _ngrams(model: NgramModel, level: int, columns: list[np.ndarray]) -> np.ndarray:
    """Per n-gram its count."""
    key, _, range_ = _keys(columns, model.spread[level], model.ranges)
    out = np.zeros(len(key), np.int64)

    def read(arrays, places):
        hit, at = _hits(arrays["keys"], key[places])
        out[places[hit]] = _read_escaped(arrays["counts"], arrays["big_at"], arrays["big"], at)

    _look_up(model, level, range_, read)
    return out


def _contexts(model: NgramModel, level: int, context: np.ndarray) -> np.ndarray:
    """Per context its total, and how many followers have the counts one, two, and more."""
    out = np.zeros((len(context), 4), np.int64)

    def read(arrays, places):
        hit, _ = _hits(arrays["lone"], context[places])
        out[places[hit]] = (1, 1, 0, 0)
        hit, at = _hits(arrays["contexts"], context[places])
        out[places[hit]] = _read_escaped(arrays["stats"].reshape(-1, 4), arrays["big_context_at"], arrays["big_stats"].reshape(-1, 4), at)

    _look_up(model, level, _range_of(context, model.ranges), read)
    hit, at = _hits(model.spread[level], context)
    out[hit] = model.spread_stats[level][at]
    return out


def _scores(model: NgramModel):
    def of(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: whether it is known, log10 of the base and of the model's probability."""
        v, n = model.words, model.tokens
        words, codes = _coded(token, first, model.order)
        stats = _words(model, words[:-1])
        lower = np.full(len(stats), model.rest / (v + 1))
        if model.total:
            lower = lower + np.maximum(stats[:, 0] - model.discount[1][np.minimum(stats[:, 0], 3).astype(int)], 0) / model.total
        prob = lower[codes[-1]]
        for level in range(2, model.order + 1):
            own = codes[model.order - level :]
            at, name, _ = _distinct(own, len(words))
            columns = [words[c[at]] for c in own]
            heads, head = np.unique(_context(columns), return_inverse=True)
            seen, count = _contexts(model, level, heads), _ngrams(model, level, columns)
            total = np.maximum(seen[:, 0], 1)
            rest = np.where(seen[:, 0] > 0, seen[:, 1:] @ model.discount[level][1:] / total, 1.0)
            kept = np.maximum(count - model.discount[level][np.minimum(count, 3)], 0) / total[head]
            prob = kept[name] + rest[head][name] * prob
        base = np.log10((stats[:, 1] + 1) / (n + v + 1))
        return (stats[:, 1] > 0)[codes[-1]], base[codes[-1]], np.log10(prob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 8_000_000):
                token, first = _tokens_of(part)
                known, base, score = of(token, first)
                sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, score)]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(sums[0]),
                        pa.array(np.full(len(part), model.tokens, np.int64)),
                        pa.array(sums[1]),
                        pa.array(sums[2]),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return releasing(run)


def score(df: DataFrame, model: NgramModel, held_out: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    rows = df.select(
        df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out")
    )
    kind = rows.schema[0].dataType.simpleString()
    scored = rows.mapInArrow(
        _scores(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
