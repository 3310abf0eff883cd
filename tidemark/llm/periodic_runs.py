"""Runs of words that repeat with a period, found by joining suffix classes in order of descending LCP.

The words from a place i and from a place j = i + q agree for l words exactly where a stretch of
period q covers l + q words from i. At level l the suffixes fall into classes that share l words.
Levels are taken in descending order, and the classes that meet at a level are united by union-find,
each class holding its places in order (smaller into larger). Two places that become neighbours, at a
distance q of at most l, start a stretch whose smallest period is q: with a smaller one, a place of the
same class would lie between them. Where no word to the left keeps the period, they seed the run
itself, once.

A run of length n and period q needs a level n - q, so that levels below 16 words (for runs of 24 words
and three periods) are left out, and so are all documents in which no 16 words occur twice. Words are
compared exactly; hashes only pick the documents to look at.

Each document is settled where it is read: no shuffle, and no state besides one batch. Work is
n log^2 n in a document's words, but for the moving of memory within one list of places; a document
with repeats takes some 400 bytes a word while it is looked at, whatever the others hold.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a null or blank text has no words, no run and an empty
collapsed text; repeated rows give repeated results; a null id is kept; an empty table gives an empty
result; further columns, whatever their names, play no part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordhash import mix, row_ngrams, word_blocks
from tidemark.llm.worker import releasing
from tidemark.session import spread_small

#: A run has so many words, and so many periods, at least.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Bytes of text that are looked at together; a longer text is alone.
BLOCK_BYTES = 1 << 20

Run = tuple[int, int, int]  # start, length, period


def least_level(min_length: int, min_periods: int) -> int:
    """Words that the two places of a run's seed share at least: n - q, for any period."""
    return min(max(min_length - q, (min_periods - 1) * q) for q in range(1, min_length + 1))


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and each place's rank there, by doubling of prefixes."""
    rank, n, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), len(ids), 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        rank[order] = new
        k *= 2
        if n == 0 or new[-1] == n - 1 or k >= n:
            return order, rank


def shared_words(ids: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Words that each suffix shares with the one before it in the order."""
    n, shared, h = len(ids), [0] * len(ids), 0
    for i, r in enumerate(rank):
        if not r:
            h = 0
            continue
        j = order[r - 1]
        while i + h < n and j + h < n and ids[i + h] == ids[j + h]:
            h += 1
        shared[r] = h
        if h:
            h -= 1
    return shared


def unite(large: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Moves the places of ``small`` into ``large``; yields the pairs, one of each, that become neighbours."""
    if 8 * len(small) > len(large):
        of_small = set(small)
        large += small
        large.sort()
        for left, right in zip(large, large[1:], strict=False):
            if (left in of_small) != (right in of_small):
                yield left, right
        return
    gaps = [bisect_left(large, x) for x in small]
    for k, (x, gap) in enumerate(zip(small, gaps, strict=True)):
        if gap and (not k or gaps[k - 1] != gap):
            yield large[gap - 1], x
        if gap < len(large) and (k + 1 == len(small) or gaps[k + 1] != gap):
            yield x, large[gap]
    for x, gap in zip(reversed(small), reversed(gaps), strict=True):
        large.insert(gap, x)


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[Run]:
    """Runs of one or several texts, in any order. ``ids`` names the words; different texts share no id."""
    least = least_level(min_length, min_periods)
    places, ranks = suffix_order(ids)
    ids, order = ids.tolist(), places.tolist()
    shared = np.array(shared_words(ids, order, ranks.tolist()))
    meet = np.flatnonzero(shared >= least)
    meet = meet[np.argsort(-shared[meet], kind="stable")]
    above, members, runs = {}, {}, []

    def root(x: int) -> int:
        top = x
        while (up := above.get(top)) is not None:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for r, level in zip(meet.tolist(), shared[meet].tolist(), strict=True):
        a, b = root(r - 1), root(r)
        one, other = members.pop(a, None) or [order[a]], members.pop(b, None) or [order[b]]
        if len(one) < len(other):
            a, b, one, other = b, a, other, one
        above[b], members[a] = a, one
        for i, j in unite(one, other):
            period = j - i
            if level + period >= min_length and level >= (min_periods - 1) * period and (not i or ids[i - 1] != ids[j - 1]):
                runs.append((i, level + period, period))
    return runs


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[Run]]:
    """Per text, given as its words, its runs by start, then period."""
    ids, first = [], [0]
    for words in texts:
        base, seen = len(ids), {}
        ids += [seen.setdefault(w, base + len(seen)) for w in words]
        first.append(len(ids))
    out = [[] for _ in texts]
    runs = sorted(find_runs(np.array(ids, np.int64), min_length, min_periods), key=lambda run: (run[0], run[2])) if ids else []
    for (start, length, period), text in zip(runs, (np.searchsorted(first, [r[0] for r in runs], side="right") - 1).tolist(), strict=True):
        out[text].append((start - first[text], length, period))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped)[:-1].tolist(), strict=True) if not d]


def _repeating(text: pa.Array, n: int) -> Iterator[tuple[int, int, set[int]]]:
    """Blocks of rows, and those in which some n words occur twice (by their hashes, so that a few more may be named)."""
    for start, stop, words in word_blocks(text, block=BLOCK_BYTES):
        grams, first = row_ngrams(words, n)
        row = np.repeat(np.arange(stop - start), np.diff(first))
        key = mix(grams + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        twice = order[1:][key[order[1:]] == key[order[:-1]]]
        yield start, stop, set(np.unique(row[twice]).tolist())


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(min_length: int, min_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            for start, stop, chosen in _repeating(text, least_level(min_length, min_periods)):
                words = [(t or b"").split() for t in text.slice(start, stop - start).to_pylist()]
                chosen = sorted(chosen)
                runs = dict(zip(chosen, runs_of_texts([words[k] for k in chosen], min_length, min_periods), strict=True))
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.get(k, ())] for k in range(stop - start)]
                kept = [b" ".join(collapse(w, runs[k]) if runs.get(k) else w) for k, w in enumerate(words)]
                yield pa.record_batch(
                    [batch.column(0).slice(start, stop - start), pa.array(rows, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    return releasing(run)


def periodic_runs(
    df: DataFrame, text_col: str | Column = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """Per row: doc_id, runs (start, length and period in words, by start, then period), collapsed (the words kept, with a space between)."""
    text = (df[text_col] if isinstance(text_col, str) else text_col).cast("string")
    rows = spread_small(df).select(df[id_col].alias("doc_id"), text.alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_finder(min_length, min_periods), f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text, or, where ten divides the CRC-32 of the id's decimal text, its words made periodic from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # The array is bound once, as the one element of an array, so that it is not split anew for each word.
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.get(F.transform(F.array(words), periodic), 0)).otherwise(text)


def run_report(runs: DataFrame) -> DataFrame:
    """The runs' number, the one of the greatest exponent, and digests of all runs and of the collapsed text."""
    # Exponents compare as exact fractions, by cross-multiplying.
    best = F.aggregate(
        "runs",
        F.get("runs", 0),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return runs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
