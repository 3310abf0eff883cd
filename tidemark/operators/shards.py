"""The best keyword matches of very many queries: documents in shards, queries in blocks, selection within a shard.

An inverted index that is joined with its queries makes a row for each query, word and document that holds it. Where
the queries grow with the documents, a shard keeps its postings as arrays, is searched by a block of queries at a time, and passes
on no more than each query's best. A query's words are single terms; those of a phrase are taken one by one.

Defined results are those of ``postings``; of rows that share an id each counts in the frequencies of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators import postings, search
from tidemark.session import materialize

#: Documents of a shard, and the (term, document) pairs from which it takes no further batch.
SHARD, MOST_PAIRS = 16384, 4_000_000
_SHARD = "words array<string>, dfs array<int>, rows binary, tfs binary, ids binary, held binary, lengths binary, n long, total long"
_BLOCK = "query_ids binary, sizes binary, asked array<string>, codes binary, idfs binary"


def _shard(parts: list[tuple]) -> pa.RecordBatch:
    words, codes, rows, tfs, ids, held, lengths = zip(*parts)
    shared = pa.concat_arrays(words).dictionary_encode()
    to, at = shared.indices.to_numpy(), np.cumsum([0, *map(len, words)])
    code = np.concatenate([to[a + c] for a, c in zip(at, codes)])
    row = np.concatenate([r + b for r, b in zip(rows, np.cumsum([0, *map(len, ids)]))])
    order, length = np.lexsort((row, code)), np.concatenate(lengths)
    binary = lambda x, kind: pa.array([np.asarray(x).astype(kind).tobytes()])
    return pa.record_batch(
        [
            pa.array([shared.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([np.bincount(code, minlength=len(shared.dictionary))], pa.list_(pa.int32())),
            binary(row[order], "<i4"), binary(np.concatenate(tfs)[order], "<i4"), binary(np.concatenate(ids), "<i8"), binary(np.concatenate(held), "?"),
            binary(length, "<i4"), pa.array([len(length)]), pa.array([int(length.sum())]),
        ],
        names=["words", "dfs", "rows", "tfs", "ids", "held", "lengths", "n", "total"],
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held, terms), sorted by id, as shards; rows of one id stay together."""
    parts, docs, pairs, last = [], 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if (docs >= SHARD or pairs >= MOST_PAIRS) and batch.column(0)[0].as_py() != last:
            yield _shard(parts)
            parts, docs, pairs = [], 0, 0
        n, lengths = batch.num_rows, pc.list_value_length(batch.column(2)).to_numpy()
        terms = batch.column(2).flatten().dictionary_encode()
        key, tf = np.unique(terms.indices.to_numpy().astype("i8") * n + np.repeat(np.arange(n), lengths), return_counts=True)
        parts.append((terms.dictionary, key // n, key % n, tf, batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), lengths))
        docs, pairs, last = docs + n, pairs + len(key), batch.column(0)[n - 1].as_py()
    if parts:
        yield _shard(parts)


def pack(docs: DataFrame) -> DataFrame:
    """(id, text, held) as shards, a table that searches read; documents that aren't held count, but are not found."""
    has = F.col("id").isNotNull()
    rows = docs.select(F.coalesce(F.col("id").cast("long"), F.lit(-(2**63) + 1)).alias("id"), (has & F.coalesce("held", F.lit(False))).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // SHARD))
    cut = rows.repartition(n, "id").sortWithinPartitions("id").select("id", "held", tokens(F.col("text")).alias("terms"))
    return materialize(cut.mapInArrow(_packed, _SHARD), "shards")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, words: array of (term, idf)) as blocks."""
    for batch in batches:
        words = batch.column(1).flatten()
        asked = words.field(0).dictionary_encode()
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        raw = [batch.column(0).to_numpy().astype("<i8"), sizes.astype("<i4"), asked.indices.to_numpy().astype("<i4"), words.field(1).to_numpy().astype("<f8")]
        ids, sizes, codes, idfs = [pa.array([x.tobytes()]) for x in raw]
        yield pa.record_batch([ids, sizes, pa.array([asked.dictionary.to_pylist()], pa.list_(pa.string())), codes, idfs], names=["query_ids", "sizes", "asked", "codes", "idfs"])


def _lists(shard: dict, mean: float):
    """The documents' ids and, as a function of a word's number, its documents and their shares of the score."""
    ids, number = np.unique(np.frombuffer(shard["ids"], "<i8"), return_inverse=True)
    held = np.zeros(len(ids), bool)
    held[number[np.frombuffer(shard["held"], "?")]] = True
    rows, tfs, lengths = (np.frombuffer(shard[c], "<i4") for c in ("rows", "tfs", "lengths"))
    ends = np.concatenate([[0], np.cumsum(shard["dfs"])])
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(word: int) -> tuple[np.ndarray, np.ndarray]:
        if word not in known:
            row, tf = rows[ends[word] : ends[word + 1]], tfs[ends[word] : ends[word + 1]]
            doc, length = number[row], lengths[row]
            order = np.lexsort((length, tf, doc))
            best = order[np.append(doc[order][1:] != doc[order][:-1], True)]  # of rows that share an id the best
            best = best[held[doc[best]]]
            tf, length = tf[best], length[best]
            known[word] = doc[best], tf * (postings.K1 + 1) / (tf + postings.K1 * (1 - postings.B + postings.B * length / mean))
        return known[word]

    return ids, of


def _searched(mean: float, k: int, digits: int):
    """Per query of a block the k best documents of a shard that hold all its words, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].as_py() for c in ("ids", "held", "rows", "tfs", "lengths", "query_ids", "sizes", "codes", "idfs")}
                shard["dfs"] = batch.column("dfs")[i].values.to_numpy()
                word = pc.fill_null(pc.index_in(batch.column("asked")[i].values, value_set=batch.column("words")[i].values), -1).to_numpy()
                ids, of = _lists(shard, mean)
                codes, idfs = word[np.frombuffer(shard["codes"], "<i4")], np.frombuffer(shard["idfs"], "<f8")
                query_ids, ends = np.frombuffer(shard["query_ids"], "<i8"), np.concatenate([[0], np.cumsum(np.frombuffer(shard["sizes"], "<i4"))])
                found = [[np.empty(0, "i8")], [np.empty(0, "i8")], [np.empty(0)]]
                for q, a, b in zip(query_ids, ends, ends[1:]):
                    if (codes[a:b] < 0).any():
                        continue
                    lists = sorted(((*of(c), idf) for c, idf in zip(codes[a:b], idfs[a:b])), key=lambda x: len(x[0]))
                    doc, score = lists[0][0], lists[0][1] * lists[0][2]
                    for other, share, idf in lists[1:]:
                        at = np.minimum(np.searchsorted(other, doc), len(other) - 1) if len(other) else np.zeros(0, "i8")
                        same = other[at] == doc[: len(at)]
                        doc, score = doc[: len(at)][same], score[: len(at)][same] + share[at[same]] * idf
                    score = np.round(score, digits)
                    pick = np.arange(len(doc))
                    if len(pick) > 4 * k:
                        pick = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    pick = pick[np.lexsort((ids[doc[pick]], -score[pick]))][:k]
                    for column, own in zip(found, (np.full(len(pick), q), ids[doc[pick]], score[pick])):
                        column.append(own)
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in found], names=["query_id", "id", "score"])

    return run


def best(shards: DataFrame, queries: DataFrame, k: int, digits: int = search.DIGITS) -> DataFrame:
    """Per query (query_id, query) its k best documents by BM25 among those that hold all words: query_id, id, score, rank."""
    n, total = shards.agg(F.sum("n"), F.sum("total")).first()
    words = postings.query_words(queries).select("query_id", F.explode("parts").alias("term"))
    df = shards.select(F.inline(F.arrays_zip("words", "dfs"))).groupBy(F.col("words").alias("term")).agg(F.sum("dfs").alias("df"))
    one = F.struct("term", postings.idf(F.lit(float(n or 0)), F.col("df")).alias("idf"))
    # A word that no document holds leaves its query without a match.
    asked = words.join(df, "term", "left").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_list(one).alias("words"), F.count_if(F.col("df").isNull()).alias("unmet"))
    blocks = materialize(asked.where("unmet = 0").select("query_id", "words").mapInArrow(_blocks, _BLOCK), "query-blocks")
    size = blocks.agg(F.coalesce(F.sum(F.length("codes") * 8), F.lit(0))).first()[0]
    met = shards.drop("n", "total").crossJoin(F.broadcast(blocks) if size <= search.MOST_BROADCAST else blocks)
    found = met.mapInArrow(_searched((total or 0) / max(n or 0, 1) or 1.0, k, digits), "query_id long, id long, score double")
    return search.top_k(found, k, digits)
