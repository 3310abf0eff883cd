"""Keyword search of a known table of queries without an index: their words and phrases are counted where the text stands.

A phrase found by positions makes a row of each place of each of its parts, and most parts are frequent words. Here the parts
of all asked words and phrases form a tree that goes to the tasks; each text is cut once, and no more leaves its row than
how often it holds each of them. Only documents that hold a query's rarest word or phrase are then scored.

Defined results are those of ``postings``; of rows that share an id each counts in the frequencies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators import postings
from tidemark.session import materialize

#: Words and phrases up to which they go to the tasks as one tree; for more an index of their terms is built.
MOST_ASKED = 100_000


def _tree(asked: list[tuple[str, ...]]):
    """The parts' words, and as arrays: the state that a first word leads to, steps (state * words + word, sorted, and the state each leads to), and the number of the phrase that ends in a state, -1 if none."""
    words = sorted({part for parts in asked for part in parts})
    number = {word: i for i, word in enumerate(words)}
    states: dict[tuple[str, ...], int] = {}
    for parts in asked:
        for n in range(1, len(parts) + 1):
            states.setdefault(parts[:n], len(states))
    first, ends = np.full(len(words), -1), np.full(len(states), -1)
    for i, parts in enumerate(asked):
        ends[states[parts]] = i
        first[number[parts[0]]] = states[parts[:1]]
    steps = sorted((states[prefix[:-1]] * len(words) + number[prefix[-1]], state) for prefix, state in states.items() if len(prefix) > 1)
    keys, to = np.array(steps, "i8").reshape(-1, 2).T
    return pa.array(words, pa.string()), first, keys, to, ends


def counts(terms: Column, asked: list[tuple[str, ...]]) -> Column:
    """How many terms a text has, and how often each asked run of terms, by its number: struct of length and array of (unit, tf)."""
    words, first, keys, to, ends = _tree(asked)

    @F.arrow_udf("struct<length:int,held:array<struct<unit:int,tf:int>>>")
    def run(texts: pa.Array) -> pa.Array:
        length = pc.list_value_length(texts).to_numpy()
        word = pc.fill_null(pc.index_in(texts.flatten(), value_set=words), -1).to_numpy()
        row, end = np.repeat(np.arange(len(texts)), length), np.repeat(np.cumsum(length), length)
        at = np.flatnonzero(word >= 0)
        state, found, n = first[word[at]], [np.empty(0, "i8")], 0
        at, state = at[state >= 0], state[state >= 0]
        while len(at):
            whole = ends[state] >= 0
            found.append(row[at[whole]] * len(ends) + ends[state[whole]])
            n += 1
            more = at + n < end[at]
            at, state = at[more], state[more]
            more = word[at + n] >= 0
            at, state = at[more], state[more]
            key = state * len(words) + word[at + n]
            step = np.searchsorted(keys, key)
            same = step < len(keys)
            same[same] = keys[step[same]] == key[same]
            at, state = at[same], to[step[same]]
        key, tf = np.unique(np.concatenate(found), return_counts=True)
        each = pa.StructArray.from_arrays([pa.array(key % len(ends), pa.int32()), pa.array(tf, pa.int32())], ["unit", "tf"])
        starts = np.searchsorted(key, np.arange(len(texts) + 1) * len(ends))
        held = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), each)
        return pa.StructArray.from_arrays([pa.array(length, pa.int32()), held], ["length", "held"])

    return run(terms)


def scores(df: DataFrame, id_col: str, text_col: str, queries: DataFrame) -> DataFrame:
    """query_id, id, score of all documents that hold all words of a query, by BM25; queries: (query_id, query)."""
    spark, words = df.sparkSession, materialize(postings.query_words(queries), "query-words")
    asked = sorted(tuple(r["parts"]) for r in words.select("parts").distinct().limit(MOST_ASKED + 1).collect())
    if len(asked) > MOST_ASKED:
        return postings.keyword_scores(postings.build(df, id_col, text_col, asked=postings.asked_words(queries)), queries)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = materialize(df.select(F.col(id_col).alias("id"), counts(tokens(text), asked).alias("x")).select("id", "x.length", "x.held"), "counts")
    totals = cut.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    df_of = cut.select(F.inline("held")).groupBy("unit").agg(F.count(F.lit(1)).alias("df"))
    units = spark.createDataFrame(pa.table({"unit": pa.array(range(len(asked)), pa.int32()), "parts": pa.array(map(list, asked), pa.list_(pa.string()))}))
    known = materialize(words.join(units, "parts").join(df_of, "unit", "left").select("query_id", "word_no", "unit", "df"), "units")
    # A word that no document holds leaves its query without a match; else only documents with a query's rarest one can hold all.
    alive = known.join(known.where("df IS NULL").select("query_id").distinct(), "query_id", "left_anti")
    rarest = Window.partitionBy("query_id").orderBy("df", "word_no")
    alive = materialize(alive.withColumn("place", F.row_number().over(rarest)), "units")
    first = alive.where("place = 1").select("query_id", "unit")
    some = materialize(cut.select("id", F.inline("held")).join(first, "unit").select("query_id", "id").distinct(), "candidates")
    near = cut.join(some.select("id").distinct(), "id", "left_semi").select("id", "length", F.inline("held"))
    found = (
        near.join(alive, "unit")
        .join(some, ["query_id", "id"], "left_semi")
        .groupBy("query_id", "word_no", "id", "df")
        .agg(F.max(F.struct("tf", "length")).alias("best"))
        .select("query_id", "word_no", "id", "best.length", "best.tf", "df")
    )
    return postings.scored(totals, found, words)
