"""Inverted indexes as tables, and BM25 over them for query tables of any size.

An index is built once and read by every search, of all terms or of those that known queries ask for. It holds three Parquet tables:

- ``postings``: term, id, tf, length (terms of the document) and the term's positions, in directories by
  the term's hash and sorted by term and id. Ranges are cut by term *and* id, so that a frequent
  term lies in many files, and a search for a few terms reads the row groups of those alone; a search
  without phrases does not read positions.
- ``terms``: document frequency and count of each term.
- ``totals``: one row, the number of documents and their mean length.

Terms are folded runs of letters and digits (``words``), or the folded text's trigrams of code points
(``trigrams``). A phrase, and a substring of trigrams, is found by intersecting positions: an occurrence
starts where each part stands at its own distance from the start. Of a substring's trigrams only those
at every third place (and the last) are needed; the documents are first narrowed to those that hold the
piece's rarest one.

Defined results: a null text has no terms but counts as a document; rows that share an id are documents of
their own to the totals, and to a search one, whose best row counts for each word; an empty table gives empty results; further
columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fold, tokens
from tidemark.session import materialize, scratch_path

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Directories of the postings, by hash of the term.
BUCKETS = 32
#: Terms up to which a search names them to the scan; with more, it joins.
NAMED = 200
#: A trigram from each place on, but not from the second half of a code point beyond the basic plane.
TRIGRAM = r"(?s)(?=([^\uDC00-\uDFFF]..))"


def word_terms(text: Column) -> Column:
    return tokens(text)


def trigram_terms(text: Column) -> Column:
    """All runs of three code points, overlapping, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TRIGRAM), F.lit(1))


def named_trigrams(folded: Column, named: list[str]) -> Column:
    """Places of the named trigrams in a folded text, by plain search: array of (position, term)."""

    @F.arrow_udf("array<struct<position:int,term:string>>")
    def run(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            own = []
            for term in named:
                at = text.find(term)
                while at >= 0:
                    own.append({"position": at, "term": term})
                    at = text.find(term, at + 1)
            found.append(own)
        return pa.array(found, pa.list_(pa.struct([("position", pa.int32()), ("term", pa.string())])))

    return run(folded)


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """An index in a folder; see the module."""

    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals")

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """Postings of the terms of ``asked`` (column ``term``), which a short list of them lets the scan skip to."""
        named = [r["term"] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        if len(named) > NAMED:
            return self.postings
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in named], "term string").select(bucket_of(F.col("term"))).distinct().collect()] if named else []
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(named))


def build(
    df: DataFrame, id_col: str, text_col: str, terms_of: Callable[[Column], Column] = word_terms, path: str | None = None, asked: DataFrame | None = None
) -> Index:
    """Writes the index of a table's texts to a folder, in the shared one if none is named.

    With ``asked`` (column ``term``) it holds the postings of those terms alone, those that a known set of queries
    needs; the totals are of all documents. Other terms are dropped where the text is cut, before anything is shuffled.
    """
    spark = df.sparkSession
    index = Index(spark, path or scratch_path(spark, "postings"))
    cut = df.select(F.col(id_col).alias("id"), terms_of(F.coalesce(F.col(text_col), F.lit(""))).alias("terms")).select("*", F.size("terms").alias("length"))
    named = None if asked is None else [r["term"] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
    if named is not None and len(named) <= NAMED:
        if terms_of is trigram_terms:
            folded = df.select(F.col(id_col).alias("id"), fold(F.coalesce(F.col(text_col), F.lit(""))).alias("folded"))
            length = F.greatest(F.char_length("folded") - 2, F.lit(0))
            cut = folded.select("id", length.alias("length"), named_trigrams(F.col("folded"), named).alias("held"))
        else:
            placed = F.transform("terms", lambda t, i: F.struct(i.alias("position"), t.alias("term")))
            cut = cut.select("id", "length", F.filter(placed, lambda x: x["term"].isin(named)).alias("held"))
        cut = materialize(cut, "cut")
        each = cut.select("id", "length", F.inline("held"))
    else:
        each = cut.select("id", "length", F.posexplode("terms").alias("position", "term"))
        each = each if asked is None else each.join(asked.select("term").distinct(), "term", "left_semi")
    rows = (
        each.groupBy("term", "id", "length")
        .agg(F.sort_array(F.collect_set("position")).alias("positions"))
        .select(bucket_of(F.col("term")).alias("bucket"), "term", "id", F.size("positions").alias("tf"), "length", "positions")
    )
    sorted_ = rows.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    sorted_.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{index.path}/postings")
    # Row groups without any term leave no file; the schema then comes from an empty one.
    if not index_has_rows(index):
        rows.limit(0).drop("bucket").withColumn("bucket", F.lit(0)).write.mode("overwrite").parquet(f"{index.path}/postings")
    per_term = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))
    per_term.write.parquet(f"{index.path}/terms")
    cut.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length")).write.parquet(f"{index.path}/totals")
    return index


def index_has_rows(index: Index) -> bool:
    spark = index.spark
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/postings")
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return any(x.isDirectory() for x in listed)


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.ln((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, query) to one row per word: query_id, word_no, parts; a word of several parts is a phrase, one of none is left out."""
    bare = F.replace(F.coalesce("query", F.lit("")), F.lit('"'), F.lit(" "))
    words = queries.select("query_id", F.posexplode(F.split(bare, r"\s+")).alias("word_no", "word"))
    return words.select("query_id", "word_no", tokens(F.col("word")).alias("parts")).where(F.size("parts") > 0)


def asked_words(queries: DataFrame) -> DataFrame:
    """The terms that a keyword search of the queries (query_id, query) reads."""
    return query_words(queries).select(F.explode("parts").alias("term")).distinct()


def occurrences(index: Index, parts: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Documents in which all parts of a phrase stand at their offsets: query_id, word_no, id, length, tf.

    parts: (query_id, word_no, offset, term), one row for each part that has to match; candidates: (query_id, word_no, id).
    """
    listed = index.of_terms(parts).join(parts, "term")
    if candidates is not None:
        listed = listed.join(candidates, ["query_id", "word_no", "id"], "left_semi")
    needed = parts.groupBy(F.col("query_id").alias("q"), F.col("word_no").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    found = (
        listed.select("query_id", "word_no", "id", "length", "offset", F.explode("positions").alias("position"))
        .groupBy("query_id", "word_no", "id", "length", (F.col("position") - F.col("offset")).alias("start"))
        .agg(F.count(F.lit(1)).alias("held"))
    )
    own = (F.col("query_id") == F.col("q")) & (F.col("word_no") == F.col("w")) & (F.col("held") == F.col("n"))
    per_row = found.join(needed, own).groupBy("query_id", "word_no", "id", "length").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return per_row.groupBy("query_id", "word_no", "id").agg(F.max(F.struct("tf", "length")).alias("best")).select("query_id", "word_no", "id", "best.length", "best.tf")


def scored(totals: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """BM25 of documents that hold all words; found: (query_id, word_no, id, length, tf, df); totals are those of an index."""
    length = K1 * (1 - B + B * F.col("length") / F.when(F.col("mean_length") > 0, F.col("mean_length")).otherwise(1.0))
    one = idf(F.col("n_docs").cast("double"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + length)
    needed = words.groupBy(F.col("query_id").alias("q")).agg(F.count_distinct("word_no").alias("n_words"))
    scored = found.join(F.broadcast(totals)).select("query_id", "id", one.alias("one"))  # the totals are one row
    return (
        scored.groupBy("query_id", "id")
        .agg(F.sum("one").alias("score"), F.count(F.lit(1)).alias("held"))
        .join(needed, (F.col("query_id") == F.col("q")) & (F.col("held") == F.col("n_words")))
        .select("query_id", "id", "score")
    )


def keyword_scores(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, id, score of all documents that hold all words of a query; queries: (query_id, query)."""
    words = materialize(query_words(queries), "query-words")
    single = words.where(F.size("parts") == 1).select("query_id", "word_no", F.get("parts", 0).alias("term"))
    found = (
        index.of_terms(single)
        .join(single, "term")
        .groupBy("query_id", "word_no", "term", "id")
        .agg(F.max(F.struct("tf", "length")).alias("best"))
        .join(index.terms.select("term", "df"), "term")
        .select("query_id", "word_no", "id", "best.length", "best.tf", "df")
    )
    if not words.where(F.size("parts") > 1).isEmpty():
        parts = words.where(F.size("parts") > 1).select("query_id", "word_no", F.posexplode("parts").alias("offset", "term"))
        phrases = materialize(occurrences(index, parts), "phrases")
        held = phrases.groupBy("query_id", "word_no").agg(F.count(F.lit(1)).alias("df"))
        found = found.unionByName(phrases.join(held, ["query_id", "word_no"]).select("query_id", "word_no", "id", "length", "tf", "df"))
    return scored(index.totals, found, words)


def query_trigrams(queries: DataFrame) -> DataFrame:
    """(query_id, query) to the trigrams that a substring search reads: query_id, word_no, offset, term."""
    pieces = queries.select("query_id", F.posexplode(F.split(fold(F.coalesce(F.col("query"), F.lit(""))), r"\s+")).alias("word_no", "piece"))
    grams = pieces.where(F.char_length("piece") >= 3).select("query_id", "word_no", F.posexplode(trigram_terms(F.col("piece"))).alias("offset", "term"), (F.char_length("piece") - 3).alias("last"))
    return grams.where((F.col("offset") % 3 == 0) | (F.col("offset") == F.col("last"))).drop("last")


def substring_scores(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, id, score of all documents that hold each white-space-delimited piece of a query, by the BM25 of the pieces.

    The index is one of trigrams; pieces of fewer than three code points are left out.
    """
    known = materialize(query_trigrams(queries).join(index.terms.select("term", "df"), "term", "left"), "trigrams")
    # A trigram that no document holds leaves its query without a match; else only documents with a piece's rarest one can hold it.
    alive = known.join(known.where("df IS NULL").select("query_id").distinct(), "query_id", "left_anti")
    rarest = Window.partitionBy("query_id", "word_no").orderBy("df", "offset")
    alive = materialize(alive.withColumn("place", F.row_number().over(rarest)), "trigrams")
    first = alive.where("place = 1").select("query_id", "word_no", "term")
    narrowed = materialize(index.of_terms(first).select("term", "id").join(first, "term").select("query_id", "word_no", "id").distinct(), "candidates")
    found = materialize(occurrences(index, alive.select("query_id", "word_no", "offset", "term"), narrowed), "substrings")
    held = found.groupBy("query_id", "word_no").agg(F.count(F.lit(1)).alias("df"))
    return scored(index.totals, found.join(held, ["query_id", "word_no"]), alive)
