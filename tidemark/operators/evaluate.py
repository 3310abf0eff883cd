"""Retrieval evaluation: searches of the cases in each mode, hits, deltas between layers, gates, latency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import keyword, postings, search, shards
from tidemark.session import materialize

MODES = ("vector", "keyword", "hybrid")


def search_cases(cases: DataFrame, vectors: DataFrame, index: postings.Index | DataFrame, k: int, depth: int = 20, passing: DataFrame | None = None) -> DataFrame:
    """The k best of every case in each mode: case_id, mode, rank, id.

    cases: (case_id, query, q); vectors: (id, v); passing: the ids that a layer holds, all if none are given. The index may be
    shards (``shards.pack``), for very many cases; which documents the layer holds is then marked in them. A case is
    searched without its own row, so that it can't find itself. A case whose vector cannot be scored has no vector
    results, one whose query has no words no keyword results; the hybrid list fuses what the two modes found.
    """
    layer = (lambda rows: rows) if passing is None else (lambda rows: rows.join(passing.select("id").distinct(), "id", "left_semi"))
    asked = cases.select(F.col("case_id").alias("query_id"), "q")
    near = search.nearest(layer(vectors), asked, depth + 1, id_col="id", vector_col="v")
    queries = cases.select(F.col("case_id").alias("query_id"), "query")
    words = layer(postings.keyword_scores(index, queries)) if isinstance(index, postings.Index) else shards.best(index, queries, depth + 1)
    near = search.top_k(near.where("id <> query_id"), depth)
    words = keyword.top_k(words.where("id <> query_id"), depth)
    found = {"vector": near, "keyword": words, "hybrid": search.top_k(search.rrf((near, 1.0), (words, 1.0)), k, 9)}
    lists = [rows.where(F.col("rank") <= k).select(F.col("query_id").alias("case_id"), F.lit(m).alias("mode"), "rank", "id") for m, rows in found.items()]
    return materialize(reduce(DataFrame.unionByName, lists), "case-results")


def hits(cases: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Per case and mode whether one of the first k results is expected.

    cases: (case_id, mode, expected); results: (case_id, mode, rank, source). A case without an expected source is
    hit by any result that has one.
    """
    found = results.where(F.col("rank") <= k).select("case_id", "mode", "source")
    met = F.when(F.col("expected").isNull(), F.col("source").isNotNull()).otherwise(F.col("source") == F.col("expected"))
    hit = F.max(F.coalesce(met, F.lit(False)))
    return cases.join(found, ["case_id", "mode"], "left").groupBy("case_id", "mode").agg(hit.alias("hit"))


def totals(per_case: DataFrame, *keys: str) -> DataFrame:
    n, good = F.count(F.lit(1)), F.count_if("hit")
    return per_case.groupBy(*keys).agg(n.alias("cases"), good.alias("hits"), (n - good).alias("misses"), F.round(good / n, 6).alias("rate"))


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per mode what the second layer's totals differ by."""
    left = a.select("mode", F.col("hits").alias("raw_hits"), F.col("rate").alias("raw_rate"))
    right = b.select("mode", F.col("hits").alias("semantic_hits"), F.col("rate").alias("semantic_rate"))
    return left.join(right, "mode").select(
        "mode",
        "raw_hits",
        "semantic_hits",
        (F.col("semantic_hits") - F.col("raw_hits")).alias("delta_hits"),
        F.round(F.col("semantic_rate") - F.col("raw_rate"), 6).alias("delta_rate"),
    )


def failures(of_totals: DataFrame, thresholds: dict[str, dict[str, float]]) -> DataFrame:
    """Rows (mode, gate, wanted, got) of the thresholds that aren't met; min_hit_rate and min_hit_at_k."""
    rows = [(mode, gate, float(x)) for mode, gates in thresholds.items() for gate, x in gates.items()]
    wanted = of_totals.sparkSession.createDataFrame(rows, "mode string, gate string, wanted double")
    got = F.when(F.col("gate") == "min_hit_rate", F.col("rate")).otherwise(F.col("hits").cast("double"))
    return of_totals.join(F.broadcast(wanted), "mode").withColumn("got", got).where("got < wanted").select("mode", "gate", "wanted", "got")


#: Parts into which a pass cuts the interval of a wanted rank.
PARTS = 1024
#: Ranks that a latency report wants, in thousandths.
RANKS = {"median": 500, "p95": 950}


def _same(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], F.lit(True))


def _scale(of: str) -> Column:
    """What the parts of an interval are equal in: the value where the ends are near to each other, else its logarithm, by sign."""
    low, high, x = F.abs("low"), F.abs("high"), F.col(of)
    near = (F.signum("low") == F.signum("high")) & (F.greatest(low, high) <= 4 * F.least(low, high))
    return F.when(near, x).when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 745))  # above 0 for the least double


def ranked_values(df: DataFrame, value: str, ranks: dict[str, int], *keys: str) -> DataFrame:
    """Per key the values of nearest rank, ceil(n * p), for ranks in thousandths, by histogram passes.

    A pass counts the values of each wanted rank's interval in PARTS parts (a few rows per task and key, whatever the number of
    values), and takes the least and the greatest value of the part that holds the rank as the next interval, until
    both are one: some seven passes at most, however the values are spread. No task ever holds or sorts the values of a key. Null and NaN values take no part.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    of = [f"of_{k}" for k in keys]
    bounds = v.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    wanted = F.explode(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])).alias("name", "share")
    state = bounds.select(*[F.col(k).alias(f"of_{k}") for k in keys], "low", "high", "n", wanted)
    state = materialize(state.select(*of, "name", "low", "high", F.greatest(F.lit(1).cast("long"), F.expr("(n * share + 999) div 1000")).alias("rank")), "ranks")
    found = state.where("low = high")
    while not (state := state.where("low < high")).isEmpty():
        share = (_scale("v") - _scale("low")) / (_scale("high") - _scale("low"))
        inside = v.join(state, _same(keys)).where("v BETWEEN low AND high").select(*of, "name", "rank", "v", F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).alias("part"))
        counted = inside.groupBy(*of, "name", "rank", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*of, "name").orderBy("part"))
        chosen = counted.withColumn("upto", upto).where("upto >= rank AND upto - n < rank")
        state = materialize(chosen.select(*of, "name", "low", "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "ranks")
        found = found.unionByName(state.where("low = high"))
    return found.groupBy(*of).pivot("name", list(ranks)).agg(F.first("low"))


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Least, median, p95, largest and mean; percentiles are the nearest rank, ceil(n * p). A key without values has nulls."""
    plain = df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))
    return plain.join(ranked_values(df, value, RANKS, *keys), _same(keys), "left").select(*keys, "least", "median", "p95", "most", "mean")
