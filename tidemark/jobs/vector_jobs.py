"""Vector queries over ``embeddings``, snapshots of them, and ranked fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import search as S
from tidemark.operators import snapshots as N
from tidemark.session import read_table


def _probe(spark, sf_dir):
    """Every vector beside the vector of ``vec_id = 0``, one row that is broadcast."""
    e = read_table(spark, sf_dir, "embeddings")
    query = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(query))


def search_vector(spark, sf_dir):
    """Exact cosine top-10 for the vector of ``vec_id = 0``."""
    score = F.round(V.dot(V.normalize(F.col("embedding")), V.normalize(F.col("q"))), 6)
    return _probe(spark, sf_dir).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


def vec_dot(spark, sf_dir):
    return _probe(spark, sf_dir).select("vec_id", F.round(V.dot(F.col("embedding"), F.col("q")), 6).alias("dot"))


def vec_cosine(spark, sf_dir):
    d = V.cosine_distance(V.normalize(F.col("embedding")), V.normalize(F.col("q")))
    return _probe(spark, sf_dir).select("vec_id", (F.round(d, 6) + 0.0).alias("distance"))


def vec_l2(spark, sf_dir):
    return _probe(spark, sf_dir).select("vec_id", F.round(V.l2_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


def vec_neg_dot(spark, sf_dir):
    return _probe(spark, sf_dir).select("vec_id", F.round(V.dot_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


def vec_normalize(spark, sf_dir):
    """Each vector's normalised components, one row each."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def distance_to_score(spark, sf_dir):
    e, q = F.col("embedding"), F.col("q")
    return _probe(spark, sf_dir).select(
        "vec_id",
        F.round(V.distance_to_score(V.cosine_distance(V.normalize(e), V.normalize(q)), "cosine"), 6).alias("cosine"),
        F.round(V.distance_to_score(V.l2_distance(e, q), "l2"), 6).alias("l2"),
        F.round(V.distance_to_score(V.dot_distance(e, q), "dot"), 6).alias("dot"),
        V.distance_to_score(V.dot_distance(e, q), "other").alias("other"),
    )


def _asked(spark, sf_dir):
    """The stated query set: vectors whose id is divisible by 20."""
    return read_table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _knn(spark, sf_dir, vectors, k, metric="cosine"):
    return S.nearest(vectors, _asked(spark, sf_dir), k, metric)


def knn_join(spark, sf_dir):
    """Top-5 by cosine of every query of the stated set against all vectors."""
    found = _knn(spark, sf_dir, read_table(spark, sf_dir, "embeddings"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def search_vector_filtered(spark, sf_dir):
    """Top-5 by L2 among the vectors whose label passes a filter; the filter comes before the ranking."""
    found = _knn(spark, sf_dir, read_table(spark, sf_dir, "embeddings").where("label IN (1, 3, 5)"), 5, "l2")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def search_include_uncommitted(spark, sf_dir):
    """Committed (labels below 8) and staged rows searched together, each result with its origin."""
    e = read_table(spark, sf_dir, "embeddings")
    done = _knn(spark, sf_dir, e.where("label < 8"), 5).withColumn("committed", F.lit(True))
    staged = _knn(spark, sf_dir, e.where("label >= 8"), 5).withColumn("committed", F.lit(False))
    found = S.top_k(S.best_per_item(done.unionByName(staged)), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score", "committed")


def merge_dedup(spark, sf_dir):
    """The same id in two segments keeps its best score: here each vector and its reverse."""
    e = read_table(spark, sf_dir, "embeddings")
    again = e.withColumn("embedding", F.reverse("embedding"))
    segments = [_knn(spark, sf_dir, x, 3, "dot") for x in (e, again)]
    found = S.top_k(S.best_per_item(segments[0].unionByName(segments[1])), 3)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _two_lists(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    a = _knn(spark, sf_dir, e, 20)
    b = _knn(spark, sf_dir, e.where("label % 2 = 0"), 20, "l2")
    return a, b


def rrf_fuse(spark, sf_dir):
    """Weighted reciprocal-rank fusion of a cosine list and an L2 list per query."""
    a, b = _two_lists(spark, sf_dir)
    found = S.top_k(S.rrf((a, 1.0), (b, 0.5)), 10, 9)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def search_fused(spark, sf_dir):
    """Two layers fused by provenance key; the key of a vector is its id without the last digit."""
    a, b = (x.withColumn("key", F.expr("id div 10")).select("query_id", "key", "id", "rank") for x in _two_lists(spark, sf_dir))
    fused = S.fuse_layers(a, b).select("query_id", F.col("key").alias("id"), "score", "layers")
    return S.top_k(fused, 10, 9).select("query_id", "rank", F.col("id").alias("key"), "score", "layers")


# Snapshots: a vector's segment is its label, its collection the parity of its id.


def _records(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), F.col("vec_id") % 2).alias("collection_id"),
        F.concat(F.lit("s"), F.col("label")).alias("segment_id"),
        F.col("vec_id").cast("string").alias("chunk_id"),
        "vec_id",
        "embedding",
    )


def _manifests(spark, sf_dir):
    """Version 0 of each collection: labels below 5; version 1: all labels."""
    r = _records(spark, sf_dir).select("collection_id", "segment_id").distinct()
    all_ids = F.array_sort(F.collect_set("segment_id"))
    held = r.groupBy("collection_id").agg(all_ids.alias("every"))
    zero = held.select("collection_id", F.lit(0).alias("version"), F.filter("every", lambda s: s < "s5").alias("segment_ids"))
    return zero.unionByName(held.select("collection_id", F.lit(1).alias("version"), F.col("every").alias("segment_ids")))


def _tombstones(spark, sf_dir):
    """From version 1 on, ids divisible by 7 are dead."""
    return _records(spark, sf_dir).where("vec_id % 7 = 0").select("collection_id", "chunk_id", F.lit(1).alias("born"), F.lit(None).cast("int").alias("gone"))


def _pending(spark, sf_dir):
    return _records(spark, sf_dir).where("vec_id % 11 = 0").select("collection_id", "chunk_id")


def _shown(manifests, tombstones):
    """Manifests with the number of their tombstones, and two sums over the dead ids that tell which they are."""
    n = F.col("chunk_id").cast("long")
    dead = N.dead_at(tombstones, manifests).groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.bit_xor(n).alias("bits"))
    none = F.lit(0).cast("long")
    return manifests.join(dead, "collection_id", "left").select(
        "collection_id",
        "version",
        F.array_join("segment_ids", ",").alias("segments"),
        F.coalesce("n", none).alias("n_tombstones"),
        F.coalesce("total", none).alias("tombstone_sum"),
        F.coalesce("bits", none).alias("tombstone_xor"),
    )


def snapshot_scan(spark, sf_dir):
    m = N.latest(_manifests(spark, sf_dir))
    return N.snapshot(_records(spark, sf_dir), m, _tombstones(spark, sf_dir)).select("collection_id", "segment_id", "vec_id")


def time_travel_scan(spark, sf_dir):
    m = N.at_version(_manifests(spark, sf_dir), 0)
    return N.snapshot(_records(spark, sf_dir), m, _tombstones(spark, sf_dir)).select("collection_id", "segment_id", "vec_id")


def tombstone_apply(spark, sf_dir):
    dead = _pending(spark, sf_dir)
    return _records(spark, sf_dir).join(dead, ["collection_id", "chunk_id"], "left_anti").groupBy("segment_id").agg(F.count(F.lit(1)).alias("live"))


def latest_manifest(spark, sf_dir):
    return _shown(N.latest(_manifests(spark, sf_dir)), _tombstones(spark, sf_dir))


def manifest_publish(spark, sf_dir):
    segments = _records(spark, sf_dir).select("collection_id", "segment_id").distinct().withColumn("status", F.lit("ready"))
    held = _tombstones(spark, sf_dir)
    new, added = N.publish(_manifests(spark, sf_dir), segments, held, _pending(spark, sf_dir))
    return _shown(new, held.unionByName(added))


def manifest_rollback(spark, sf_dir):
    return _shown(*N.rollback(_manifests(spark, sf_dir), _tombstones(spark, sf_dir), 0))


def manifest_checksum(spark, sf_dir):
    shown = latest_manifest(spark, sf_dir)
    check = N.checksum(F.split("segments", ","), F.col("n_tombstones"), F.col("tombstone_xor"), F.col("version"))
    return shown.select("collection_id", "version", check.alias("checksum"))


def compaction_stats(spark, sf_dir):
    return N.compaction(_records(spark, sf_dir), N.latest(_manifests(spark, sf_dir)), _tombstones(spark, sf_dir), _pending(spark, sf_dir))


def compact_segments(spark, sf_dir):
    """The rows of the segments that compaction writes."""
    new = N.compact(_records(spark, sf_dir), N.latest(_manifests(spark, sf_dir)), _tombstones(spark, sf_dir), _pending(spark, sf_dir))
    return new.select("collection_id", "segment_id", "vec_id")


def collection_status(spark, sf_dir):
    r = _records(spark, sf_dir)
    held = r.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("segment_id").alias("segments"), F.sum(F.size("embedding") * 4).alias("bytes")
    )
    return held.join(_pending(spark, sf_dir).groupBy("collection_id").agg(F.count(F.lit(1)).alias("tombstones")), "collection_id")


def list_collections(spark, sf_dir):
    """Collections that are not deleted; those of the labels divisible by 4 are."""
    e = read_table(spark, sf_dir, "embeddings")
    c = e.groupBy("label").agg(F.count(F.lit(1)).alias("records"), F.max(F.size("embedding")).alias("dimension"))
    return c.withColumn("deleted", F.col("label") % 4 == 0).where("NOT deleted").select(F.concat(F.lit("label-"), "label").alias("collection_id"), "dimension", "records")


def tombstones_by_reason(spark, sf_dir):
    reason = F.when(F.col("vec_id") % 3 == 0, "file_deleted").when(F.col("vec_id") % 3 == 1, "file_updated").otherwise("manual_revoke")
    return _records(spark, sf_dir).groupBy("collection_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def compaction_decision(spark, sf_dir):
    """Per segment: what its tombstones, its storage use and its cycles call for."""
    s = _records(spark, sf_dir).groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("vec_id") % 3 == 0).alias("tombstones"), F.max("vec_id").alias("last")
    )
    percent = (F.col("last") % 100).cast("double")
    return s.select(
        "segment_id",
        N.budget_action(percent).alias("budget"),
        N.compaction_decision(N.budget_action(percent), F.col("tombstones"), F.col("records"), F.col("last") % 40).alias("reason"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        search_vector, vec_dot, vec_cosine, vec_l2, vec_neg_dot, vec_normalize, distance_to_score, knn_join, search_vector_filtered,
        search_include_uncommitted, merge_dedup, rrf_fuse, search_fused, snapshot_scan, time_travel_scan, tombstone_apply, latest_manifest,
        manifest_publish, manifest_rollback, manifest_checksum, compaction_stats, compact_segments, collection_status, list_collections, tombstones_by_reason, compaction_decision,
    )
}

_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_A = "(SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"


def _ranked(rows: str, score: str, k: int, where: str = "TRUE", extra: str = "") -> str:
    return f"""
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score{extra}
        FROM (SELECT a.query_id, e.vec_id, round({score}, 6) AS score{extra} FROM {rows} e, {_A} a WHERE {where})
        QUALIFY "rank" <= {k}"""


_TWO = f"""
    a AS ({_ranked(_E, 'list_cosine_similarity(e.v, a.q)', 20)}),
    b AS ({_ranked(_E, '1 / (1 + list_distance(e.v, a.q))', 20, 'label % 2 = 0')})"""
_R = """
    r AS (SELECT 'c' || vec_id % 2 AS collection_id, 's' || label AS segment_id, vec_id::VARCHAR AS chunk_id, vec_id FROM embeddings),
    m AS (
        SELECT collection_id, 0 AS version, list_sort(list_distinct(list(segment_id) FILTER (segment_id < 's5'))) AS seg, []::VARCHAR[] AS dead
        FROM r GROUP BY 1
        UNION ALL
        SELECT collection_id, 1, list_sort(list_distinct(list(segment_id))), list_sort(list(chunk_id) FILTER (vec_id % 7 = 0))
        FROM r GROUP BY 1),
    pend AS (SELECT collection_id, chunk_id FROM r WHERE vec_id % 11 = 0)"""
_SHOW = """collection_id, version, array_to_string(seg, ',') AS segments, len(dead)::BIGINT AS n_tombstones,
    coalesce(list_sum(list_transform(dead, lambda x: x::BIGINT)), 0)::BIGINT AS tombstone_sum,
    coalesce(list_aggregate(list_transform(dead, lambda x: x::BIGINT), 'bit_xor'), 0)::BIGINT AS tombstone_xor"""
_SNAP = """
    SELECT r.collection_id, r.segment_id, r.vec_id FROM r JOIN m ON r.collection_id = m.collection_id AND m.version = {v}
    WHERE list_contains(m.seg, r.segment_id) AND NOT list_contains(m.dead, r.chunk_id)"""

ORACLE = {
    "search_vector": f"""
        SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM {_E}, {_Q} ORDER BY score DESC, vec_id LIMIT 10""",
    "vec_dot": f"SELECT vec_id, round(list_dot_product(v, q), 6) AS dot FROM {_E}, {_Q}",
    "vec_cosine": f"SELECT vec_id, round(1 - list_cosine_similarity(v, q), 6) + 0.0 AS distance FROM {_E}, {_Q}",
    "vec_l2": f"SELECT vec_id, round(list_distance(v, q), 6) AS distance FROM {_E}, {_Q}",
    "vec_neg_dot": f"SELECT vec_id, round(-list_dot_product(v, q), 6) AS distance FROM {_E}, {_Q}",
    "vec_normalize": f"""
        SELECT vec_id, (i - 1)::INTEGER AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x
        FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM {_E})""",
    "distance_to_score": f"""
        SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS cosine, round(1 / (1 + list_distance(v, q)), 6) AS l2,
               round(list_dot_product(v, q), 6) AS dot, 0.0::DOUBLE AS other FROM {_E}, {_Q}""",
    "knn_join": _ranked(_E, "list_cosine_similarity(e.v, a.q)", 5),
    "search_vector_filtered": _ranked(_E, "1 / (1 + list_distance(e.v, a.q))", 5, "label IN (1, 3, 5)"),
    "search_include_uncommitted": _ranked(
        f"(SELECT *, label < 8 AS committed FROM {_E})", "list_cosine_similarity(e.v, a.q)", 5, extra=", committed"
    ),
    "merge_dedup": _ranked(_E, "greatest(list_dot_product(e.v, a.q), list_dot_product(list_reverse(e.v), a.q))", 3),
    "rrf_fuse": f"""
        WITH {_TWO},
        s AS (SELECT query_id, vec_id, round(sum(share), 9) AS score FROM (
            SELECT query_id, vec_id, 1.0::DOUBLE / (60 + "rank") AS share FROM a
            UNION ALL SELECT query_id, vec_id, 0.5::DOUBLE / (60 + "rank") FROM b) GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score
        FROM s QUALIFY "rank" <= 10""",
    "search_fused": f"""
        WITH {_TWO},
        s AS (SELECT query_id, vec_id // 10 AS "key", round(sum(1.0::DOUBLE / (60 + "rank")), 9) AS score,
                     string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers
              FROM (SELECT *, 'raw' AS layer FROM a UNION ALL SELECT *, 'semantic' FROM b) GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "key")::INTEGER AS "rank", "key", score, layers
        FROM s QUALIFY "rank" <= 10""",
    "snapshot_scan": f"WITH {_R} {_SNAP.format(v=1)}",
    "time_travel_scan": f"WITH {_R} {_SNAP.format(v=0)}",
    "tombstone_apply": f"""
        WITH {_R} SELECT segment_id, count(*) AS live FROM r
        WHERE NOT EXISTS (SELECT 1 FROM pend p WHERE p.collection_id = r.collection_id AND p.chunk_id = r.chunk_id) GROUP BY 1""",
    "latest_manifest": f"WITH {_R} SELECT {_SHOW} FROM m WHERE version = 1",
    "manifest_publish": f"""
        WITH {_R}, n AS (
            SELECT m.collection_id, 2 AS version, m.seg,
                   list_sort(list_distinct(list_concat(m.dead, (SELECT list(chunk_id) FROM pend p WHERE p.collection_id = m.collection_id)))) AS dead
            FROM m WHERE version = 1)
        SELECT {_SHOW} FROM n""",
    "manifest_rollback": f"WITH {_R}, n AS (SELECT collection_id, 2 AS version, seg, dead FROM m WHERE version = 0) SELECT {_SHOW} FROM n",
    "compaction_stats": f"""
        WITH {_R} SELECT r.collection_id,
            count(*) FILTER (NOT (vec_id % 7 = 0 OR vec_id % 11 = 0)) AS kept,
            count(*) FILTER (vec_id % 7 = 0 OR vec_id % 11 = 0) AS removed, count(DISTINCT segment_id) AS segments
        FROM r GROUP BY 1""",
    "manifest_checksum": f"""
        WITH {_R}, x AS (SELECT {_SHOW} FROM m WHERE version = 1)
        SELECT collection_id, version, sha256('{{"segment_ids":["' || replace(segments, ',', '","') || '"],"n_tombstones":' || n_tombstones
            || ',"tombstone_bits":' || tombstone_xor || ',"version":' || version || '}}') AS checksum FROM x""",
    "compact_segments": f"""
        WITH {_R} SELECT collection_id, collection_id || '-compact-2' AS segment_id, vec_id FROM r WHERE NOT (vec_id % 7 = 0 OR vec_id % 11 = 0)""",
    "collection_status": """
        SELECT 'c' || vec_id % 2 AS collection_id, count(*) AS records, count(DISTINCT label) AS segments,
               sum(len(embedding) * 4)::BIGINT AS bytes, count(*) FILTER (vec_id % 11 = 0) AS tombstones
        FROM embeddings GROUP BY 1""",
    "list_collections": """
        SELECT 'label-' || label AS collection_id, max(len(embedding))::INTEGER AS dimension, count(*) AS records
        FROM embeddings WHERE label % 4 <> 0 GROUP BY label""",
    "tombstones_by_reason": """
        SELECT 'c' || vec_id % 2 AS collection_id,
               CASE vec_id % 3 WHEN 0 THEN 'file_deleted' WHEN 1 THEN 'file_updated' ELSE 'manual_revoke' END AS reason, count(*) AS n
        FROM embeddings GROUP BY 1, 2""",
    "compaction_decision": """
        WITH s AS (SELECT 's' || label AS segment_id, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS dead, max(vec_id) AS last
                   FROM embeddings GROUP BY 1),
        b AS (SELECT *, CASE WHEN last % 100 > 95 THEN 'skip' WHEN last % 100 > 85 THEN 'compact' WHEN last % 100 > 70 THEN 'warn'
                        ELSE 'normal' END AS budget FROM s)
        SELECT segment_id, budget, CASE WHEN budget IN ('compact', 'skip') THEN 'budget' WHEN dead >= 5 AND dead / n >= 0.3 THEN 'density'
            WHEN last % 40 >= 20 THEN 'cycles' ELSE 'none' END AS reason FROM b""",
}
