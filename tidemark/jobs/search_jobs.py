"""Keyword and hybrid search over ``documents`` and ``embeddings``, and semantic publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import sentences, tokens, truncate
from tidemark.operators import evaluate
from tidemark.operators import keyword as K
from tidemark.operators import phrases, postings
from tidemark.operators import publication as P
from tidemark.operators import search as S
from tidemark.operators import shards
from tidemark.session import materialize, read_table, spread_small

#: The stated queries; the id is also that of the query's vector.
ASKED = {1: "the of", 2: "de la", 3: "der", 4: "license version", 5: "tionthe"}


def _docs(spark, sf_dir):
    return spread_small(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Indexes of this application, by table and the terms that they hold; a table that changes needs a new one.
_BUILT: dict[tuple[str, str, str], postings.Index] = {}


def _index(spark, sf_dir, name, asked=None, terms_of=postings.word_terms):
    """The index of the documents, of the terms ``asked`` for (all if none are given), under a name of its own."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = postings.build(_docs(spark, sf_dir), "doc_id", "text", terms_of, asked=asked)
    return _BUILT[key]


def _asked(spark):
    return spark.createDataFrame(list(ASKED.items()), "query_id long, query string")


def _scores(spark, sf_dir):
    return postings.keyword_scores(_index(spark, sf_dir, "stated", postings.asked_words(_asked(spark))), _asked(spark))


def bm25_stats(spark, sf_dir):
    """Document frequency and count of every term of the corpus."""
    return _index(spark, sf_dir, "all").terms


def search_keyword(spark, sf_dir):
    return K.top_k(_scores(spark, sf_dir), 10).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def keyword_normalized(spark, sf_dir):
    ranked = K.min_max(K.top_k(_scores(spark, sf_dir), 10))
    return ranked.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


def search_trigram(spark, sf_dir):
    """Substring search for the queries without a keyword match."""
    unmet = materialize(_asked(spark).join(_scores(spark, sf_dir).select("query_id").distinct(), "query_id", "left_anti"), "unmet")
    index = _index(spark, sf_dir, "unmet", postings.query_trigrams(unmet), postings.trigram_terms)
    hits = postings.substring_scores(index, unmet)
    return K.top_k(hits, 10).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def search_phrases(spark, sf_dir):
    """Every benchmark item as a query: its first three terms as a phrase, and its fourth."""
    terms = tokens(F.coalesce(F.col("text"), F.lit("")))
    asked = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("t")).where(F.size("t") >= 4)
    asked = asked.select("query_id", F.concat_ws(" ", F.array_join(F.slice("t", 1, 3), "-"), F.get("t", 3)).alias("query"))
    found = K.top_k(phrases.scores(_docs(spark, sf_dir), "doc_id", "text", asked), 10)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def _two_lists(spark, sf_dir, vectors, passing=None):
    """The twenty best of the stated queries by vector and by keyword."""
    e = read_table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id").isin(list(ASKED))).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    words = _scores(spark, sf_dir)
    if passing is not None:
        words = words.join(passing.select(F.col("vec_id").alias("id")), "id", "left_semi")
    return S.nearest(vectors, asked, 20), K.top_k(words, 20)


def _hybrid(spark, sf_dir, filter_vectors, filter_keywords):
    """Vector and keyword lists fused; the filter is on metadata, the label that an id has in ``embeddings``."""
    e = read_table(spark, sf_dir, "embeddings")
    passing = e.where("label IN (0, 2, 4, 6, 8)")
    near, words = _two_lists(spark, sf_dir, passing if filter_vectors else e, passing if filter_keywords else None)
    return S.top_k(S.rrf((near, 1.0), (words, 1.0)), 10, 9).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def search_hybrid(spark, sf_dir):
    """Vector and keyword lists fused, both under the filter."""
    return _hybrid(spark, sf_dir, True, True)


def search_hybrid_unfiltered_kw(spark, sf_dir):
    """The parity form: the filter holds for the vector side only."""
    return _hybrid(spark, sf_dir, True, False)


def search_hybrid_all(spark, sf_dir):
    """No filter on either side."""
    return _hybrid(spark, sf_dir, False, False)


def explain_vector(spark, sf_dir):
    """The keyword results with the preview of their text."""
    top = K.top_k(_scores(spark, sf_dir), 10).select("query_id", "rank", F.col("id").alias("doc_id"))
    return top.join(_docs(spark, sf_dir), "doc_id").select("query_id", "rank", "doc_id", F.substring("text", 1, 200).alias("preview"))


def explain_hybrid(spark, sf_dir):
    """The hybrid results with their scores and ranks in both lists, a preview and the query's terms."""
    near, words = _two_lists(spark, sf_dir, read_table(spark, sf_dir, "embeddings"))
    near, words = materialize(near, "near"), materialize(words, "words")
    fused = S.top_k(S.rrf((near, 1.0), (words, 1.0)), 10, 9)
    out = S.explain(fused, near, words, _asked(spark), read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return out.withColumnRenamed("id", "doc_id")


# Evaluation: a document whose id is divisible by 20 and has a vector is a case; it asks by its vector and by its first
# three terms, and expects documents of its own source. The semantic layer holds the documents of published bundles.


def _cases(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("q"))
    asked = F.array_join(F.slice(tokens(F.coalesce(F.col("text"), F.lit(""))), 1, 3), " ")
    return d.select(F.col("doc_id").alias("case_id"), asked.alias("query"), F.col("source").alias("expected")).join(e, "case_id")


def _case_hits(spark, sf_dir, semantic):
    cases = _cases(spark, sf_dir)
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    sources = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    live = P.live_bundles(_bundles(spark, sf_dir)).select("bundle_id")
    passing = sources.withColumn("bundle_id", F.expr("id div 10")).join(live, "bundle_id", "left_semi") if semantic else None
    texts = _docs(spark, sf_dir).withColumnRenamed("doc_id", "id")
    texts = texts.withColumn("held", F.lit(True)) if passing is None else texts.join(passing.select("id", F.lit(True).alias("held")).distinct(), "id", "left")
    found = evaluate.search_cases(cases, vectors, shards.pack(texts), 5, passing=passing).join(sources, "id")
    modes = cases.select("case_id", "expected", F.explode(F.array(*map(F.lit, evaluate.MODES))).alias("mode"))
    return evaluate.hits(modes, found, 5)


def _totals(spark, sf_dir, semantic=False):
    return evaluate.totals(_case_hits(spark, sf_dir, semantic), "mode")


def eval_case_hits(spark, sf_dir):
    """Per case and mode whether a document of the expected source is among the first five."""
    return _case_hits(spark, sf_dir, False)


def eval_hit_at_k(spark, sf_dir):
    """Cases, hits, misses and hit rate of each mode over the raw layer."""
    return _totals(spark, sf_dir)


def eval_delta(spark, sf_dir):
    """Per mode what the semantic layer's totals differ by from the raw layer's."""
    return evaluate.deltas(_totals(spark, sf_dir), _totals(spark, sf_dir, True))


#: Thresholds of the gate, per mode.
GATES = {"vector": {"min_hit_rate": 0.9, "min_hit_at_k": 1}, "keyword": {"min_hit_rate": 0.1, "min_hit_at_k": 1_000_000}, "hybrid": {"min_hit_rate": 0.5}}


def eval_gate(spark, sf_dir):
    """The thresholds that the raw layer doesn't meet."""
    return evaluate.failures(_totals(spark, sf_dir), GATES)


def search_requests(spark, sf_dir):
    """Documents as search requests, with the vector of their id if there is one; each is accepted or refused."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    mode = F.element_at(F.array(*map(F.lit, ("vector", "keyword", "hybrid", "fuzzy"))), (F.col("n_chars") % 4 + 1).cast("int"))
    text = F.when(F.col("n_chars") % 3 > 0, F.col("text")).otherwise(" \n")
    why = S.request_error(F.when(F.col("source") != "src3", F.col("source")), F.col("n_chars") % 9, mode, F.col("embedding"), text)
    return d.join(e, "doc_id", "left").select("doc_id", F.coalesce(why, F.lit("accepted")).alias("outcome"))


# Bundles: a document's is its source and group of ten ids; its units are the documents.


def _bundles(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("bundle_id")).distinct()
    live = F.col("bundle_id") % 3 == 0
    return d.select(
        "bundle_id",
        F.expr("bundle_id div 2").alias("doc_id"),
        F.when(F.col("bundle_id") % 4 == 3, "rejected").otherwise("approved").alias("status"),
        F.when(live, F.concat(F.lit("c"), F.col("bundle_id") % 2)).alias("collection_id"),
        F.when(live, F.col("bundle_id") % 5).alias("published_at"),
    )


def _requests(spark, sf_dir):
    return _bundles(spark, sf_dir).where("bundle_id % 5 <> 0").select("bundle_id", F.concat(F.lit("c"), F.col("bundle_id") % 2).alias("to_collection"), (F.col("bundle_id") % 2 == 0).alias("replace"))


def _state(b):
    return b.select("bundle_id", "doc_id", "status", "collection_id", F.col("published_at").cast("long").alias("published_at"))


def list_bundles(spark, sf_dir):
    return _state(_bundles(spark, sf_dir)).orderBy(F.desc("published_at"), F.desc("bundle_id"))


def published_bundle_for_doc(spark, sf_dir):
    return P.live_bundles(_bundles(spark, sf_dir)).select("doc_id", "collection_id", "bundle_id")


def published_unit_lookups(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("bundle_id"), F.col("doc_id").cast("string").alias("unit_id"), "text", "source")
    units = d.select("bundle_id", "unit_id", truncate(F.coalesce(F.get(sentences(F.col("text")), F.lit(0)), F.lit("")), 96).alias("title"))
    spans = d.select("bundle_id", "unit_id", F.lit(0).alias("span_index"), F.col("source").alias("source_uri"), F.concat(F.lit("chunk-"), "unit_id").alias("chunk_id"))
    return P.unit_lookups(units, _bundles(spark, sf_dir), spans)


def _judged(spark, sf_dir, action):
    return P.judge(_bundles(spark, sf_dir), _requests(spark, sf_dir), action)


def publication_log(spark, sf_dir):
    """What each publish request came to."""
    return _judged(spark, sf_dir, "publish").select("bundle_id", "to_collection", "replaced_id", F.coalesce("refused", F.lit("published")).alias("outcome"))


def audit_log(spark, sf_dir):
    """Every action that was taken: the publications, then the withdrawal of a sixth of what is live."""
    judged = _judged(spark, sf_dir, "publish")
    b = P.publish(_bundles(spark, sf_dir), judged, F.lit(100))
    gone = b.where("bundle_id % 6 = 0").select("bundle_id")
    entries = P.published_entries(judged, "editor", F.lit(100)).unionByName(P.unpublished_entries(b, gone, "steward", F.lit(300)))
    return P.audit_log(entries)


def semantic_publish(spark, sf_dir):
    return _state(P.publish(_bundles(spark, sf_dir), _judged(spark, sf_dir, "publish"), F.lit(100)))


def semantic_rollback(spark, sf_dir):
    return _state(P.publish(_bundles(spark, sf_dir), _judged(spark, sf_dir, "rollback"), F.lit(100)))


def semantic_unpublish(spark, sf_dir):
    b = _bundles(spark, sf_dir)
    return _state(P.unpublish(b, b.where("bundle_id % 6 = 0").select("bundle_id")))


def bundle_upsert(spark, sf_dir):
    """Every other bundle comes anew, a third of those rejected and some without a review."""
    b = _bundles(spark, sf_dir)
    status = F.when(F.col("bundle_id") % 6 == 0, "rejected").when(F.col("bundle_id") % 6 == 2, "approved")
    new = b.where("bundle_id % 2 = 0").select("bundle_id", "doc_id", status.alias("status"))
    return _state(P.upsert(b, new))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_stats, search_keyword, keyword_normalized, search_trigram, search_phrases, search_hybrid, search_hybrid_unfiltered_kw,
        search_hybrid_all, explain_vector, explain_hybrid, search_requests, eval_case_hits, eval_hit_at_k, eval_delta, eval_gate,
        list_bundles, published_bundle_for_doc, published_unit_lookups, publication_log, audit_log, semantic_publish, semantic_rollback,
        semantic_unpublish, bundle_upsert,
    )
}

_WORDS = ", ".join(f"({q}, '{w}')" for q, t in ASKED.items() for w in t.split())
_BM25 = rf"""
    d AS (SELECT doc_id, strip_accents(lower(coalesce(text, ''))) AS folded, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS terms FROM documents),
    st AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS avgdl FROM d),
    w AS (SELECT * FROM (VALUES {_WORDS}) v(query_id, word)),
    tf AS (SELECT query_id, word, doc_id, len(terms) AS dl, len(list_filter(terms, lambda t: t = word))::DOUBLE AS f FROM d, w WHERE list_contains(terms, word)),
    df AS (SELECT query_id, word, count(*) AS df FROM tf GROUP BY 1, 2),
    sc AS (SELECT query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS found
           FROM tf JOIN df USING (query_id, word), st GROUP BY 1, 2),
    kw AS (SELECT query_id, doc_id, round(score, 6) AS score FROM sc JOIN (SELECT query_id, count(*) AS need FROM w GROUP BY 1) USING (query_id) WHERE found = need)"""
_TOP = 'SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS "rank", doc_id, score FROM {} QUALIFY "rank" <= {}'


_PASSING = "label IN (0, 2, 4, 6, 8)"


def _hybrid_parts(vectors: str, keywords: str) -> str:
    return f"""
        {_BM25}, k2 AS (SELECT * FROM kw WHERE {keywords}), kt AS ({_TOP.format("k2", 20)}),
        vs AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
               FROM (SELECT * FROM embeddings WHERE {vectors}) e, embeddings q WHERE q.vec_id BETWEEN 1 AND 5),
        vt AS ({_TOP.format("vs", 20)}),
        f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + "rank")), 9) AS score FROM (SELECT * FROM kt UNION ALL SELECT * FROM vt) GROUP BY 1, 2)"""


def _hybrid_sql(vectors: str, keywords: str) -> str:
    return f"WITH {_hybrid_parts(vectors, keywords)} {_TOP.format('f', 10)}"


_B = """
    b AS (SELECT DISTINCT doc_id // 10 AS bundle_id, doc_id // 10 // 2 AS doc_id, CASE WHEN doc_id // 10 % 4 = 3 THEN 'rejected' ELSE 'approved' END AS status,
          CASE WHEN doc_id // 10 % 3 = 0 THEN 'c' || (doc_id // 10 % 2) END AS collection_id, CASE WHEN doc_id // 10 % 3 = 0 THEN doc_id // 10 % 5 END AS published_at FROM documents),
    live AS (SELECT * FROM b WHERE collection_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, collection_id ORDER BY published_at DESC, bundle_id DESC) = 1)"""


def _judge(rollback: bool) -> str:
    more = "WHEN live_id IS NULL THEN 'nothing to roll back' WHEN live_id = bundle_id THEN 'already live'" if rollback else ""
    return f"""{_B},
    j0 AS (SELECT b.bundle_id, b.doc_id, b.status, 'c' || b.bundle_id % 2 AS to_collection, b.bundle_id % 2 = 0 AS rep, live.bundle_id AS live_id,
           row_number() OVER (PARTITION BY b.doc_id, b.bundle_id % 2 ORDER BY b.bundle_id) AS turn
           FROM b LEFT JOIN live ON live.doc_id = b.doc_id AND live.collection_id = 'c' || b.bundle_id % 2 WHERE b.bundle_id % 5 <> 0),
    j AS (SELECT bundle_id, to_collection, CASE WHEN live_id <> bundle_id THEN live_id END AS replaced_id,
          CASE WHEN status <> 'approved' THEN 'not approved' {more} WHEN live_id <> bundle_id AND NOT rep THEN 'another bundle is live'
               WHEN turn > 1 THEN 'another request comes first' END AS refused FROM j0),
    p AS (SELECT b.bundle_id, b.doc_id, b.status,
          CASE WHEN n.bundle_id IS NOT NULL THEN n.to_collection WHEN g.replaced_id IS NOT NULL THEN NULL ELSE b.collection_id END AS collection_id,
          CASE WHEN n.bundle_id IS NOT NULL THEN 100 WHEN g.replaced_id IS NOT NULL THEN NULL ELSE b.published_at END AS published_at
          FROM b LEFT JOIN (SELECT * FROM j WHERE refused IS NULL) n USING (bundle_id)
          LEFT JOIN (SELECT DISTINCT replaced_id FROM j WHERE refused IS NULL) g ON g.replaced_id = b.bundle_id)"""


def _eval_sql(name: str, semantic: bool) -> str:
    """The evaluation of one layer, as CTEs: hits per case in ``<name>_hit``, totals in ``<name>``."""
    held = "IN (SELECT doc_id FROM documents WHERE doc_id // 10 IN (SELECT bundle_id FROM live))" if semantic else "IS NOT NULL"
    ranked = 'SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS "rank" FROM {} QUALIFY "rank" <= {}'
    return f"""
        {name}_k0 AS (SELECT case_id, doc_id AS id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
            FROM cw JOIN xf USING (term) JOIN xd USING (term), xs GROUP BY 1, 2, need HAVING count(*) = need),
        {name}_k AS ({ranked.format(f"(SELECT * FROM {name}_k0 WHERE id <> case_id AND id {held})", 20)}),
        {name}_v0 AS (SELECT case_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, cs
            WHERE vec_id <> case_id AND vec_id {held}),
        {name}_v AS ({ranked.format(f"{name}_v0", 20)}),
        {name}_h0 AS (SELECT case_id, id, round(sum(1.0::DOUBLE / (60 + "rank")), 9) AS score FROM (SELECT * FROM {name}_k UNION ALL SELECT * FROM {name}_v) GROUP BY 1, 2),
        {name}_h AS ({ranked.format(f"{name}_h0", 5)}),
        {name}_all AS (SELECT 'vector' AS mode, * FROM {name}_v UNION ALL SELECT 'keyword', * FROM {name}_k UNION ALL SELECT 'hybrid', * FROM {name}_h),
        {name}_hit AS (SELECT cs.case_id, m.mode, coalesce(bool_or(CASE WHEN expected IS NULL THEN source IS NOT NULL ELSE source = expected END), FALSE) AS hit
            FROM cs CROSS JOIN (VALUES ('vector'), ('keyword'), ('hybrid')) m(mode) LEFT JOIN (SELECT case_id, mode, source FROM {name}_all JOIN documents ON doc_id = id
                WHERE "rank" <= 5) r ON r.case_id = cs.case_id AND r.mode = m.mode GROUP BY 1, 2),
        {name} AS (SELECT mode, count(*) AS cases, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
            round(count(*) FILTER (hit) / count(*), 6) AS rate FROM {name}_hit GROUP BY 1)"""


_EVAL = rf"""{_B},
        xt AS (SELECT doc_id, source, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS terms FROM documents),
        xs AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS avgdl FROM xt),
        xf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*)::DOUBLE AS f FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM xt) GROUP BY 1, 2),
        xd AS (SELECT term, count(*) AS df FROM xf GROUP BY 1),
        cs AS (SELECT doc_id AS case_id, source AS expected, embedding::DOUBLE[] AS q, terms[1:3] AS asked FROM xt JOIN embeddings ON vec_id = doc_id WHERE doc_id % 20 = 0),
        cw AS (SELECT case_id, len(asked) AS need, unnest(asked) AS term FROM cs)"""


ORACLE = {
    "eval_case_hits": f"WITH {_EVAL}, {_eval_sql('a', False)} SELECT * FROM a_hit",
    "eval_hit_at_k": f"WITH {_EVAL}, {_eval_sql('a', False)} SELECT * FROM a",
    "eval_delta": f"""
        WITH {_EVAL}, {_eval_sql('a', False)}, {_eval_sql('se', True)} SELECT mode, a.hits AS raw_hits, se.hits AS semantic_hits, se.hits - a.hits AS delta_hits,
            round(se.rate - a.rate, 6) AS delta_rate FROM a JOIN se USING (mode)""",
    "eval_gate": f"""
        WITH {_EVAL}, {_eval_sql('a', False)}, g AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{g}', {float(x)}::DOUBLE)" for m, gates in GATES.items() for g, x in gates.items())})
            v(mode, gate, wanted)),
        x AS (SELECT mode, gate, wanted, CASE WHEN gate = 'min_hit_rate' THEN rate ELSE hits::DOUBLE END AS got FROM a JOIN g USING (mode))
        SELECT * FROM x WHERE got < wanted""",
    "bm25_stats": rf"""
        WITH {_BM25}, x AS (SELECT doc_id, unnest(terms) AS term FROM d)
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM x GROUP BY 1""",
    "search_keyword": f"WITH {_BM25} {_TOP.format('kw', 10)}",
    "keyword_normalized": f"""
        WITH {_BM25}, t AS ({_TOP.format("kw", 10)}), r AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM t)
        SELECT query_id, "rank", doc_id, round(CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END, 4) AS score FROM r""",
    "search_trigram": f"""
        WITH {_BM25}, q AS (SELECT * FROM (VALUES {", ".join(f"({q}, '{t}')" for q, t in ASKED.items())}) v(query_id, needle)
                            WHERE length(needle) >= 3 AND query_id NOT IN (SELECT query_id FROM kw)),
        ts AS (SELECT count(*)::DOUBLE AS n, avg(greatest(length(folded) - 2, 0)) AS avgdl FROM d),
        m AS (SELECT query_id, doc_id, greatest(length(folded) - 2, 0) AS dl, ((length(folded) - length(replace(folded, needle, ''))) / length(needle))::DOUBLE AS f,
                     count(*) OVER (PARTITION BY query_id) AS df FROM d, q WHERE contains(folded, needle)),
        tg AS (SELECT query_id, doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM m, ts)
        {_TOP.format("tg", 10)}""",
    "search_phrases": rf"""
        WITH {_BM25}, b AS (SELECT item_id AS query_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS t FROM benchmark),
        q AS (SELECT * FROM b WHERE len(t) >= 4),
        x AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM d),
        p AS (SELECT query_id, a.doc_id, a.dl, count(*)::DOUBLE AS f, 0 AS part
              FROM q JOIN x AS a ON a.term = t[1] JOIN x AS b ON b.doc_id = a.doc_id AND b.i = a.i + 1 AND b.term = t[2]
              JOIN x AS c ON c.doc_id = a.doc_id AND c.i = a.i + 2 AND c.term = t[3] GROUP BY 1, 2, 3
              UNION ALL SELECT query_id, doc_id, dl, count(*)::DOUBLE, 1 FROM q JOIN x ON term = t[4] GROUP BY 1, 2, 3),
        pd AS (SELECT *, count(*) OVER (PARTITION BY query_id, part) AS df FROM p),
        ps AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
               FROM pd, st GROUP BY 1, 2 HAVING count(*) = 2)
        {_TOP.format("ps", 10)}""",
    "search_hybrid": _hybrid_sql(_PASSING, f"doc_id IN (SELECT vec_id FROM embeddings WHERE {_PASSING})"),
    "search_hybrid_unfiltered_kw": _hybrid_sql(_PASSING, "TRUE"),
    "search_hybrid_all": _hybrid_sql("TRUE", "TRUE"),
    "explain_vector": f"""
        WITH {_BM25}, t AS ({_TOP.format("kw", 10)}) SELECT query_id, "rank", doc_id, substr(text, 1, 200) AS preview FROM t JOIN documents USING (doc_id)""",
    "explain_hybrid": f"""
        WITH {_hybrid_parts("TRUE", "TRUE")}, t AS ({_TOP.format("f", 10)}), q AS (SELECT * FROM (VALUES {", ".join(f"({q}, '{t}')" for q, t in ASKED.items())}) v(query_id, terms))
        SELECT t.query_id, t.doc_id, t."rank", t.score AS rrf_score, vt.score AS vector_score, vt."rank" AS vector_rank, kt.score AS keyword_score, kt."rank" AS keyword_rank,
               substr(text, 1, 200) AS preview, terms AS matched_terms
        FROM t JOIN q ON q.query_id = t.query_id LEFT JOIN vt ON vt.query_id = t.query_id AND vt.doc_id = t.doc_id
            LEFT JOIN kt ON kt.query_id = t.query_id AND kt.doc_id = t.doc_id LEFT JOIN documents ON documents.doc_id = t.doc_id""",
    "audit_log": f"""
        WITH {_judge(False)} SELECT bundle_id, to_collection AS collection_id, 'publish' AS action, replaced_id, 'editor' AS actor, 100 AS "at" FROM j WHERE refused IS NULL
        UNION ALL SELECT bundle_id, collection_id, 'unpublish', NULL, 'steward', 300 FROM p WHERE collection_id IS NOT NULL AND bundle_id % 6 = 0""",
    "search_requests": """
        SELECT doc_id, CASE WHEN source = 'src3' OR coalesce(source, '') = '' THEN 'no collection' WHEN coalesce(n_chars % 9, 0) = 0 THEN 'top_k is not positive'
            WHEN n_chars % 4 = 3 THEN 'unknown mode' WHEN n_chars % 4 <> 1 AND coalesce(len(embedding), 0) = 0 THEN 'no vector'
            WHEN n_chars % 4 <> 0 AND (n_chars % 3 = 0 OR NOT regexp_matches(coalesce(text, ''), '\\S')) THEN 'no text' ELSE 'accepted' END AS outcome
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "list_bundles": f"WITH {_B} SELECT bundle_id, doc_id, status, collection_id, published_at::BIGINT AS published_at FROM b",
    "published_bundle_for_doc": f"WITH {_B} SELECT doc_id, collection_id, bundle_id FROM live",
    "published_unit_lookups": r"""
        WITH d AS (SELECT doc_id, source, string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))[1] AS s
                   FROM documents WHERE doc_id // 10 % 3 = 0)
        SELECT 'semantic:' || doc_id AS chunk_id, 'c' || (doc_id // 10 % 2) AS collection_id, CASE WHEN length(s) <= 96 THEN s ELSE rtrim(substr(s, 1, 93)) || '...' END AS title,
               source AS source_uri, 'chunk-' || doc_id AS dedupe_key FROM d""",
    "publication_log": f"WITH {_judge(False)} SELECT bundle_id, to_collection, replaced_id, coalesce(refused, 'published') AS outcome FROM j",
    "semantic_publish": f"WITH {_judge(False)} SELECT bundle_id, doc_id, status, collection_id, published_at::BIGINT AS published_at FROM p",
    "semantic_rollback": f"WITH {_judge(True)} SELECT bundle_id, doc_id, status, collection_id, published_at::BIGINT AS published_at FROM p",
    "semantic_unpublish": f"""
        WITH {_B} SELECT bundle_id, doc_id, status, CASE WHEN bundle_id % 6 <> 0 THEN collection_id END AS collection_id,
            CASE WHEN bundle_id % 6 <> 0 THEN published_at END::BIGINT AS published_at FROM b""",
    "bundle_upsert": f"""
        WITH {_B}, u AS (SELECT *, CASE WHEN bundle_id % 6 = 0 THEN 'rejected' WHEN bundle_id % 6 = 2 THEN 'approved' ELSE status END AS st FROM b)
        SELECT bundle_id, doc_id, st AS status, CASE WHEN st = 'approved' THEN collection_id END AS collection_id,
            CASE WHEN st = 'approved' AND collection_id IS NOT NULL THEN published_at END::BIGINT AS published_at FROM u""",
}
