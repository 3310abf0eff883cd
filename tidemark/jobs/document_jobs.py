"""Queries over ``documents``: normalisation, ids, chunks, distillation and ingest quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.jobs import chunk_sql
from tidemark.operators import chunking, distill, ingest
from tidemark.session import read_table, spread_small


def _docs(spark, sf_dir):
    return spread_small(read_table(spark, sf_dir, "documents")).withColumn("text", F.coalesce("text", F.lit("")))



def _path():
    """A document's path: its source, its id, and an extension by the id."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("txt", "md", "csv", "PDF", "json", "bin")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), ext)


def normalize_text(spark, sf_dir):
    out = T.normalize_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.char_length(out).alias("n_chars"), F.sha2(out, 256).alias("text_sha256"))


def fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.octet_length("text").alias("size"))


def content_type_of(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.content_type(_path()).alias("content_type"))


def chunk_strategy(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", chunking.strategy(_path()).alias("strategy"))


def doc_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(_path(), 256).alias("path_id"))


def extract_text(spark, sf_dir):
    """The text of every document as its extractor passes it on, with the type of its file; without one, no text."""
    kind = T.content_type(_path())
    read = F.when(kind.isNotNull(), F.sha2("text", 256))
    return _docs(spark, sf_dir).select("doc_id", kind.alias("content_type"), read.alias("text_sha256"))


def pipeline_signature(spark, sf_dir):
    """The signature of each source's pipeline: its chunker is the one that most of its files take."""
    d = _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    return d.select("source", "files", ingest.pipeline_signature("1.0.0", "1.0.0", 2800, 420, "auto").alias("signature"))


def split_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def sentence_scores(spark, sf_dir):
    s = split_sentences(spark, sf_dir)
    return s.select("doc_id", "pos", F.round(distill.sentence_score(F.col("sentence"), F.col("pos")), 6).alias("score"))


def distill_title(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", distill.title(F.col("text"), F.lit("text")).alias("title"))


def distill_summary(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text", T.sentences(F.col("text")).alias("parts"))
    return d.select("doc_id", distill.summary(F.col("text"), F.col("parts")).alias("summary"))


def distill_answer(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text", T.sentences(F.col("text")).alias("parts"))
    return d.select("doc_id", distill.answer(F.col("text"), F.col("parts")).alias("answer"))


def _keywords(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("keywords", distill.keywords(F.col("text")))


def distill_keywords(spark, sf_dir):
    return _keywords(spark, sf_dir).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


def distill_question(spark, sf_dir):
    title = distill.title(F.col("text"), F.lit("text"))
    return _keywords(spark, sf_dir).select("doc_id", distill.question(title, F.get("keywords", F.lit(0))).alias("question"))


def distill_entities(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(distill.entities(F.col("text")), "|").alias("entities"))


def distill_themes(spark, sf_dir):
    k = _keywords(spark, sf_dir).withColumn("title", distill.title(F.col("text"), F.lit("text"))).withColumn("names", distill.entities(F.col("text")))
    return k.select("doc_id", F.array_join(distill.themes(F.col("title"), F.col("text"), F.col("keywords"), F.col("names")), "|").alias("themes"))


def noise_flags(spark, sf_dir):
    flat = T.squeeze(F.col("text"))
    return _docs(spark, sf_dir).select(
        "doc_id",
        distill.repeated_lines(F.col("text")).alias("repeated_lines"),
        distill.noisy(flat).alias("noisy"),
        distill.mostly_uppercase(flat).alias("uppercase"),
    )


def _quality(spark, sf_dir):
    """Quality by columns that are each computed once; ``flat`` is the text in single spaces, ``n`` the number of its sentences."""
    k = _docs(spark, sf_dir).select("doc_id", "source", "text", T.squeeze(F.col("text")).alias("flat"))
    k = k.withColumn("n", T.n_sentences_of_line(F.col("flat"))).withColumn("terms", distill.n_keywords(F.col("flat")))
    k = k.withColumn("mean", distill.mean_words(F.col("flat"), F.col("n")))
    q = distill.quality(F.col("text"), F.col("flat"), F.col("n"), F.col("mean"), F.lit("text"), F.col("terms"), distill.has_entities(F.col("text")))
    return k.select("doc_id", "source", "text", "flat", *[c.alias(n) for n, c in q.items()])


def quality_signals(spark, sf_dir):
    q = _quality(spark, sf_dir)
    return q.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("coverage", "density", "structure", "noise_penalty", "confidence")], "flags")


def dedup_key(spark, sf_dir):
    key = T.dedup_key(F.col("text"), distill.title(F.col("text"), F.lit("text")))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(key, 256).alias("dedup_key"))


def duplicate_groups(spark, sf_dir):
    """Groups of documents of one source with the same dedup key."""
    key = T.dedup_key(F.col("text"), distill.title(F.col("text"), F.lit("text")))
    d = _docs(spark, sf_dir).select("doc_id", "source", F.sha2(key, 256).alias("dedup_key"))
    return d.groupBy("source", "dedup_key").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("first_doc")).where("group_size > 1")


def bundle_diagnostics(spark, sf_dir):
    """Per source, taken as a bundle: units, mean quality, low-quality units, flagged units, duplicate groups."""
    q = _quality(spark, sf_dir).withColumn("one", T.first_sentence_of_line(F.col("flat"))).withColumn("line", distill.first_line(F.col("text")))
    q = q.withColumn("title", distill.title_of(F.col("line"), F.col("one"), F.lit("text")))
    key = F.sha2(T.dedup_key_of_line(F.col("flat"), F.col("title")), 256)
    # Units of one key are counted together, so that no unit has to meet the size of its group.
    u = q.select("source", "confidence", key.alias("k"))
    u = u.groupBy("source", "k").agg(
        F.count(F.lit(1)).alias("size"), F.sum("confidence").alias("total"), F.count_if(F.col("confidence") < 60).alias("low")
    )
    twice = F.col("size") > 1
    return u.groupBy("source").agg(
        F.sum("size").alias("units"),
        F.round(F.sum("total").cast("double") / F.sum("size") / 100, 3).alias("mean_quality"),
        F.sum("low").alias("low_quality"),
        F.sum(F.when(twice, F.col("size")).otherwise(F.col("low"))).alias("flagged"),
        F.count_if(twice).alias("duplicate_groups"),
    )


def approval_gate(spark, sf_dir):
    d = bundle_diagnostics(spark, sf_dir)
    low, twice = F.col("low_quality") > 0, F.col("duplicate_groups") > 0
    return d.select("source", F.when(low | twice, "rejected").otherwise("approved").alias("decision"), F.concat_ws(",", F.when(low, "low_quality"), F.when(twice, "duplicates")).alias("reasons"))


def redact(spark, sf_dir):
    out = T.redact(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(out, 256).alias("text_sha256"), (out != F.col("text")).alias("changed"))


def mock_embed(spark, sf_dir):
    v = ingest.mock_embedding(F.col("text"), 16)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(v).alias("pos", "x")).select("doc_id", "pos", F.round("x", 6).alias("x"))


# Chunks


def _chunks(spark, sf_dir, name, size=800, overlap=120):
    return chunking.chunk(_docs(spark, sf_dir).select("doc_id", "source", "text"), "text", name, size, overlap)


def _chunk_query(name):
    def run(spark, sf_dir):
        c = _chunks(spark, sf_dir, name)
        return c.select("doc_id", F.col("chunk_no").alias("pos"), "label", "offset", F.char_length("text").alias("length"), F.sha2("text", 256).alias("text_sha256"))

    run.__name__ = f"chunk_{name}"
    run.__doc__ = f"Chunks of every document by the {name} chunker."
    return run


def chunk_ids(spark, sf_dir):
    """Ids of the fixed chunks, from document id, version, offset and content."""
    c = _chunks(spark, sf_dir, "fixed")
    doc = F.sha2(F.col("doc_id").cast("string"), 256)
    return c.select("doc_id", "offset", T.chunk_id(doc, F.lit("1.0.0"), F.col("offset"), T.chunk_hash(F.col("text"))).alias("chunk_id"))


def build_records(spark, sf_dir):
    """Records of the fixed chunks."""
    c = _chunks(spark, sf_dir, "fixed").select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("doc_id"),
        F.lit("1.0.0").alias("doc_version"),
        F.col("source").alias("source_uri"),
        F.lit("txt").alias("content_type"),
        "text",
        "label",
        "offset",
    )
    r = ingest.build_records(c, ingest.pipeline_signature("1.0.0", "1.0.0", 800, 120, "fixed"), "mock-16")
    return r.select("chunk_id", "doc_id", "chunk_hash", "pipeline_signature", F.col("metadata.source_uri").alias("source_uri"), F.col("metadata.offset").alias("offset"))


def validate_records(spark, sf_dir):
    """Why each embedding would be refused as a record: every thirteenth has its id blanked, every seventeenth a component cut."""
    e = read_table(spark, sf_dir, "embeddings")
    key = F.when(F.col("vec_id") % 13 == 0, "").otherwise(F.col("vec_id").cast("string"))
    v = F.when(F.col("vec_id") % 17 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return e.select("vec_id", F.coalesce(ingest.record_errors(64, v, key), F.lit("")).alias("error"))


def _chunk_report(c):
    """Chunks, characters, duplicates and their ratio per source."""
    own = c.groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    return own.groupBy("source").agg(
        F.sum("n").alias("chunks"),
        F.sum("chars").alias("chars"),
        F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_chars"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("duplicate_ratio"),
    )


def ingest_quality(spark, sf_dir):
    """Quality of the fixed chunks per source."""
    return _chunk_report(_chunks(spark, sf_dir, "fixed"))


def duplicate_ratio(spark, sf_dir):
    """Fixed chunks, and those that repeat another's text, whatever their source."""
    c = _chunks(spark, sf_dir, "fixed").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum("n").alias("chunks"), F.sum(F.col("n") - 1).alias("duplicates"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("ratio"))


def label_distribution(spark, sf_dir):
    """Chunks of the structured chunker by label."""
    return _chunks(spark, sf_dir, "structured").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def chunk_count_by_source(spark, sf_dir):
    return _chunks(spark, sf_dir, "fixed").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def chunk_quality(spark, sf_dir):
    """Quality of the structured chunks per source."""
    return _chunk_report(_chunks(spark, sf_dir, "structured"))


def chunk_labels(spark, sf_dir):
    """Chunks of the structured chunker per source and label."""
    return _chunks(spark, sf_dir, "structured").groupBy("source", "label").agg(F.count(F.lit(1)).alias("chunks"))


def semantic_records(spark, sf_dir):
    """Ids of the semantic units and of their records, from title, summary and answer."""
    d = _docs(spark, sf_dir).withColumn("flat", T.squeeze(F.col("text"))).withColumn("parts", T.sentences_of_line(F.col("flat")))
    d = d.withColumn("best", distill.summary_sentences(F.col("parts")))
    title = distill.title_of(distill.first_line(F.col("text")), T.first_sentence_of_line(F.col("flat")), F.lit("text"))
    d = d.select(
        "doc_id", title.alias("title"), distill.summary_of(F.col("flat"), F.col("best")).alias("summary"), distill.answer_of(F.col("flat"), F.col("parts"), F.col("best")).alias("answer")
    )
    canonical = F.lower(T.squeeze(F.concat_ws("\n", "title", "summary", "answer")))
    unit = F.sha2(F.concat(F.col("doc_id"), F.lit(":0:"), canonical), 256)
    return d.select("doc_id", F.concat(F.lit("semantic:"), unit).alias("chunk_id"), F.sha2(F.concat_ws("\n\n", "title", "summary", "answer"), 256).alias("text_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, fingerprint, content_type_of, chunk_strategy, doc_ids, extract_text, pipeline_signature, split_sentences,
        sentence_scores, distill_title, distill_summary, distill_answer, distill_keywords, distill_question, distill_entities,
        distill_themes, noise_flags, quality_signals, dedup_key, duplicate_groups, bundle_diagnostics, approval_gate, redact, mock_embed,
        *map(_chunk_query, chunking.CHUNKERS), chunk_ids, build_records, validate_records,
        ingest_quality, duplicate_ratio, label_distribution, chunk_count_by_source, chunk_quality, chunk_labels, semantic_records,
    )
}

_D = "d AS (SELECT doc_id, source, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS flat FROM documents)"
_PATH = "source || '/' || doc_id || '.' || ['txt', 'md', 'csv', 'PDF', 'json', 'bin'][doc_id % 6 + 1]"
_S = rf"""{_D},
    s0 AS (SELECT doc_id, unnest(string_split(regexp_replace(flat, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS sentence,
                  generate_subscripts(string_split(regexp_replace(flat, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS pos FROM d),
    s AS (SELECT doc_id, pos::INTEGER AS pos, trim(sentence) AS sentence, len(string_split(trim(sentence), ' ')) AS words FROM s0 WHERE trim(sentence) <> '')"""
_SCORE = r"""
    round(CASE WHEN words BETWEEN 8 AND 28 THEN 3.0::DOUBLE WHEN words >= 5 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN regexp_matches(sentence, '[A-Z][a-z]') THEN 0.8::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(sentence, '(?i)\b(must|should|provides|supports|requires|ensures|enables|preserves)\b') THEN 1.5::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(sentence, '(?i)\b(is|are|means|includes)\b') THEN 0.8::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(sentence, '[:;]') THEN 0.3::DOUBLE ELSE 0 END - pos * 0.1::DOUBLE, {0})"""


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n - 3})) || '...' END"


_TITLE = f"""{_S},
    t AS (SELECT d.doc_id, d.text, d.flat,
            coalesce(list_filter(list_transform(string_split(d.text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1], '') AS line,
            (SELECT sentence FROM s WHERE s.doc_id = d.doc_id ORDER BY pos LIMIT 1) AS one FROM d),
    title AS (SELECT doc_id, text, flat, CASE WHEN line LIKE '#%' THEN trim(regexp_replace(line, '^#+\\s*', ''))
              ELSE {_cut("coalesce(one, line)", 96)} END AS title FROM t)"""
_SUMMARY = f"""{_TITLE},
    b AS (SELECT doc_id, pos, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY {_SCORE.format(9)} DESC, pos) AS place FROM s),
    su AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS joined FROM b WHERE place <= 2 GROUP BY 1),
    best AS (SELECT doc_id, list(sentence) AS own FROM b WHERE place <= 2 GROUP BY 1),
    more AS (SELECT b.doc_id, b.sentence, b.pos, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS n
             FROM b JOIN best USING (doc_id) WHERE NOT list_contains(own, sentence)),
    third AS (SELECT doc_id, sentence AS extra FROM more WHERE n = 1),
    cnt AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1),
    ans AS (SELECT su.doc_id, CASE WHEN len(own) < 2 AND cnt.n < 2 THEN joined ELSE joined || coalesce(' ' || extra, '') END AS joined
            FROM su JOIN best USING (doc_id) JOIN cnt USING (doc_id) LEFT JOIN third USING (doc_id)),
    distilled AS (SELECT title.doc_id, title.text, title, {_cut("coalesce(su.joined, flat)", 320)} AS summary, {_cut("coalesce(ans.joined, flat)", 480)} AS answer
                  FROM title LEFT JOIN su USING (doc_id) LEFT JOIN ans USING (doc_id))"""
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_KEYWORDS = f"""
    k0 AS (SELECT doc_id, regexp_extract_all(lower(flat), '[a-z0-9][a-z0-9_-]{{2,}}') AS terms FROM d),
    k1 AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM k0),
    k2 AS (SELECT doc_id, term, sum(CASE WHEN pos < 24 THEN 2 ELSE 1 END) AS w FROM k1 WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
    k3 AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS place FROM k2),
    kw AS (SELECT doc_id, list(term ORDER BY place) AS keywords FROM k3 WHERE place <= 6 GROUP BY 1)"""
_ENTITIES = r"""
    e0 AS (SELECT doc_id, regexp_extract_all(text, '\b(?:[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*|[A-Z]{2,}(?:-[A-Z0-9]+)*)\b') AS m FROM d),
    e1 AS (SELECT doc_id, unnest(m) AS e, generate_subscripts(m, 1) AS pos FROM e0),
    e2 AS (SELECT doc_id, e, min(pos) AS pos FROM e1 WHERE length(e) >= 2 GROUP BY 1, 2),
    e3 AS (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM e2),
    ent AS (SELECT doc_id, list(e ORDER BY place) AS entities FROM e3 WHERE place <= 6 GROUP BY 1)"""
_KEY = r"""
    key AS (SELECT title.doc_id, d.source, sha256(trim(regexp_replace(regexp_replace(lower(title), '^\d+[.)]\s+', ''), '\s+', ' ', 'g')) || chr(10)
            || trim(regexp_replace(regexp_replace(regexp_replace(lower(d.flat), '^#+\s*', ''), '\b\d+[.)]\s+', '', 'g'), '\s+', ' ', 'g'))) AS dedup_key
            FROM title JOIN d USING (doc_id))"""
_NOISE = r"""
    n0 AS (SELECT doc_id, flat, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines,
                  regexp_extract_all(flat, '[A-Za-z]{3,}') AS words FROM d),
    noise AS (SELECT doc_id, len(list_distinct(lines)) < len(lines) AS repeated_lines,
            (len(regexp_extract_all(flat, '[^\w\s]{3,}')) > 1 OR (length(flat) > 0 AND len(regexp_extract_all(flat, '[0-9]')) / length(flat) > 0.2)) AS noisy,
            (len(words) > 0 AND len(list_filter(words, lambda w: w = upper(w))) / greatest(len(words), 1) > 0.4) AS uppercase FROM n0)"""
_QUALITY = f"""{_SUMMARY}, {_KEYWORDS}, {_ENTITIES}, {_NOISE},
    st AS (SELECT doc_id, count(*) AS n, sum(words) / count(*) AS mean FROM s GROUP BY 1),
    q0 AS (SELECT d.doc_id, d.source, length(flat) AS len, coalesce(len(keywords), 0) AS nk, coalesce(len(entities), 0) AS ne,
                  coalesce(st.n, 0) AS n, coalesce(mean, 0) AS mean, repeated_lines, noisy, uppercase
           FROM d LEFT JOIN kw USING (doc_id) LEFT JOIN ent USING (doc_id) LEFT JOIN st USING (doc_id) JOIN noise USING (doc_id)),
    q1 AS (SELECT *, CASE WHEN len BETWEEN 120 AND 2200 THEN 82 WHEN len >= 60 THEN 68 ELSE 48 END AS coverage,
            42 + CASE WHEN nk >= 4 THEN 24 WHEN nk >= 2 THEN 14 ELSE 0 END + CASE WHEN ne > 0 THEN 10 ELSE 0 END
               + CASE WHEN n >= 2 THEN 10 WHEN n = 1 THEN 4 ELSE 0 END AS density,
            60 + CASE WHEN n >= 2 THEN 14 ELSE 0 END + CASE WHEN mean >= 24 THEN 8 ELSE 0 END AS structure,
            CASE WHEN repeated_lines THEN 12 ELSE 0 END + CASE WHEN noisy THEN 10 ELSE 0 END + CASE WHEN uppercase THEN 8 ELSE 0 END
               + CASE WHEN n > 0 AND mean < 24 THEN 5 ELSE 0 END AS noise_penalty FROM q0),
    quality AS (SELECT doc_id, source, coverage::BIGINT AS coverage, density::BIGINT AS density, structure::BIGINT AS structure, noise_penalty::BIGINT AS noise_penalty,
            greatest(0, least(100, floor((2800 + 25 * coverage + 24 * density + 23 * structure - 100 * noise_penalty + 50) / 100)))::BIGINT AS confidence,
            concat_ws(',', CASE WHEN repeated_lines THEN 'repeated_lines' END, CASE WHEN noisy THEN 'noisy_content' END,
                CASE WHEN uppercase THEN 'uppercase_heavy' END, CASE WHEN n > 0 AND mean < 24 THEN 'low_information_density' END) AS flags FROM q1)"""
_DIAGNOSTICS = f"""{_QUALITY}, {_KEY},
    u AS (SELECT quality.doc_id, quality.source, confidence, dedup_key, count(*) OVER (PARTITION BY quality.source, dedup_key) AS size FROM quality JOIN key USING (doc_id)),
    diag AS (SELECT source, count(*) AS units, round(sum(confidence)::DOUBLE / count(*) / 100, 3) AS mean_quality,
            count(*) FILTER (confidence < 60) AS low_quality, count(*) FILTER (confidence < 60 OR size > 1) AS flagged,
            count(DISTINCT dedup_key) FILTER (size > 1) AS duplicate_groups FROM u GROUP BY 1)"""
_L = """
    l0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM d),
    l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l0)"""

ORACLE = {
    "normalize_text": r"""
        WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')),
            '\r\n?', chr(10), 'g'), '\t', ' ', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x FROM documents)
        SELECT doc_id, length(x)::INTEGER AS n_chars, sha256(x) AS text_sha256 FROM t""",
    "fingerprint": "SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint, strlen(coalesce(text, ''))::INTEGER AS size FROM documents",
    "content_type_of": "SELECT doc_id, ['txt', 'md', 'csv', 'pdf', 'json', NULL][doc_id % 6 + 1] AS content_type FROM documents",
    "chunk_strategy": "SELECT doc_id, ['structured', 'markdown', 'fixed', 'structured', 'fixed', 'fixed'][doc_id % 6 + 1] AS strategy FROM documents",
    "doc_ids": f"SELECT doc_id, sha256({_PATH}) AS path_id FROM documents",
    "extract_text": """
        SELECT doc_id, kind AS content_type, CASE WHEN kind IS NOT NULL THEN sha256(coalesce(text, '')) END AS text_sha256
        FROM (SELECT doc_id, text, ['txt', 'md', 'csv', 'pdf', 'json', NULL][doc_id % 6 + 1] AS kind FROM documents)""",
    "pipeline_signature": """
        SELECT source, count(*) AS files, sha256('1.0.01.0.01.0.0|size=2800|overlap=420|strategy=auto') AS signature FROM documents GROUP BY 1""",
    "split_sentences": f"WITH {_S} SELECT doc_id, pos, sentence FROM s",
    "sentence_scores": f"WITH {_S} SELECT doc_id, pos, {_SCORE.format(6)} AS score FROM s",
    "distill_title": f"WITH {_TITLE} SELECT doc_id, title FROM title",
    "distill_summary": f"WITH {_SUMMARY} SELECT doc_id, summary FROM distilled",
    "distill_answer": f"WITH {_SUMMARY} SELECT doc_id, answer FROM distilled",
    "distill_keywords": f"WITH {_D}, {_KEYWORDS} SELECT doc_id, coalesce(array_to_string(keywords, ','), '') AS keywords FROM d LEFT JOIN kw USING (doc_id)",
    "distill_question": rf"""
        WITH {_TITLE}, {_KEYWORDS}, w AS (SELECT title.doc_id, title, coalesce(nullif(trim(title), ''), keywords[1], 'this section') AS subject
            FROM title LEFT JOIN kw USING (doc_id))
        SELECT doc_id, CASE WHEN title LIKE '%?' THEN title
            WHEN regexp_matches(trim(title), '(?i)^(what|why|how|when|where|who)\b') THEN regexp_replace(trim(title), '[.]+$', '') || '?'
            WHEN regexp_matches(subject, '(?i)^(overview|summary|introduction|background)$') THEN 'What does ' || lower(subject) || ' cover?'
            ELSE 'What is the key point about ' || regexp_replace(subject, '[.]+$', '') || '?' END AS question FROM w""",
    "distill_entities": f"WITH {_D}, {_ENTITIES} SELECT doc_id, coalesce(array_to_string(entities, '|'), '') AS entities FROM d LEFT JOIN ent USING (doc_id)",
    "noise_flags": f"WITH {_D}, {_NOISE} SELECT doc_id, repeated_lines, noisy, uppercase FROM noise",
    "quality_signals": f"WITH {_QUALITY} SELECT doc_id, coverage, density, structure, noise_penalty, confidence, flags FROM quality",
    "dedup_key": f"WITH {_TITLE}, {_KEY} SELECT doc_id, dedup_key FROM key",
    "duplicate_groups": f"""
        WITH {_TITLE}, {_KEY} SELECT source, dedup_key, count(*) AS group_size, min(doc_id) AS first_doc FROM key GROUP BY 1, 2 HAVING count(*) > 1""",
    "bundle_diagnostics": f"WITH {_DIAGNOSTICS} SELECT * FROM diag",
    "approval_gate": f"""
        WITH {_DIAGNOSTICS} SELECT source, CASE WHEN low_quality > 0 OR duplicate_groups > 0 THEN 'rejected' ELSE 'approved' END AS decision,
            concat_ws(',', CASE WHEN low_quality > 0 THEN 'low_quality' END, CASE WHEN duplicate_groups > 0 THEN 'duplicates' END) AS reasons FROM diag""",
    "redact": r"""
        WITH x AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
            '(Bearer\s+)[^\s"'']+', '\1***REDACTED***', 'gi'),
            '((?:token|api_key|secret|password|authorization)\s*[:=]\s*["'']?)[^\s"'',}]+', '\1***REDACTED***', 'gi'),
            '("(?:token|api_key|secret|password)"\s*:\s*")[^"]+', '\1***REDACTED***', 'gi') AS r FROM documents)
        SELECT doc_id, sha256(r) AS text_sha256, r <> text AS changed FROM x""",
    "mock_embed": """
        WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
        v AS (SELECT doc_id, [('0x' || substr(h, 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE * 2 - 1 FOR i IN range(16)] AS v FROM h)
        SELECT doc_id, (i - 1)::INTEGER AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x
        FROM (SELECT doc_id, v, unnest(generate_series(1, 16)) AS i FROM v)""",
    "validate_records": """
        SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'empty id' WHEN vec_id % 17 = 0 THEN 'wrong dimension' ELSE '' END AS error FROM embeddings""",
    "semantic_records": rf"""
        WITH {_SUMMARY} SELECT doc_id,
            'semantic:' || sha256(doc_id || ':0:' || lower(trim(regexp_replace(title || chr(10) || summary || chr(10) || answer, '\s+', ' ', 'g')))) AS chunk_id,
            sha256(title || chr(10) || chr(10) || summary || chr(10) || chr(10) || answer) AS text_sha256 FROM distilled""",
}

ORACLE |= chunk_sql.oracles(_D, _L, _TITLE, _KEYWORDS, _ENTITIES)
