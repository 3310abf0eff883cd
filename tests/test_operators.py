import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import chunking, collections, distill, evaluate, ingest, keyword, postings, publication, search, snapshots
from tidemark.sources import extract
from tidemark.streaming.cycle import live_records, read_registry, run_cycle, start


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<double>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    v = {"a": [3.0, 4.0], "b": [0.0, 1.0]}
    assert one(spark, V.dot(a, b), **v) == 4
    assert one(spark, V.l2_distance(a, b), **v) == pytest.approx(18**0.5)
    assert one(spark, V.normalize(a), **v) == [0.6, 0.8]
    assert one(spark, V.normalize(a), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.cosine_distance(V.normalize(a), V.normalize(a)), **v) == pytest.approx(0)


def test_normalize_text(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="  a\r\nb\rc\td   e\n\n\n\nf é \n") == "a\nb\nc d e\n\nf é"


def test_redact(spark):
    out = one(spark, T.redact(F.col("t")), t='Bearer abc.d token: "xyz" {"api_key":"k1"} password=p,q')
    assert out == 'Bearer ***REDACTED*** token: "***REDACTED***" {"api_key":"***REDACTED***"} password=***REDACTED***,q'


def test_bm25_corpus(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog"), (2, "Machine learning and artificial intelligence"), (3, "The brown fóx was very quick today"), (4, "Deep learning neural networks")]
    index = postings.build(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    asked = spark.createDataFrame([(1, "quick fox"), (2, "lazy"), (3, "brown-fox"), (4, '"'), (5, "fox zebra"), (6, None)], "query_id long, query string")
    got = postings.keyword_scores(index, asked).collect()
    scores = {(r.query_id, r.id): r.score for r in got}
    assert set(scores) == {(1, 1), (1, 3), (2, 1), (3, 1), (3, 3)}
    assert scores[1, 3] == pytest.approx(1.906412e-06, abs=1e-11)
    assert scores[1, 1] == pytest.approx(1.694915e-06, abs=1e-11)
    assert scores[2, 1] == pytest.approx(0.718049, abs=1e-6)


def test_min_max(spark):
    df = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 7.0)], "query_id long, id long, score double")
    assert {(r.query_id, r.id): r.score for r in keyword.min_max(df).collect()} == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): 0.5, (2, 1): 1.0}


def test_rank_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "query_id long, id string, rank int")
    got = {r.id: r.score for r in search.rrf((ranked("abc"), 1.0), (ranked("bda"), 1.0)).collect()}
    assert got == pytest.approx({"a": 1 / 61 + 1 / 63, "b": 1 / 62 + 1 / 61, "c": 1 / 63, "d": 1 / 62})
    tie = search.top_k(search.rrf((ranked("ab"), 1.0), (ranked("ba"), 1.0)), 2, 9).orderBy("rank").collect()
    assert [r.id for r in tie] == ["a", "b"]


def test_layers():
    assert [search.requested_layer(True, True, "raw"), search.requested_layer(False, True, "raw"), search.requested_layer(layer="raw"), search.requested_layer()] == ["fused", "semantic", "raw", "auto"]


def test_snapshots(spark):
    records = spark.createDataFrame([("c", "s1", "a"), ("c", "s1", "b"), ("c", "s2", "c")], "collection_id string, segment_id string, chunk_id string")
    manifests = spark.createDataFrame([("c", 0, ["s1"]), ("c", 1, ["s1", "s2"])], "collection_id string, version int, segment_ids array<string>")
    tombstones = spark.createDataFrame([("c", "b", 1, None)], "collection_id string, chunk_id string, born int, gone int")
    ids = lambda m, dead=tombstones: {r.chunk_id for r in snapshots.snapshot(records, m, dead).collect()}
    assert ids(snapshots.latest(manifests)) == {"a", "c"}
    assert ids(snapshots.at_version(manifests, 0)) == {"a", "b"}
    segments = spark.createDataFrame([("c", "s1", "ready"), ("c", "s2", "building"), ("d", "s3", "ready")], "collection_id string, segment_id string, status string")
    pending = spark.createDataFrame([("c", "a"), ("c", "b")], "collection_id string, chunk_id string")
    new, added = snapshots.publish(manifests, segments, tombstones, pending)
    assert {tuple(r) for r in new.select("collection_id", "version", F.array_join("segment_ids", ",")).collect()} == {("c", 2, "s1"), ("d", 0, "s3")}
    assert {tuple(r) for r in added.collect()} == {("c", "a", 2, None)}
    assert ids(new, tombstones.unionByName(added)) == set()
    back, dead = snapshots.rollback(manifests, tombstones, 0)
    assert (back.first().version, back.first().segment_ids) == (2, ["s1"])
    assert ids(back, dead) == {"a", "b"}
    assert ids(snapshots.latest(manifests), dead) == {"a", "c"}  # the older version stays as it was
    every = manifests.unionByName(back)
    forth, dead = snapshots.rollback(every, dead, 1)  # and forward again
    assert ids(forth, dead) == {"a", "c"}
    assert ids(back, dead) == {"a", "b"}
    kept = snapshots.compaction(records, snapshots.latest(manifests), tombstones, pending).first()
    assert (kept.kept, kept.removed) == (1, 2)
    assert [tuple(r) for r in snapshots.compact(records, snapshots.latest(manifests), tombstones, pending).select("chunk_id", "segment_id").collect()] == [("c", "c-compact-2")]


LONG = "A first sentence. " * 30


def test_fixed_chunks():
    assert chunking.fixed("", 10, 2) == []
    assert chunking.fixed("short", 10, 2) == [("short", "text", 0)]
    cut = chunking.fixed(LONG, 100, 10)
    assert all(len(t) <= 100 for t, _, _ in cut)
    assert all(LONG[o : o + len(t)] == t for t, _, o in cut)
    assert all(t.endswith("sentence. ") for t, _, _ in cut)
    assert chunking.fixed("x" * 25, 10, 3)[1] == ("x" * 10, "text", 7)
    assert chunking.fixed("aaaaa\n\nb ccccc", 10, 0)[0][0] == "aaaaa\n\n"


def test_markdown_chunks():
    text = "intro\n# One\n\nbody one\n## Two\nbody two"
    assert chunking.markdown(text, 100, 0) == [("intro", "paragraph", 0), ("# One\n\nbody one", "heading", 6), ("## Two\n\nbody two", "heading", 22)]
    assert [lab for _, lab, _ in chunking.markdown("# H\n\n" + "p\n\n" * 50, 60, 0)][:2] == ["heading", "paragraph"]


def test_structured_chunks():
    text = "para\n\n- a\n- b\n|x|y|\n```py\ncode\n```\nend"
    assert chunking.structured(text, 100, 0) == [
        ("para\n", "paragraph", 0), ("- a\n- b", "list", 6), ("|x|y|", "table", 14), ("```py\ncode\n```", "code", 20), ("end", "paragraph", 35),
    ]


def test_log_and_table_chunks():
    log = "2024-01-01 10:00:00 a\n  trace\n2024-01-01 10:00:01 b"
    assert [t for t, _, _ in chunking.log(log, 35, 0)] == ["2024-01-01 10:00:00 a\n  trace", "2024-01-01 10:00:01 b"]
    assert chunking.log(" ", 10, 0) == []
    made = chunking.table("Columns: a\na: 1\n\na: 2\na: 3", 29, 0)
    assert [t for t, _, _ in made] == ["Columns: a\n---\na: 1\na: 2", "Columns: a\n---\na: 3"]
    assert [o for _, _, o in made] == [11, 21]
    assert chunking.table("Columns: a\n", 30, 0) == []


def test_chunks_of_a_table(spark):
    df = spark.createDataFrame([(1, LONG), (2, None), (3, "")], "id int, text string")
    rows = chunking.chunk(df, "text", "fixed", 100, 10).collect()
    assert {r.id for r in rows} == {1}
    assert [r.chunk_no for r in rows] == list(range(len(rows)))


def test_chunks_of_more_texts_than_a_piece(monkeypatch):
    """A batch is chunked a piece at a time, its chunks the same and in order."""
    taken, plain = [], chunking.CHUNKERS["fixed"]
    monkeypatch.setitem(chunking.CHUNKERS, "fixed", lambda *a: taken.append(a[0]) or plain(*a))
    texts = [None if i % 7 == 0 else f"text {i}. " * (i % 40) for i in range(2 * chunking.PIECE + 5)]
    got = chunking.chunks_of("fixed", 80, 12).func(pa.array(texts, pa.string()))
    assert got.to_pylist() == [[{"text": t, "label": lab, "offset": o} for t, lab, o in plain(x, 80, 12)] if x else [] for x in texts]
    assert taken == [x for x in texts if x] and len(chunking.chunks_of("fixed").func(pa.array([], pa.string()))) == 0


def test_html(spark):
    page = "<html><body><script>x</script><h1>T</h1><p>a &amp; <b>b</b><br/>c</p><ul><li>x</li><li><i>y</i></li></ul><ol><li>z</li></ol><table><tr><th>h</th><th>k</th></tr><tr><td>1</td></tr></table><a href='u'>l</a></body></html>"
    got = one(spark, extract.extract_html(F.col("t")), t=page)
    assert got == "# T\n\na & **b**\nc\n\n- x\n- y\n\n1. z\n\n| h | k |\n| --- | --- |\n| 1 |  |\n[l](u)"


def test_flat_json():
    value = {"a": {"b": [1, {"c": None}], "d": []}, "e": {}, "f": True, "g": 1.5}
    assert extract.flat_lines(value) == ["a.b[0]: 1", "a.b[1].c: null", "a.d: []", "e: {}", "f: true", "g: 1.5"]
    assert extract.flat_lines(None) == [] and extract.flat_lines([]) == [": []"]


def test_delimited():
    assert extract.delimited_text('a,b\n1,"x, y"\n2\n', ",", False) == "a: 1, b: x, y\na: 2, b: "
    assert extract.delimited_text("a\tb\n1\t2\n", "\t", True) == "Columns: a, b\na: 1, b: 2"
    assert extract.delimited_text("a,b\n", ",", False) == "a, b"
    assert extract.json_lines_text('{"a": 1, "b": null}\n{"b": "x", "c": 2}') == "Columns: a, b\na: 1, b: \na: , b: x"


def test_changes(spark):
    scan = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, fingerprint string")
    known = spark.createDataFrame([("b", "2"), ("c", "0"), ("d", "4")], "path string, fingerprint string")
    assert {r.path: r.change_type for r in ingest.change_set(scan, known).collect()} == {"a": "added", "b": "unchanged", "c": "modified", "d": "deleted"}


def test_sentences_keep_their_digits(spark):
    """A sentence may begin or end with the digits of its own number."""
    flat = "0 of 10. 16.1.2.31 is 1. In 2022 2 of 22. 33 is 3"
    assert one(spark, T.sentences(F.col("t")), t=flat) == ["0 of 10.", "16.1.2.31 is 1.", "In 2022 2 of 22.", "33 is 3"]
    assert one(spark, distill.title(F.col("t"), F.lit("text")), t="0\n1") == "0 1"
    assert one(spark, distill.title(F.col("t"), F.lit("text")), t="0 of 10") == "0 of 10"


def test_distillation(spark):
    text = "# Setup Guide\nThe service must validate each input before it is stored in the table. Short one. It requires: a key and a token for every single request made."
    t = F.col("t")
    assert one(spark, distill.title(t, F.lit("text")), t=text) == "Setup Guide"
    assert one(spark, distill.question(F.lit("Overview"), F.lit("k")), t="x") == "What does overview cover?"
    assert one(spark, distill.question(F.lit("How it works."), F.lit("k")), t="x") == "How it works?"
    assert one(spark, distill.summary(t, T.sentences(t)), t=text).startswith("# Setup Guide The service must")
    assert one(spark, distill.entities(t), t="NASA met Alan Turing and Alan Turing in U") == ["NASA", "Alan Turing"]
    words = spark.createDataFrame([(1, "beta alpha beta the and gamma")], "id int, text string").select(distill.keywords(F.col("text")).alias("k")).first().k
    assert words == ["beta", "alpha", "gamma"]


def test_publication(spark):
    kind = "bundle_id long, doc_id long, status string, collection_id string, published_at long"
    bundles = spark.createDataFrame([(1, 1, "approved", "c", 5), (2, 1, "approved", None, None), (3, 2, "pending", None, None)], kind)
    ask = lambda rows: spark.createDataFrame(rows, "bundle_id long, to_collection string, replace boolean")
    refused = {r.bundle_id: r.refused for r in publication.judge(bundles, ask([(2, "c", False), (3, "c", True)])).collect()}
    assert refused == {2: "another bundle is live", 3: "not approved"}
    judged = publication.judge(bundles, ask([(2, "c", True)]))
    assert {r.bundle_id: r.collection_id for r in publication.publish(bundles, judged, F.lit(9)).collect()} == {1: None, 2: "c", 3: None}
    back = {r.bundle_id: r.refused for r in publication.judge(bundles, ask([(1, "c", True), (3, "c", True)]), "rollback").collect()}
    assert back == {1: "already live", 3: "not approved"}


def test_cycles(spark, tmp_path):
    root, registry = tmp_path / "in", str(tmp_path / "registry")
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("text")
    (root / "sub" / "b.json").write_text(json.dumps({"k": 1}))
    (root / "bad.json").write_text("{")
    (root / "skip.bin").write_text("x")
    with zipfile.ZipFile(root / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="urn:w"><w:t>Hello</w:t></w:d>')
    kinds = lambda df: sorted((r.path.rsplit("/", 1)[1], r.change_type) for r in df.collect())
    assert kinds(run_cycle(spark, str(root), registry, 0)) == [("a.txt", "added"), ("b.json", "added"), ("bad.json", "added"), ("d.docx", "added")]
    assert {r.path.rsplit("/", 1)[1]: r.status for r in read_registry(spark, registry).collect()}["bad.json"] == "error"
    (root / "a.txt").write_text("other")
    (root / "sub" / "b.json").unlink()
    assert kinds(run_cycle(spark, str(root), registry, 1)) == [("a.txt", "modified"), ("b.json", "deleted"), ("bad.json", "unchanged"), ("d.docx", "unchanged")]
    assert kinds(run_cycle(spark, str(root), registry, 1))[0] == ("a.txt", "modified")  # the same batch again
    alive = lambda: sorted((r.path.rsplit("/", 1)[1], r.chunk_text) for r in live_records(spark, registry).collect())
    assert alive() == [("a.txt", "other"), ("d.docx", "Hello")]
    dead = spark.read.parquet(f"{registry}/tombstones/batch=1").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in dead) == [("a.txt", "file_updated"), ("b.json", "file_deleted")]

    def decided(batch):
        """The running counts, which must be those of all that is alive; returns the tombstones and the reason."""
        told = spark.read.parquet(f"{registry}/decisions/batch={batch}").first()
        live = live_records(spark, registry).collect()
        assert (told.batch, told.records, told.bytes) == (batch, len(live), sum(len(r.chunk_text.encode()) + 8 * len(r.vector) for r in live))
        return told.tombstones, told.reason

    assert decided(1) == (2, "none")
    (root / "a.txt").write_text("text")  # as it first was: the same chunk id is alive again
    run_cycle(spark, str(root), registry, 2, budget_bytes=100)
    run_cycle(spark, str(root), registry, 2, budget_bytes=100)  # again, after it has compacted
    assert decided(2) == (3, "budget")
    assert spark.read.parquet(f"{registry}/decisions/batch=2").first().reason == "budget"
    assert spark.read.parquet(f"{registry}/staged/batch=2").count() == 1  # the others were not read
    assert alive() == [("a.txt", "text"), ("d.docx", "Hello")]
    (root / "d.docx").unlink()
    run_cycle(spark, str(root), registry, 3)
    assert alive() == [("a.txt", "text")] and decided(3) == (1, "none")  # tombstones since the compaction
    run_cycle(spark, str(root), registry, 4)
    assert decided(4) == (1, "none")


def test_sql_dumps():
    dump = """-- a dump
CREATE TABLE public."users" (id integer NOT NULL, "full name" text DEFAULT 'a, b', PRIMARY KEY (id), CONSTRAINT c CHECK (id > 0));
COPY public.users (id, "full name") FROM stdin;
1\tAda L
2\t\\N
\\.
/* more */ INSERT INTO `tags` (`k`, `v`) VALUES (1, 'it''s; (x)'), (2, NULL), (-3, 'a\\'b');
INSERT INTO tags (v, k) VALUES ('z', 9);
"""
    users = "Table: users\nColumns: id, full name\n---\nid: 1, full name: Ada L\nid: 2, full name: "
    tags = "Table: tags\nColumns: k, v\n---\nk: 1, v: it's; (x)\nk: 2, v: \nk: -3, v: a'b\nk: 9, v: z"
    assert extract.sql_dump_text(dump) == f"{users}\n\n{tags}"
    assert extract.sql_dump_text("SELECT 1;") == "SELECT 1;"


def test_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("# T")
    seen = []
    query = start(spark, str(root), str(tmp_path / "registry"), str(tmp_path / "checkpoint"), None, lambda changes, batch: seen.append((batch, changes.count())))
    assert query.awaitTermination(120)
    assert seen == [(0, 1)]


_REQUEST = "seq long, collection_id string, action string, dimension int, metric string, model string, schema_version string, quantization string, m int, ef_construction int, ef_search int"


def test_collections(spark):
    good = (4, "cosine", "mock", "1", "fp16", 16, 200, 100)
    changed = lambda i, x: (*good[:i], x, *good[i + 1 :])
    none = (None,) * 8
    asked = [(1, "a", "create", *good), (2, "a", "create", *good), (3, "a", "create", *changed(0, 0)), (4, "a", "delete", *none), (5, "a", "delete", *none), (6, "a", "create", *changed(1, "l2")),
             (7, " ", "create", *good), (8, "b", "create", *changed(1, None)), (9, "b", "create", *changed(2, " ")), (10, "b", "create", *changed(3, None)), (11, "b", "create", *changed(4, "int8")),
             (12, "b", "create", *changed(5, 3)), (13, "b", "create", *changed(6, 801)), (14, "b", "create", *changed(7, None)), (15, "b", "rename", *good), (16, "k", "create", *good), (17, None, None, *none)]
    judged = collections.judge(spark.createDataFrame(asked, _REQUEST), spark.createDataFrame([("k",)], "collection_id string"))
    assert [r.outcome for r in judged.orderBy("seq").collect()] == [
        "created", "already exists", "dimension is not positive", "deleted", "not found", "created", "no collection", "unknown metric", "no model", "no schema version",
        "unknown quantization", "m is not from 4 to 64", "ef_construction is not from 50 to 800", "ef_search is not from 10 to 500", "unknown action", "already exists", "unknown action",
    ]
    assert [(r.collection_id, r.seq, r.metric) for r in collections.live(judged).collect()] == [("a", 6, "l2")]
    assert collections.live(collections.judge(spark.createDataFrame([], _REQUEST))).count() == 0


def test_evaluation_of_searches(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red pear"), (3, "green apple"), (4, None)], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None)], "id long, v array<double>")
    cases = spark.createDataFrame([(1, "red", [1.0, 0.0]), (3, "apple", [0.0, 1.0]), (4, "", None), (9, "none such", [1.0])], "case_id long, query string, q array<double>")
    index = postings.build(docs, "id", "text")
    found = {}
    for r in evaluate.search_cases(cases, vectors, index, 2).orderBy("rank").collect():
        found.setdefault((r.case_id, r.mode), []).append(r.id)
    # No case finds its own row; an empty query, a vector that can't be scored or of another length finds nothing.
    assert found == {(1, "vector"): [2, 3], (1, "keyword"): [2], (1, "hybrid"): [2, 3], (3, "vector"): [2, 1], (3, "keyword"): [1], (3, "hybrid"): [1, 2]}
    only = spark.createDataFrame([(3,), (3,)], "id long")
    layer = evaluate.search_cases(cases, vectors, index, 2, passing=only).where("mode = 'hybrid'").collect()
    assert [(r.case_id, r.id) for r in layer] == [(1, 3)]


def test_hits_of_cases_without_an_expected_source(spark):
    cases = spark.createDataFrame([(1, "m", None), (2, "m", None), (3, "m", "x"), (4, "m", "x")], "case_id long, mode string, expected string")
    results = spark.createDataFrame([(1, "m", 1, "y"), (2, "m", 1, None), (3, "m", 3, "x"), (4, "m", 2, "x"), (4, "m", 2, "x")], "case_id long, mode string, rank int, source string")
    assert {r.case_id: r.hit for r in evaluate.hits(cases, results, 2).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_explained_results(spark):
    kind = "query_id long, id long, rank int, score double"
    near = spark.createDataFrame([(1, 7, 1, 0.9), (1, 8, 2, 0.5)], kind)
    words = spark.createDataFrame([(1, 8, 1, 3.5)], kind)
    fused = spark.createDataFrame([(1, 8, 1, 0.03), (1, 7, 2, 0.01), (2, 9, 1, 0.01)], kind)
    queries = spark.createDataFrame([(1, "  two\twords "), (2, None)], "query_id long, query string")
    texts = spark.createDataFrame([(7, "x" * 300), (8, None), (8, "b"), (8, "a")], "id long, text string")
    got = {(r.query_id, r.id): r for r in search.explain(fused, near, words, queries, texts).collect()}
    assert len(got) == 3
    r = got[1, 8]
    assert (r.rank, r.rrf_score, r.vector_score, r.vector_rank, r.keyword_score, r.keyword_rank, r.preview, r.matched_terms) == (1, 0.03, 0.5, 2, 3.5, 1, "a", "two words")
    assert (got[1, 7].keyword_score, got[1, 7].keyword_rank, got[1, 7].preview) == (None, None, "x" * 200)
    assert (got[2, 9].vector_score, got[2, 9].preview, got[2, 9].matched_terms) == (None, None, "")


def test_audit_log(spark):
    kind = "bundle_id long, doc_id long, status string, collection_id string, published_at long"
    bundles = spark.createDataFrame([(1, 1, "approved", "c", 5), (2, 1, "approved", None, None), (3, 2, "rejected", None, None)], kind)
    judged = publication.judge(bundles, spark.createDataFrame([(2, "c", True), (3, "c", True)], "bundle_id long, to_collection string, replace boolean"))
    after = publication.publish(bundles, judged, F.lit(9))
    gone = publication.unpublished_entries(after, bundles.unionByName(bundles), "b", F.lit(10))
    entries = publication.published_entries(judged, "a", F.lit(9)).unionByName(gone)
    assert [tuple(r) for r in publication.audit_log(entries).collect()] == [(2, "c", "publish", 1, "a", 9), (2, "c", "unpublish", None, "b", 10)]
    assert publication.audit_log(entries, bundle_id=1).count() == 0
    assert publication.audit_log(entries, bundle_id=2, collection_id="c").count() == 2
    assert publication.audit_log(entries, collection_id="d").count() == 0
