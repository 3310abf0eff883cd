"""Queries over ``events``, ``orders``, ``conversations``, ``pages`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.filters import Field, compile_filter, compile_open_filter
from tidemark.functions.text import starts_entry
from tidemark.operators import collections, evaluate, ingest, memory, search, snapshots
from tidemark.session import read_table, spread_small
from tidemark.sources import extract
from tidemark.streaming.counters import counters


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))


#: k counts as missing where it is below 10, so that filters meet missing fields.
_K = "CASE WHEN k >= 10 THEN k END"


def _fields():
    return {"event_type": Field(F.col("event_type"), "string"), "value": Field(F.col("value"), "number"), "k": Field(F.expr(_K), "number")}


FILTERS = {
    "filter_eq": {"event_type": "click"},
    "filter_or_array": {"event_type": ["click", "view"]},
    "filter_null_noop": {"event_type": "error", "k": None},
    "filter_range": {"value": {"$gte": 10, "$lt": 50}, "event_type": {"$gt": "d", "$lte": "purchase"}},
    "filter_ne": {"k": {"$ne": 42}},
    "filter_in": {"k": {"$in": [11, 22, 33]}},
    "filter_nin": {"k": {"$nin": [11, 22, 33]}},
    "filter_unknown_op": {"event_type": {"$like": "c"}},
    "filter_cli": {"event_type": "signup", "value": {"$gt": 5}},
}


def _filter_query(name):
    def run(spark, sf_dir):
        return _events(spark, sf_dir).where(compile_filter(FILTERS[name], _fields())).select("event_id", "event_type", "value")

    run.__name__ = name
    run.__doc__ = f"Events that pass {FILTERS[name]}."
    return run


#: Filters over open metadata, each with its SQL over the columns that the metadata is made of.
OPEN_FILTERS = {
    "above": ({"k": {"$gte": 20, "$lt": 50}}, "k >= 20 AND k < 50"),
    "number_as_text": ({"k": {"$gt": "20"}}, "false"),
    "number_equals_text": ({"k": "30"}, "false"),
    "equal": ({"k": 30}, "k = 30"),
    "any_number": ({"k": [11, 22.0, "33"]}, "k IN (11, 22)"),
    "not_equal": ({"status": {"$ne": "click"}}, "k % 5 = 0 OR event_type <> 'click'"),
    "not_in": ({"status": {"$nin": ["click", "view"]}}, "k % 5 = 0 OR event_type NOT IN ('click', 'view')"),
    "in_missing": ({"other": {"$in": ["a"]}}, "false"),
    "not_in_missing": ({"other": {"$nin": ["a"]}}, "true"),
    "text_order": ({"status": {"$gt": "d", "$lte": "purchase"}}, "k % 5 <> 0 AND event_type > 'd' AND event_type <= 'purchase'"),
    "no_constraint": ({"status": None, "k": {"$lt": 50}}, "k < 50"),
    "unknown": ({"k": {"$like": 1, "$gt": 0}}, "false"),
    "boolean": ({"even": True}, "k % 2 = 0"),
    "boolean_is_no_number": ({"even": {"$ne": 1}}, "true"),
    "stored_null": ({"none": {"$ne": None}}, "false"),
    "null_is_present": ({"none": {"$ne": "x"}}, "true"),
    "in_null": ({"none": {"$in": [None]}}, "true"),
    "list_equals_nothing": ({"tags": ["a"]}, "false"),
    "either_kind": ({"mixed": [3, "t3"]}, "k % 7 = 3"),
    "quoted_name": ({"it's": {"$lte": 10.5}}, "k <= 10"),
}


def filter_open_metadata(spark, sf_dir):
    """Which filters each event passes, its metadata being JSON whose fields and kinds differ from row to row."""
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(', "status": "'), "event_type", F.lit('"')))
    mixed = F.when(k % 2 == 0, (k % 7).cast("string")).otherwise(F.concat(F.lit('"t'), k % 7, F.lit('"')))
    even = F.when(k % 2 == 0, "true").otherwise("false")
    fields = [F.lit('{"none": null, "tags": ["a"], "it\'s": '), k, F.lit(', "even": '), even, F.lit(', "mixed": '), mixed, F.lit(', "k": '), k, status, F.lit("}")]
    e = read_table(spark, sf_dir, "events").select("event_id", F.concat(*fields).alias("metadata"))
    return e.select("event_id", *[compile_open_filter(f, F.col("metadata")).alias(name) for name, (f, _) in OPEN_FILTERS.items()])


def filter_open_props(spark, sf_dir):
    """Events that pass a filter on their properties as they are stored."""
    e = read_table(spark, sf_dir, "events")
    wanted = {"k": {"$gt": 10, "$lte": 60, "$nin": [42, "43"]}, "missing": {"$ne": "x"}}
    return e.where(compile_open_filter(wanted, F.col("props"))).select("event_id", "event_type")


def pipeline_counters(spark, sf_dir):
    """Events of a pipeline folded to counters per type; the same fold runs as a stream."""
    return counters(_events(spark, sf_dir))


def ingest_status(spark, sf_dir):
    """Users as files: events, those in error, the last one, and chunks."""
    e = _events(spark, sf_dir)
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("event_type") != "error").alias("ok"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_ingest"),
        F.sum("k").cast("long").alias("chunks"),
    )


def latency_summary(spark, sf_dir):
    return evaluate.latency(_events(spark, sf_dir), "value", "event_type")


def budget_action(spark, sf_dir):
    """What each user's storage use calls for."""
    e = _events(spark, sf_dir).groupBy("user_id").agg((F.sum("k") / F.count(F.lit(1)) * 2).alias("percent"))
    return e.select("user_id", snapshots.budget_action(F.col("percent")).alias("action"))


def extract_json_flatten(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", extract.flatten_json(F.col("props")).alias("text"))


# Files made of the tables' rows, twenty to a file, which the extractors then parse.


def _file(rows, key, line, head=None, end=""):
    """file_id and content: the lines of each file's rows in the order of the key."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("at"), line.alias("line")))), lambda x: x["line"]), "\n")
    parts = [F.lit(head + "\n")] if head else []
    return rows.groupBy(F.expr(f"{key} div 20").alias("file_id")).agg(F.concat(*parts, body, F.lit(end)).alias("content"))


def _parsed(files, kind):
    e = extract.extracted(F.lit(kind), F.col("content"))
    return files.select("file_id", e.alias("e")).select("file_id", F.col("e.text").alias("text"), F.col("e.error").alias("error"))


def extract_jsonl_rows(spark, sf_dir):
    """Events' properties as files of JSON lines, parsed to labelled rows."""
    return _parsed(_file(_events(spark, sf_dir), "event_id", F.col("props")), "jsonl")


def extract_csv_rows(spark, sf_dir):
    """Orders as CSV files, with quotes, delimiters and line feeds in a field."""
    o = read_table(spark, sf_dir, "orders")
    note = F.concat(F.lit('"'), "o_orderstatus", F.lit(', ""'), "o_orderpriority", F.lit('""\nnext"'))
    return _parsed(_file(o, "o_orderkey", F.concat_ws(",", "o_orderkey", "o_custkey", note), "o_orderkey,o_custkey,note"), "csv")


def extract_tsv_rows(spark, sf_dir):
    """Customers as TSV files; the header line stands in front of the rows."""
    c = read_table(spark, sf_dir, "customer")
    return _parsed(_file(c, "c_custkey", F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment"), "c_custkey\tc_name\tc_mktsegment"), "tsv")


def extract_sql_dump(spark, sf_dir):
    """Customers as SQL dumps: a table and one INSERT per row, with quotes in a value."""
    c = read_table(spark, sf_dir, "customer")
    values = F.concat_ws(", ", "c_custkey", F.concat(F.lit("'it''s "), "c_name", F.lit("; (x)'")), F.lit("NULL"))
    line = F.concat(F.lit("INSERT INTO `customer` VALUES ("), values, F.lit(");"))
    head = "-- dump\nCREATE TABLE IF NOT EXISTS `customer` (\n  `c_custkey` int NOT NULL,\n  `c_name` varchar(25),\n  c_note text,\n  PRIMARY KEY (`c_custkey`)\n);"
    return _parsed(_file(c, "c_custkey", line, head, "\n"), "sql")


def extract_yaml(spark, sf_dir):
    """Events as YAML files: a list of maps with quotes, a flow list, a nested map and block scalars."""
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    lines = [F.concat(F.lit("- id: "), "event_id", F.lit("  # a comment")), F.concat(F.lit("  type: 'it''s "), "event_type", F.lit("'")),
             F.concat(F.lit("  props:\n    k: "), "k", F.lit("\n    tags: [a, \"b, c\", "), "k", F.lit("]")),
             F.concat(F.lit("  note: >-\n    folded\n    "), "event_type", F.lit("\n  last: |\n    one\n      two: "), "k")]
    return _parsed(_file(e, "event_id", F.concat_ws("\n", *lines), "---"), "yaml")


def extract_rtf(spark, sf_dir):
    """Documents as RTF, with escapes, a font table, fallback characters and paragraphs."""
    text = F.coalesce("text", F.lit(""))
    for wanted, put in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\par ")):
        text = F.replace(text, F.lit(wanted), F.lit(put))
    text = F.regexp_replace(text, F.lit(r"[^\x00-\x7F]"), F.lit(r"\\u233\\'65"))
    head = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator nobody;}\f0 "
    files = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(head), text, F.lit("}")).alias("content"))
    e = extract.extracted(F.lit("rtf"), F.col("content"))
    return spread_small(files).select("doc_id", e.alias("e")).select("doc_id", F.char_length("e.text").alias("n_chars"), F.sha2(F.col("e.text"), 256).alias("text_sha256"))


def html_to_markdown(spark, sf_dir):
    out = extract.html_to_markdown(F.col("html"))
    return spread_small(read_table(spark, sf_dir, "pages")).select("page_id", F.char_length(out).alias("n_chars"), F.sha2(out, 256).alias("text_sha256"))


def extract_html(spark, sf_dir):
    out = extract.extract_html(F.col("html"))
    return spread_small(read_table(spark, sf_dir, "pages")).select("page_id", F.char_length(out).alias("n_chars"), F.sha2(out, 256).alias("text_sha256"))


def _numbered_lines(files, key, start):
    """Lines of the texts (key, text) with their offsets, and the running count of lines for which ``start`` holds."""
    own = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = files.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("first", start(F.col("line")))
    before = F.sum(F.char_length("line") + 1).over(own) - F.char_length("line") - 1
    return rows.select("*", before.alias("offset"), F.sum(F.col("first").cast("long")).over(own).alias("block"))


def chunk_markdown_sections(spark, sf_dir):
    """Sections of the pages' Markdown, by a running count of heading lines; block 0 stands before the first heading."""
    text = F.coalesce(extract.html_to_markdown(F.col("html")), F.lit(""))
    pages = spread_small(read_table(spark, sf_dir, "pages")).select("page_id", text.alias("text"))
    s = _numbered_lines(pages, "page_id", lambda line: line.rlike(r"^#{1,6}\s+.+$"))
    return s.groupBy("page_id", F.col("block").alias("section")).agg(
        F.min("offset").alias("offset"), F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line")).alias("chars"), F.max(F.when(F.col("first"), F.col("line"))).alias("heading")
    )


def log_entries(spark, sf_dir):
    """Events as log files, errors with a line that continues them, cut into entries at the lines that begin with a time."""
    e = read_table(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", "user_id", F.when(F.col("event_type") == "error", F.concat(F.lit("\n    props "), "props")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    files = e.groupBy(F.expr("event_id div 20").alias("file_id")).agg(text.alias("text"))
    rows = _numbered_lines(files, "file_id", starts_entry)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("file_id", F.col("block").alias("entry")).agg(F.count(F.lit(1)).alias("lines"), F.sha2(joined, 256).alias("text_sha256"))


# Collections: a user's events ask for theirs to be created with parameters from the properties, errors to be deleted.


def _collection_requests(spark, sf_dir):
    k, n = F.col("k").cast("long"), F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("user-"), "user_id")).alias("collection_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("create").alias("action"), (k - 3).alias("dimension"),
        pick(("cosine", "l2", "dot", "l1"), n).alias("metric"), pick(("m1", "m2", "", "m3", "m4"), n).alias("model"), F.lit("1").alias("schema_version"),
        pick(("fp16", "sq8", "fp16", "int4"), k).alias("quantization"), k.alias("m"), (k * 10).alias("ef_construction"), (k * 6).alias("ef_search"),
    )


def collection_requests(spark, sf_dir):
    """What each request comes to."""
    return collections.judge(_collection_requests(spark, sf_dir)).select("seq", "collection_id", "action", "outcome")


def collections_live(spark, sf_dir):
    """The collections after all requests."""
    return collections.live(collections.judge(_collection_requests(spark, sf_dir))).select("collection_id", "seq", "dimension", "metric", "model", "quantization")


def change_detection(spark, sf_dir):
    """Orders up to 1998 as the registry, those from 1994 on as the scan; urgent ones were changed, some by an older pipeline."""
    o = read_table(spark, sf_dir, "orders")
    mark = F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus"), 256)
    known = o.where("o_orderdate < '1999-01-01'").select(
        F.col("o_orderkey").alias("path"),
        ingest.known_fingerprint(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("old")).otherwise(mark), F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "P", F.lit("new")).otherwise(F.col("o_orderstatus"))).alias("fingerprint"),
    )
    scan = o.where("o_orderdate >= '1994-01-01'").select(F.col("o_orderkey").alias("path"), mark.alias("fingerprint"))
    return ingest.change_set(scan, known)


def chunk_sources_join(spark, sf_dir):
    """Line items as chunks, each with the order it came from; chunks without an order stay."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    o = read_table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.concat(F.lit("order/"), "o_orderkey").alias("source_path"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "left").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("chunks"), F.max("source_path").alias("source_path"))


def _memory(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created"), F.col("role").alias("kind"), "text")


def memory_list(spark, sf_dir):
    """The last two user entries of each session."""
    return memory.last_entries(_memory(spark, sf_dir), 2, kind="user").select("session_id", "created", F.sha2("text", 256).alias("text_sha256"))


def memory_assemble(spark, sf_dir):
    out = memory.assemble(memory.last_entries(_memory(spark, sf_dir), 20))
    return out.select("session_id", "entries", F.sha2("context", 256).alias("context_sha256"))


def rag_prompt(spark, sf_dir):
    """Per session: its last user entry asked with its assembled memory; the context is the assistant's texts."""
    m = _memory(spark, sf_dir)
    asked = m.where("kind = 'user'").groupBy("session_id").agg(F.max_by("text", "created").alias("question"))
    told = memory.assemble(m.where("kind = 'assistant'")).select("session_id", F.col("context").alias("told"))
    held = memory.assemble(m).select("session_id", F.col("context").alias("held"))
    p = memory.prompt(F.col("question"), F.col("told"), F.col("held"))
    return asked.join(told, "session_id").join(held, "session_id").select("session_id", F.sha2(p, 256).alias("prompt_sha256"))


def resolve_layer(spark, sf_dir):
    """Users' requested layers by event type, resolved by whether a semantic collection is ready."""
    asked = F.when(F.col("event_type") == "click", "auto").when(F.col("event_type") == "view", "semantic").when(F.col("event_type") == "error", "fused").otherwise("raw")
    return _events(spark, sf_dir).select("event_id", search.resolve_layer(asked, F.col("user_id") % 2 == 0).alias("layer"))


QUERIES = {
    f.__name__: f
    for f in (
        *map(_filter_query, FILTERS), filter_open_metadata, filter_open_props, pipeline_counters, ingest_status, latency_summary, budget_action, extract_json_flatten,
        extract_jsonl_rows, extract_csv_rows, extract_tsv_rows, extract_sql_dump, extract_yaml, extract_rtf, html_to_markdown, extract_html, chunk_markdown_sections, log_entries,
        collection_requests, collections_live, change_detection, chunk_sources_join,
        memory_list, memory_assemble, rag_prompt, resolve_layer,
    )
}

_EV = "(SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k0, CASE WHEN k0 >= 10 THEN k0 END AS k FROM events)"


def _where(condition: str) -> str:
    return f"SELECT event_id, event_type, value FROM {_EV} WHERE {condition}"


def _html(start: str) -> str:
    """The steps of the HTML conversion; lists and tables in these pages stand in removed elements or are absent."""
    x = start
    steps = [(rf"<h{n}\b[^>]*>(.*?)</h{n}>", f"chr(10) || '{'#' * n} \\1' || chr(10)") for n in range(1, 7)]
    steps += [(r"<p\b[^>]*>(.*?)</p>", "chr(10) || '\\1' || chr(10)"), (r"<br\s*/?>", "chr(10)"), (r"<div\b[^>]*>(.*?)</div>", "chr(10) || '\\1' || chr(10)")]
    for tag, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"), ("code", "`")):
        steps.append((rf"<{tag}\b[^>]*>(.*?)</{tag}>", f"'{mark}\\1{mark}'"))
    steps += [(r'<a\b[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>'.replace("''", "'").replace("'", "''"), "'[\\2](\\1)'"), (r"<[^>]+>", "''")]
    for pattern, put in steps:
        x = f"regexp_replace({x}, '{pattern}', {put}, 'gis')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        x = f"replace({x}, '{entity}', '{char}')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _drop(x: str, tags: tuple[str, ...]) -> str:
    """RE2 has no back-references; elements that don't nest may be dropped one kind after the other."""
    for tag in tags:
        x = rf"regexp_replace({x}, '<{tag}\b[^>]*>.*?</{tag}>', '', 'gis')"
    return x


_MEM = "m AS (SELECT conv_id AS session_id, turn AS created, role AS kind, text FROM conversations)"
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_COLLECTIONS = f"""
        r AS (SELECT event_id AS seq, k0::BIGINT AS n, CASE WHEN n % 13 = 0 THEN ' ' ELSE 'user-' || user_id END AS collection_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'create' END AS action,
              n - 3 AS dimension, ['cosine', 'l2', 'dot', 'l1'][event_id % 4 + 1] AS metric, ['m1', 'm2', '', 'm3', 'm4'][event_id % 5 + 1] AS model, ['fp16', 'sq8', 'fp16', 'int4'][n % 4 + 1] AS quantization FROM {_EV}),
        e AS (SELECT *, CASE WHEN action = 'delete' THEN NULL WHEN trim(collection_id) = '' THEN 'no collection' WHEN dimension <= 0 THEN 'dimension is not positive'
              WHEN metric = 'l1' THEN 'unknown metric' WHEN model = '' THEN 'no model' WHEN quantization = 'int4' THEN 'unknown quantization'
              WHEN n NOT BETWEEN 4 AND 64 THEN 'm is not from 4 to 64' WHEN n * 10 NOT BETWEEN 50 AND 800 THEN 'ef_construction is not from 50 to 800'
              WHEN n * 6 NOT BETWEEN 10 AND 500 THEN 'ef_search is not from 10 to 500' END AS error FROM r),
        p AS (SELECT *, last_value(CASE WHEN error IS NULL THEN action END IGNORE NULLS) OVER (PARTITION BY collection_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
        j AS (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN action = 'create' AND before = 'create' THEN 'already exists' WHEN action = 'create' THEN 'created'
              WHEN before = 'create' THEN 'deleted' ELSE 'not found' END AS outcome FROM p)"""

ORACLE = {
    "filter_eq": _where("event_type = 'click'"),
    "filter_or_array": _where("event_type IN ('click', 'view')"),
    "filter_null_noop": _where("event_type = 'error'"),
    "filter_range": _where("value >= 10 AND value < 50 AND event_type > 'd' AND event_type <= 'purchase'"),
    "filter_ne": _where("k IS NULL OR k <> 42"),
    "filter_in": _where("k IN (11, 22, 33)"),
    "filter_nin": _where("k IS NULL OR k NOT IN (11, 22, 33)"),
    "filter_unknown_op": _where("FALSE"),
    "filter_cli": _where("event_type = 'signup' AND value > 5"),
    "pipeline_counters": f"""
        SELECT event_type, count(*) AS events, count(*) FILTER (value > 100) AS large, round(sum(value), 4) AS total, sum(k0)::BIGINT AS k_total
        FROM {_EV} GROUP BY 1""",
    "ingest_status": f"""
        SELECT user_id, count(*) AS files, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors,
               strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_ingest, sum(k0)::BIGINT AS chunks FROM {_EV} GROUP BY 1""",
    "filter_open_metadata": f"""
        SELECT event_id, {", ".join(f"({sql}) AS {name}" for name, (_, sql) in OPEN_FILTERS.items())}
        FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""",
    "filter_open_props": """
        SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 10 AND json_extract_string(props, '$.k')::BIGINT <= 60
            AND json_extract_string(props, '$.k')::BIGINT <> 42""",
    "extract_yaml": """
        WITH e AS (SELECT event_id // 20 AS file_id, event_id, event_type AS t, json_extract_string(props, '$.k') AS k,
                          '[' || (row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1) || '].' AS i FROM events)
        SELECT file_id, string_agg(i || 'id: ' || event_id || chr(10) || i || 'type: it''s ' || t || chr(10) || i || 'props.k: ' || k || chr(10) || i || 'props.tags[0]: a'
                   || chr(10) || i || 'props.tags[1]: b, c' || chr(10) || i || 'props.tags[2]: ' || k || chr(10) || i || 'note: folded ' || t
                   || chr(10) || i || 'last: one' || chr(10) || '  two: ' || k || chr(10), chr(10) ORDER BY event_id) AS text, NULL::VARCHAR AS error
        FROM e GROUP BY 1""",
    "extract_rtf": r"""
        WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '[^\x00-\x7F]', 'é', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
                          ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)
        SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM d""",
    "latency_summary": """
        SELECT event_type, min(value) AS least, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most,
               round(avg(value), 6) AS mean FROM events GROUP BY 1""",
    "budget_action": f"""
        SELECT user_id, CASE WHEN p > 95 THEN 'skip' WHEN p > 85 THEN 'compact' WHEN p > 70 THEN 'warn' ELSE 'normal' END AS action
        FROM (SELECT user_id, sum(k0) / count(*) * 2 AS p FROM {_EV} GROUP BY 1)""",
    "extract_json_flatten": "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS text FROM events",
    "extract_jsonl_rows": """
        SELECT event_id // 20 AS file_id, 'Columns: k' || chr(10) || string_agg('k: ' || coalesce(json_extract_string(props, '$.k'), ''), chr(10) ORDER BY event_id) AS text,
               NULL::VARCHAR AS error FROM events GROUP BY 1""",
    "extract_csv_rows": """
        SELECT o_orderkey // 20 AS file_id, string_agg('o_orderkey: ' || o_orderkey || ', o_custkey: ' || o_custkey || ', note: ' || o_orderstatus || ', "'
               || o_orderpriority || '"' || chr(10) || 'next', chr(10) ORDER BY o_orderkey) AS text, NULL::VARCHAR AS error FROM orders GROUP BY 1""",
    "extract_tsv_rows": """
        SELECT c_custkey // 20 AS file_id, 'Columns: c_custkey, c_name, c_mktsegment' || chr(10) || string_agg('c_custkey: ' || c_custkey || ', c_name: ' || c_name
               || ', c_mktsegment: ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS text, NULL::VARCHAR AS error FROM customer GROUP BY 1""",
    "extract_sql_dump": """
        SELECT c_custkey // 20 AS file_id, 'Table: customer' || chr(10) || 'Columns: c_custkey, c_name, c_note' || chr(10) || '---' || chr(10)
               || string_agg('c_custkey: ' || c_custkey || ', c_name: it''s ' || c_name || '; (x), c_note: ', chr(10) ORDER BY c_custkey) AS text,
               NULL::VARCHAR AS error FROM customer GROUP BY 1""",
    "html_to_markdown": f"""
        WITH x AS (SELECT page_id, {_html(_drop("html", ("script", "style", "nav", "header", "footer")))} AS t FROM pages)
        SELECT page_id, length(t)::INTEGER AS n_chars, sha256(t) AS text_sha256 FROM x""",
    "extract_html": rf"""
        WITH k AS (SELECT page_id, {_drop("html", ("script", "style", "nav", "header", "footer", "noscript", "iframe"))} AS h FROM pages),
        b AS (SELECT page_id, coalesce(nullif(regexp_extract(h, '<body\b[^>]*>(.*)</body>', 1, 'is'), ''), h) AS h FROM k),
        x AS (SELECT page_id, {_html(_drop("h", ("script", "style", "nav", "header", "footer")))} AS t FROM b)
        SELECT page_id, length(t)::INTEGER AS n_chars, sha256(t) AS text_sha256 FROM x""",
    "chunk_markdown_sections": rf"""
        WITH x AS (SELECT page_id, string_split(coalesce({_html(_drop("html", ("script", "style", "nav", "header", "footer")))}, ''), chr(10)) AS ls FROM pages),
        l AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM x),
        b AS (SELECT *, regexp_full_match(line, '#{{1,6}}\s+.+') AS head, sum(length(line) + 1) OVER w - length(line) - 1 AS off, sum(regexp_full_match(line, '#{{1,6}}\s+.+')::INTEGER) OVER w AS section
              FROM l WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING))
        SELECT page_id, section::BIGINT AS section, min(off)::BIGINT AS "offset", count(*) AS lines, sum(length(line))::BIGINT AS chars, max(line) FILTER (head) AS heading FROM b GROUP BY 1, 2""",
    "log_entries": """
        SELECT event_id // 20 AS file_id, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) AS entry, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END::BIGINT AS lines,
            sha256(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || user_id || CASE WHEN event_type = 'error' THEN ' ' || chr(10) || '    props ' || props ELSE '' END) AS text_sha256
        FROM events""",
    "collection_requests": f"WITH {_COLLECTIONS} SELECT seq, collection_id, action, outcome FROM j",
    "collections_live": f"""
        WITH {_COLLECTIONS} SELECT collection_id, seq, dimension, metric, model, quantization
        FROM (SELECT * FROM j WHERE outcome IN ('created', 'deleted') QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY seq DESC) = 1) WHERE outcome = 'created'""",
    "change_detection": """
        WITH o AS (SELECT *, sha256(o_custkey || '|' || o_orderstatus) AS mark FROM orders),
        known AS (SELECT o_orderkey AS path, CASE WHEN o_orderpriority = '1-URGENT' THEN 'old' ELSE mark END
                  || CASE WHEN o_orderstatus = 'P' THEN '::stale-pipeline' ELSE '' END AS was FROM o WHERE o_orderdate < '1999-01-01'),
        scan AS (SELECT o_orderkey AS path, mark AS now FROM o WHERE o_orderdate >= '1994-01-01')
        SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' WHEN now = was THEN 'unchanged' ELSE 'modified' END AS change_type
        FROM scan FULL JOIN known USING (path)""",
    "chunk_sources_join": """
        SELECT l_orderkey, count(*) AS chunks, max('order/' || o_orderkey) AS source_path
        FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY 1""",
    "memory_list": f"""
        WITH {_MEM} SELECT session_id, created, sha256(text) AS text_sha256 FROM m WHERE kind = 'user'
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created DESC) <= 2""",
    "memory_assemble": f"""
        WITH {_MEM}, t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created DESC) <= 20)
        SELECT session_id, count(*) AS entries, sha256(string_agg(text, {_SEP} ORDER BY created)) AS context_sha256 FROM t GROUP BY 1""",
    "rag_prompt": f"""
        WITH {_MEM}, a AS (SELECT session_id, arg_max(text, created) AS question FROM m WHERE kind = 'user' GROUP BY 1),
        t AS (SELECT session_id, string_agg(text, {_SEP} ORDER BY created) AS told FROM m WHERE kind = 'assistant' GROUP BY 1),
        h AS (SELECT session_id, string_agg(text, {_SEP} ORDER BY created) AS held FROM m GROUP BY 1)
        SELECT session_id, sha256('You are a helpful assistant. Answer the question using only the provided context. If the answer cannot be found in the context, say so.'
            || chr(10) || chr(10) || CASE WHEN trim(held) <> '' THEN 'Memory context:' || chr(10) || chr(10) || trim(held) || chr(10) || chr(10) ELSE '' END
            || 'Retrieved context:' || chr(10) || chr(10) || told || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:') AS prompt_sha256
        FROM a JOIN t USING (session_id) JOIN h USING (session_id)""",
    "resolve_layer": """
        SELECT event_id, CASE WHEN user_id % 2 <> 0 THEN 'raw' ELSE CASE event_type WHEN 'click' THEN 'fused' WHEN 'view' THEN 'semantic'
            WHEN 'error' THEN 'fused' ELSE 'raw' END END AS layer FROM events""",
}
