"""SQL for the chunker queries: running counts for blocks, a recursive step from chunk to chunk."""

from __future__ import annotations

from tidemark.functions.text import STOPWORDS, TIMESTAMPS

_SIZE, _OVERLAP = 800, 120
#: How the chunkers may end a chunk, by falling preference.
_ANYWHERE = (r"\n\n", r"[.?!][ \n]", " ", r"\n")
_PARAGRAPH = (r"\n\n", r"\n")
_LINE = (r"\n",)

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_UPTO = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _end(at: str, marks: tuple[str, ...]) -> str:
    """Where the chunk from ``at`` ends: after the last mark in the second half of its room, else with the room."""
    half = _SIZE // 2
    after = ", ".join(f"nullif(length(regexp_extract(substr(body, {at} + {half + 1}, {half}), '^.*{m}', 0, 's')), 0)" for m in marks)
    return f"CASE WHEN length(body) - {at} <= {_SIZE} THEN length(body) ELSE {at} + {half} + coalesce({after}, {half}) END"


def _cut(blocks: str, marks: tuple[str, ...]) -> str:
    """Spans a to b of the bodies of ``blocks`` (doc_id, block, label, body, off), as a CTE named cut."""
    return f"""
        cut AS (SELECT doc_id, block, label, body, off, 0::BIGINT AS a, ({_end("0", marks)})::BIGINT AS b FROM {blocks} WHERE body <> ''
            UNION ALL SELECT doc_id, block, label, body, off, a2, {_end("a2", marks)}
            FROM (SELECT *, a + greatest(1, b - a - {_OVERLAP}) AS a2 FROM cut WHERE b < length(body)))"""


def _pack(units: str) -> str:
    """``units`` (doc_id, idx from 0, unit, room) joined by line feeds while they fit, as a CTE named packed."""
    return f"""
        u1 AS (SELECT *, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM {units}),
        u2 AS (SELECT doc_id, idx, s, room FROM u1 UNION ALL SELECT doc_id, max(idx) + 1, max(s + length(unit) + 1), max(room) FROM u1 GROUP BY 1),
        u3 AS (SELECT doc_id, idx, greatest(idx + 1, max(idx) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND room FOLLOWING))::BIGINT AS nxt FROM u2),
        st AS (SELECT doc_id, idx FROM u1 WHERE idx = 0 UNION ALL SELECT st.doc_id, u3.nxt FROM st JOIN u3 ON u3.doc_id = st.doc_id AND u3.idx = st.idx),
        g AS (SELECT u1.*, count(st.idx) OVER (PARTITION BY u1.doc_id ORDER BY u1.idx ROWS UNBOUNDED PRECEDING) - 1 AS pos
              FROM u1 LEFT JOIN st ON st.doc_id = u1.doc_id AND st.idx = u1.idx),
        packed AS (SELECT doc_id, pos, string_agg(unit, chr(10) ORDER BY idx) AS body, min(s) AS s FROM g GROUP BY 1, 2)"""


_MARKDOWN = rf"""
        m0 AS (SELECT *, regexp_full_match(line, '#{{1,6}}\s+.+') AS head FROM l),
        m1 AS (SELECT *, sum(head::INTEGER) {_UPTO} AS block FROM m0),
        m2 AS (SELECT doc_id, block, max(line) FILTER (head) AS heading, min(off) AS off,
                      {_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT head), '')")} AS inner_text FROM m1 GROUP BY 1, 2),
        m3 AS (SELECT doc_id, block, off, CASE WHEN heading IS NULL THEN 'paragraph' ELSE 'heading' END AS label,
                      CASE WHEN heading IS NULL THEN inner_text ELSE {_STRIP.format("heading || chr(10) || chr(10) || inner_text")} END AS body FROM m2)"""
_STRUCTURED = r"""
        b0 AS (SELECT *, regexp_matches(line, '^\s*```') AS fence FROM l),
        b1 AS (SELECT *, coalesce(sum(fence::INTEGER) {before}, 0) % 2 = 1 AS inside FROM b0),
        b2 AS (SELECT *, CASE WHEN inside OR fence THEN 'code' WHEN NOT regexp_matches(line, '\S') THEN NULL WHEN regexp_full_match(ltrim(line), '\|.+\|') THEN 'table'
                              WHEN regexp_matches(ltrim(line), '^(?:[-*+]|[0-9]+\.)\s') THEN 'list' ELSE 'paragraph' END AS kind FROM b1),
        b3 AS (SELECT *, last_value(kind IGNORE NULLS) {before} AS prev FROM b2),
        b4 AS (SELECT *, sum(CASE WHEN kind = 'code' THEN (NOT inside)::INTEGER WHEN kind IS DISTINCT FROM prev AND kind IS NOT NULL THEN 1 ELSE 0 END) {upto} AS block
               FROM b3 WHERE kind IS NOT NULL OR prev <> 'code'),
        b5 AS (SELECT doc_id, block, any_value(source) AS source, min(coalesce(kind, prev)) AS label, string_agg(line, chr(10) ORDER BY line_no) AS body, min(off) AS off FROM b4 GROUP BY 1, 2)""".format(before=_BEFORE, upto=_UPTO)
_LOG = rf"""
        g0 AS (SELECT *, regexp_matches(line, '{"|".join(f"(?:{p})" for p in TIMESTAMPS)}') AS stamp, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM l),
        g1 AS (SELECT *, bool_or(stamp AND line_no < 20) OVER (PARTITION BY doc_id) AS stamped FROM g0 WHERE n_lines > 1 OR regexp_matches(line, '\S')),
        g2 AS (SELECT *, CASE WHEN stamped THEN sum((stamp OR line_no = 0)::INTEGER) {_UPTO} - 1 ELSE line_no END::BIGINT AS idx FROM g1),
        units AS (SELECT doc_id, idx, string_agg(line, chr(10) ORDER BY line_no) AS unit, {_SIZE} AS room FROM g2 GROUP BY 1, 2)"""
_TABLE = rf"""
        h AS (SELECT doc_id, line || chr(10) || '---' || chr(10) AS prefix, length(line) + 1 AS base FROM l WHERE line_no = 0 AND starts_with(line, 'Columns:')),
        units AS (SELECT l.doc_id, (row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no) - 1)::BIGINT AS idx, line AS unit,
                         greatest(0, {_SIZE} - coalesce(length(prefix), 0)) AS room
                  FROM l LEFT JOIN h ON h.doc_id = l.doc_id WHERE regexp_matches(line, '\S') AND (prefix IS NULL OR line_no > 0))"""

_FROM_CUT = """
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block, a) - 1)::INTEGER AS pos, {label} AS label, (off + a)::INTEGER AS "offset",
               (b - a)::INTEGER AS length, sha256(substr(body, a + 1, b - a)) AS text_sha256 FROM cut"""
_FROM_PACKED = """
        SELECT packed.doc_id, pos::INTEGER AS pos, '{label}' AS label, ({base} + s)::INTEGER AS "offset", length({text})::INTEGER AS length, sha256({text}) AS text_sha256
        FROM packed"""

_QUALITY = """, o AS (SELECT source, sha256(text) AS h, count(*) AS n, sum(length(text)) AS chars FROM c GROUP BY 1, 2)
        SELECT source, sum(n)::BIGINT AS chunks, sum(chars)::BIGINT AS chars, round(sum(chars)::DOUBLE / sum(n), 6) AS mean_chars,
               sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1)::DOUBLE / sum(n), 6) AS duplicate_ratio FROM o GROUP BY 1"""


def oracles(documents: str, lines: str, title: str, keywords: str, entities: str) -> dict[str, str]:
    """SQL by query, from the CTEs of the documents (d), their lines (l), titles, keywords and entities."""
    whole = f"WITH RECURSIVE {documents}, whole AS (SELECT doc_id, 0 AS block, 'text' AS label, text AS body, 0 AS off FROM d), {_cut('whole', _ANYWHERE)}"
    by_line = f"WITH RECURSIVE {documents}, {lines}"
    structured = f"{by_line}, {_STRUCTURED}, {_cut('b5', _LINE)}"
    parts = f"""{structured}, c AS (SELECT source, cut.label, substr(cut.body, a + 1, b - a) AS text FROM cut JOIN b5 ON b5.doc_id = cut.doc_id AND b5.block = cut.block)"""
    doc_hash, text_hash = "sha256(doc_id::VARCHAR)", "sha256(substr(body, a + 1, b - a))"
    chunk_id = f"sha256({doc_hash} || '1.0.0' || a || {text_hash})"
    own = f"{whole}, c AS (SELECT source, substr(body, a + 1, b - a) AS text FROM cut JOIN (SELECT doc_id, source FROM d) USING (doc_id))"
    plain = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return {
        "chunk_fixed": whole + _FROM_CUT.format(label="label"),
        "chunk_markdown": f"{by_line}, {_MARKDOWN}, {_cut('m3', _PARAGRAPH)}"
        + _FROM_CUT.format(label=f"CASE WHEN length(body) <= {_SIZE} THEN label WHEN a = 0 THEN 'heading' ELSE 'paragraph' END"),
        "chunk_structured": structured + _FROM_CUT.format(label="label"),
        "chunk_log": f"{by_line}, {_LOG}, {_pack('units')}" + _FROM_PACKED.format(label="text", base="0", text="body"),
        "chunk_table": f"{by_line}, {_TABLE}, {_pack('units')}"
        + _FROM_PACKED.format(label="table", base="coalesce(base, 0)", text="coalesce(prefix, '') || body")
        + " LEFT JOIN h ON h.doc_id = packed.doc_id",
        "chunk_ids": f"""{whole} SELECT doc_id, a::INTEGER AS "offset", {chunk_id} AS chunk_id FROM cut""",
        "build_records": f"""{whole}
            SELECT {chunk_id} AS chunk_id, {doc_hash} AS doc_id, {text_hash} AS chunk_hash,
                   sha256('1.0.01.0.01.0.0|size={_SIZE}|overlap={_OVERLAP}|strategy=fixed') AS pipeline_signature, source AS source_uri, a::INTEGER AS "offset"
            FROM cut JOIN (SELECT doc_id, source FROM d) USING (doc_id)""",
        "chunk_quality": parts + _QUALITY,
        "ingest_quality": own + _QUALITY,
        "duplicate_ratio": f"""{own}, o AS (SELECT sha256(text) AS h, count(*) AS n FROM c GROUP BY 1)
            SELECT sum(n)::BIGINT AS chunks, sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1)::DOUBLE / sum(n), 6) AS ratio FROM o""",
        "label_distribution": f"{parts} SELECT label, count(*) AS n FROM c GROUP BY 1",
        "chunk_count_by_source": f"{own} SELECT source, count(*) AS chunks FROM c GROUP BY 1",
        "chunk_labels": f"{parts} SELECT source, label, count(*) AS chunks FROM c GROUP BY 1, 2",
        "distill_themes": rf"""
            WITH {title}, {keywords}, {entities},
            tp AS (SELECT doc_id, regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}\b') AS m FROM d),
            every AS (SELECT doc_id, {plain.format("title")} AS x, 0 AS part, 0 AS i FROM title WHERE length({plain.format("title")}) >= 4
                UNION ALL SELECT doc_id, {plain.format("x")}, 1, i FROM (SELECT doc_id, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM tp)
                          WHERE length({plain.format("x")}) >= 4
                UNION ALL SELECT doc_id, {plain.format("x")}, 2, i FROM (SELECT doc_id, unnest(entities) AS x, generate_subscripts(entities, 1) AS i FROM ent)
                UNION ALL SELECT doc_id, x, 3, i FROM (SELECT doc_id, unnest(keywords) AS x, generate_subscripts(keywords, 1) AS i FROM kw) WHERE length(x) >= 4),
            one AS (SELECT doc_id, x, min(part * 1000000000::BIGINT + i) AS place FROM every WHERE x NOT IN ({stop}) GROUP BY 1, 2),
            top AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) <= 8)
            SELECT d.doc_id, coalesce(string_agg(x, '|' ORDER BY place), '') AS themes FROM d LEFT JOIN top USING (doc_id) GROUP BY 1""",
    }
