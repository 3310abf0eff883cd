"""The operators' queries in SQL, where SQL can express them."""

from __future__ import annotations

from tidemark.llm import fingerprints as prints
from tidemark.llm.secret_scan import ADDED, BASE, FAST, KINDS, MIN_OWNERS

EXACT_DEDUP = """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)"""

EXACT_TOPK = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.c, v.c)::BIGINT AS score
        FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
    r AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score
        FROM s)
    SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5"""

_WORDS = r"d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"

JACCARD_JOIN = f"""
    WITH RECURSIVE {_WORDS},
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS gram FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    k AS (SELECT a AS doc_id, min(b) AS low, count(*) FILTER (b <> a) + 1 AS size FROM r GROUP BY 1),
    m AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
    SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(size, 1) AS class_size,
           least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
    FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""

SUBSTRING_DEDUP = f"""
    WITH {_WORDS},
    x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i,
              unnest([CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END FOR i IN range(1, len(w) + 1)]) AS win FROM d),
    f AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM x),
    g AS (SELECT *, max(again::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
    o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN o USING (doc_id)"""


def _kind(kind: str) -> str:
    pattern, group, least = (BASE | ADDED)[kind]
    pattern = FAST.get(kind, pattern).replace("}+", "}").replace("'", "''")  # the match is the same without possessive forms
    own = "PARTITION BY doc_id ORDER BY i"
    return f"""
        SELECT doc_id, owner, {KINDS.index(kind)} AS rank, '{kind}' AS kind, start, start + length(whole) AS stop, sha256(value) AS hash
        FROM (SELECT *, (sum(gap) OVER ({own}) + coalesce(sum(length(whole)) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
              FROM (SELECT doc_id, owner, unnest(whole) AS whole, unnest(value) AS value, generate_subscripts(whole, 1) AS i,
                           unnest(list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x))[1:len(whole)]) AS gap
                    FROM (SELECT doc_id, owner, text, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS value FROM d)))
        WHERE length(value) >= {least}"""


_LIST = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"

SECRET_SCAN = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, split_part(coalesce(source, ''), '/', 1) AS owner FROM documents),
    s AS ({" UNION ALL ".join(map(_kind, KINDS))}),
    o AS (SELECT hash, count(DISTINCT owner) >= {MIN_OWNERS} AS copied FROM s GROUP BY 1),
    j AS (SELECT s.*, copied FROM s JOIN o USING (hash))
    SELECT d.doc_id, {", ".join(f"count(*) FILTER (rank = {k}) AS n_{kind}" for k, kind in enumerate(BASE))},
           sha256({_LIST.format(f" FILTER (rank < {len(BASE)})")}) AS base_sha256, {_LIST.format(f" FILTER (rank < {len(BASE)} OR NOT copied)")} AS spans,
           count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied
    FROM d LEFT JOIN j USING (doc_id) GROUP BY 1"""


def _crc32(text: str) -> str:
    """CRC-32 of a text in ASCII, bit by bit."""
    byte = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384), xor(acc, ascii(x)::BIGINT))"
    return f"xor(list_reduce(string_split({text}, ''), lambda acc, x: {byte}, 4294967295::BIGINT), 4294967295)"


def _fingerprints() -> str:
    r, q, c = prints.gamma_tables()
    groups, inner, alone = prints.multipliers()
    samples = ", ".join(f"({g * prints.TOGETHER + j}, {', '.join(map(repr, [*a, *b]))})" for g, a in enumerate(groups) for j, b in enumerate(inner))
    names = [f"f{i}" for i in range(15)]
    one = f"{1 << prints.BITS}::DOUBLE"
    linear = lambda x, y, a, b, c: f"(({x} * {a} + {y} * {b} + {c}) - floor({x} * {a} + {y} * {b} + {c}))"
    real = lambda x: f"{x!r}::DOUBLE"
    likeness = lambda a, b: f"len(list_filter(range({prints.SAMPLES}), lambda s: substr({a}, 4 * s + 1, 4) = substr({b}, 4 * s + 1, 4))) / {prints.SAMPLES}::DOUBLE"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                      row_number() OVER (ORDER BY doc_id NULLS FIRST) AS i, count(*) OVER () AS total FROM documents),
    e AS (SELECT d.i, d.doc_id, d.n, x.i AS next, d.text, left(d.text, d.n - d.n // 4) || left(x.text, d.n // 4) AS edited
          FROM d JOIN d AS x ON x.i = d.i % d.total + 1),
    w AS (SELECT i, side, word, count(*) AS w
          FROM (SELECT i, 0 AS side, unnest(regexp_extract_all(text, '[^ 	-
]+')) AS word FROM e
                UNION ALL SELECT i, 1, unnest(regexp_extract_all(edited, '[^ 	-
]+')) FROM e) GROUP BY ALL),
    x AS (SELECT i, side, ln(w::DOUBLE) AS w, (h >> {prints.BITS}) / {one} AS x, (h & {(1 << prints.BITS) - 1}) / {one} AS y
          FROM (SELECT *, ('0x' || substr(md5(word), 1, 13))::BIGINT AS h FROM w)),
    k AS (SELECT k, {", ".join(f"{n}::DOUBLE AS {n}" for n in names)} FROM (VALUES {samples}) AS v(k, {", ".join(names)})),
    g AS (SELECT i, side, w, k, {linear("x", "y", *map(real, alone))} AS z, {linear("x", "y", *names[:3])} AS x, {linear("x", "y", *names[3:6])} AS y, {", ".join(names[6:])}
          FROM x CROSS JOIN k),
    h AS (SELECT i, side, w, k, z, floor({linear("x", "y", *names[6:9])} * {prints.LEVELS})::INTEGER + 1 AS a,
                 floor({linear("x", "y", *names[9:12])} * {prints.LEVELS})::INTEGER + 1 AS o, {linear("x", "y", *names[12:])} AS b FROM g),
    t AS (SELECT {r!r}::DOUBLE[] AS r, {q!r}::DOUBLE[] AS q, {c!r}::DOUBLE[] AS c),
    s AS (SELECT i, side, k, z, b, r[a] AS r, c[o] AS c, floor(w * q[a] + b) AS t FROM h CROSS JOIN t),
    m AS (SELECT i, side, k, min(floor((c - r * (t - b + 1::DOUBLE) + {real(prints.FLOOR)}) * {real(prints.PARTS)}) * {prints.KEPT_BITS}::DOUBLE
                     + floor((z + t * {real(prints.STEP)} - floor(z + t * {real(prints.STEP)})) * {prints.KEPT}::DOUBLE))::BIGINT % {prints.KEPT_BITS} AS v
          FROM s GROUP BY 1, 2, 3),
    f AS (SELECT i, side, string_agg(format('{{:04x}}', v), '' ORDER BY k) AS f FROM m GROUP BY 1, 2),
    p AS (SELECT e.i, e.next, doc_id, n, sha256(edited) AS edited_sha256, coalesce(a.f, '{'f' * 4 * prints.SAMPLES}') AS fingerprint,
                 coalesce(b.f, '{'f' * 4 * prints.SAMPLES}') AS edited_fingerprint
          FROM e LEFT JOIN f AS a ON a.i = e.i AND a.side = 0 LEFT JOIN f AS b ON b.i = e.i AND b.side = 1)
    SELECT p.doc_id, p.n AS n_chars, p.edited_sha256, p.fingerprint, p.edited_fingerprint,
           {likeness("p.fingerprint", "p.edited_fingerprint")} AS near_edited, {likeness("p.fingerprint", "x.fingerprint")} AS near_next
    FROM p JOIN p AS x ON x.i = p.next"""


FINGERPRINTS = _fingerprints()

PERIODIC_RUNS = rf"""
    WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
    a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
    d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
              THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1] FOR i IN range(n)] ELSE w END AS w FROM a),
    x AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word,
                 unnest([CASE WHEN i + 16 <= len(w) THEN array_to_string(w[i + 1:i + 16], ' ') END FOR i IN range(len(w))]) AS g FROM d),
    m AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x AS a JOIN x AS b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
    s AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 16 + q AS length
          FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
    r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY 1, 2, 3),
    o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
    b AS (SELECT doc_id, start, length, period, row_number() OVER (PARTITION BY doc_id ORDER BY length / period::DOUBLE DESC, start, period) AS place FROM r),
    y AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
    k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN y ON x.doc_id = y.doc_id AND x.i = y.i WHERE y.i IS NULL GROUP BY 1)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM d LEFT JOIN o USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE place = 1) USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: object, letter: str, when: str = "true") -> str:
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {cost} ELSE 1000000 END, 'a': {state}.a || '{letter}'}}"


def _with_inserts(acc: str) -> str:
    """Costs and audits per state, o (nothing), s, u and a, after any inserts."""
    u = _least(f"{acc}.u", *[_way(f"{acc}.{q}", 2, "I") for q in "osa"])
    a = _least(f"{acc}.a", _way(f"{acc}.u", 2, "I"), *[_way(f"{acc}.{q}", 4, "II") for q in "os"])
    return f"{{'o': {acc}.o, 's': {acc}.s, 'u': {u}, 'a': {a}}}"


def _row_step() -> str:
    stays, some = "(x.fault = 1)::BIGINT", "x.fault < 2"
    delete = lambda q: _way(f"acc.{q}", 3, "D")
    keep = lambda q, initial: _way(f"acc.{q}", stays, "K", f"{some} AND x.initial = '{initial}'")
    rerole = lambda q: _way(f"acc.{q}", f"2 + {stays}", "R", some)
    s = _least(delete("s"), keep("o", "s"))
    u = _least(delete("u"), *[keep(q, "u") for q in "osa"], *[rerole(q) for q in "osa"])
    a = _least(delete("a"), keep("u", "a"), rerole("u"))
    return f"{{'o': {delete('o')}, 's': {s}, 'u': {u}, 'a': {a}}}"


_NOT_YET = "{'c': 1000000::BIGINT, 'a': ''}"

#: Between any two rows, and at both ends, stands a row of fault -1, where inserts may be made.
_STEPS = "flatten(list_transform(rows, lambda x: [x, {'initial': '', 'fault': -1}]))"

CONVERSATION_REPAIR = rf"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                      {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate FROM conversations),
    d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                 CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM r),
    q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                 trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM q),
    f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
                 CASE WHEN core = '' THEN 2 WHEN again THEN 3 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
    c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank,
                 count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
                 count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
                 list({{'initial': initial, 'fault': fault}} ORDER BY i) AS rows FROM f GROUP BY conv_id),
    w AS (SELECT * EXCLUDE (rows), list_reduce({_STEPS}, lambda acc, x: CASE WHEN x.fault < 0 THEN {_with_inserts("acc")} ELSE {_row_step()} END,
                 {{'o': {{'c': 0::BIGINT, 'a': ''}}, 's': {_NOT_YET}, 'u': {{'c': 2::BIGINT, 'a': 'I'}}, 'a': {{'c': 4::BIGINT, 'a': 'II'}}}}) AS acc FROM c),
    b AS (SELECT *, list_min([acc.o, acc.a]) AS best FROM w),
    l AS (SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS place FROM b WHERE best.a <> ''),
    n AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY place) AS i,
                 count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY place) AS k FROM l),
    j AS (SELECT n.*, f.role, f.text, f.initial FROM n LEFT JOIN f ON n.conv_id IS NOT DISTINCT FROM f.conv_id AND n.i = f.i WHERE letter <> 'D'),
    h AS (SELECT *, max((k = 1 AND letter = 'K' AND initial = 's')::INTEGER) OVER (PARTITION BY conv_id) AS led FROM j),
    t AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                 || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired FROM h GROUP BY 1),
    v AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT v.conv_id, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
           coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM v LEFT JOIN b ON v.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON v.conv_id IS NOT DISTINCT FROM t.conv_id"""
