"""Extractors: file contents to text. Tabular and HTML forms are expressions; JSON is an Arrow UDF."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import content_type
from tidemark.sources import formats


def labelled_row(columns: list[str]) -> Column:
    """``name: value`` pairs of a row; a missing value is empty."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns])


def header_line(columns: list[str]) -> str:
    return f"Columns: {', '.join(columns)}"


# HTML to Markdown, as expressions. Fixed order: what comes first changes what later steps see.
_TAG = r"(?is)<{0}\b[^>]*>(.*?)</{0}>"


def drop_elements(html: Column, names: str = "script|style|nav|header|footer") -> Column:
    return F.regexp_replace(html, rf"(?is)<({names})\b[^>]*>.*?</\1>", "")


def _lists(html: Column, tag: str) -> Column:
    """Each list as one line per item; the items between two list tags are found by extraction."""
    blocks = F.regexp_extract_all(html, F.lit(_TAG.format(tag)), F.lit(0))
    gaps = F.split(html, _TAG.format(tag), -1)

    def shown(block: Column) -> Column:
        items = F.regexp_extract_all(block, F.lit(r"(?is)<li\b[^>]*>.*?</li>"), F.lit(0))
        text = lambda x: F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), r"(?U)^\s+|\s+$", "")
        mark = (lambda i: F.lit("- ")) if tag == "ul" else (lambda i: F.concat((i + 1).cast("string"), F.lit(". ")))
        return F.concat(F.lit("\n"), F.array_join(F.transform(items, lambda x, i: F.concat(mark(i), text(x))), "\n"), F.lit("\n"))

    return F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), blocks.alias("block")), lambda p: F.concat(p["gap"], F.coalesce(shown(p["block"]), F.lit("")))), "")


def _tables(html: Column) -> Column:
    """Each table as pipe rows, a rule after the first, short rows filled up."""
    blocks = F.regexp_extract_all(html, F.lit(_TAG.format("table")), F.lit(0))
    gaps = F.split(html, _TAG.format("table"), -1)

    def shown(block: Column) -> Column:
        rows = F.transform(
            F.regexp_extract_all(block, F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0)),
            lambda r: F.transform(
                F.regexp_extract_all(r, F.lit(r"(?is)<(?:td|th)\b[^>]*>.*?</(?:td|th)>"), F.lit(0)),
                lambda c: F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"(?U)^\s+|\s+$", ""),
            ),
        )
        rows = F.filter(rows, lambda r: F.size(r) > 0)
        width = F.array_max(F.transform(rows, F.size))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        lines = F.flatten(F.transform(rows, lambda r, i: F.when(i == 0, F.array(line(r), rule)).otherwise(F.array(line(r)))))
        return F.when(F.size(rows) == 0, "").otherwise(F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")))

    return F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), blocks.alias("block")), lambda p: F.concat(p["gap"], F.coalesce(shown(p["block"]), F.lit("")))), "")


def html_to_markdown(html: Column) -> Column:
    """Markdown of headings, lists, tables, paragraphs, emphasis, code and links.

    The tags, their marks and the order of the rules are fixed values: chunk ids and hashes come from the exact
    Markdown, and each rule reads what the ones before it left (bold in a list item, ``&amp;lt;`` as ``<``).
    """
    out = drop_elements(html)
    for n in range(1, 7):
        out = F.regexp_replace(out, _TAG.format(f"h{n}"), f"\n{'#' * n} $1\n")
    out = _lists(_lists(_tables(out), "ul"), "ol")
    out = F.regexp_replace(out, _TAG.format("p"), "\n$1\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, _TAG.format("div"), "\n$1\n")
    for tag, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"), ("code", "`")):
        out = F.regexp_replace(out, _TAG.format(tag), f"{mark}$1{mark}")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def extract_html(html: Column) -> Column:
    """The body's content (the whole page if it has none) as Markdown, without what isn't content."""
    kept = drop_elements(html, "script|style|nav|header|footer|noscript|iframe")
    body = F.regexp_extract(kept, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    return html_to_markdown(F.when(body != "", body).otherwise(kept))


def _shown(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def flat_lines(value, path: str = "") -> list[str]:
    """``a.b[0]: value`` lines of a JSON value."""
    if value is None:
        return [f"{path}: null"] if path else []
    if isinstance(value, list):
        return [line for i, x in enumerate(value) for line in flat_lines(x, f"{path}[{i}]")] or [f"{path}: []"]
    if isinstance(value, dict):
        if not value:
            return [f"{path}: {{}}"] if path else []
        return [line for k, x in value.items() for line in flat_lines(x, f"{path}.{k}" if path else k)]
    return [f"{path}: {_shown(value)}"]


@F.arrow_udf(T.StringType())
def flatten_json(text: pa.Array) -> pa.Array:
    """Flat lines of JSON text; null where the text is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else "\n".join(flat_lines(json.loads(x)))
        except ValueError:
            return None

    return pa.array([one(x) for x in text.to_pylist()], pa.string())


def delimited_text(content: str, delimiter: str, with_columns: bool) -> str:
    """Rows of a delimited file as labelled rows; quoted fields may hold delimiters and line feeds."""
    rows = [r for r in csv.reader(io.StringIO(content), delimiter=delimiter) if r]
    if not rows:
        return ""
    head, *body = rows
    if not body:
        return ", ".join(head)
    lines = [", ".join(f"{h}: {row[i] if i < len(row) else ''}" for i, h in enumerate(head)) for row in body]
    return "\n".join([header_line(head), *lines] if with_columns else lines)


def json_lines_text(content: str) -> str:
    rows = [json.loads(line) for line in content.split("\n") if line.strip()]
    if not rows:
        return ""
    columns = list(rows[0])
    shown = lambda v: "" if v is None else _shown(v)
    return "\n".join([header_line(columns), *(", ".join(f"{c}: {shown(row.get(c))}" for c in columns) for row in rows)])


#: Words of an SQL dump: comments, quoted text, names, numbers and punctuation.
_SQL_WORD = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>[eE]?'(?:[^'\\]|\\.|'')*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])|(?P<bare>[^\s,();'"`]+)|(?P<mark>.)""",
    re.DOTALL,
)
#: What begins an entry of CREATE TABLE that is no column.
_SQL_CONSTRAINTS = {"primary", "key", "unique", "index", "constraint", "foreign", "check", "fulltext", "exclude"}


class _Dump:
    """Tables of an SQL dump, read statement by statement: CREATE TABLE, INSERT INTO, and COPY with its rows."""

    def __init__(self, content: str):
        self.tables: dict[str, tuple[list[str], list[list[str]]]] = {}
        self._text, self._at = content, 0
        while (word := self._next()) is not None:
            kind = word[1].lower()
            if word[0] == "bare" and kind in ("create", "insert", "copy"):
                getattr(self, f"_{kind}")()

    def _next(self) -> tuple[str, str] | None:
        while m := _SQL_WORD.match(self._text, self._at):
            self._at = m.end()
            if m.lastgroup != "skip":
                return m.lastgroup, m[0]
        return None

    def _statement(self) -> Iterator[tuple[str, str]]:
        while (word := self._next()) is not None and word != ("mark", ";"):
            yield word

    @staticmethod
    def _name(word: str) -> str:
        return ".".join(p.strip('"`[]') for p in word.split(".")).rsplit(".", 1)[-1]

    @staticmethod
    def _groups(words: Iterable[tuple[str, str]]) -> Iterator[list[list[tuple[str, str]]]]:
        """The top-level parentheses, each as its entries between commas."""
        depth, entries = 0, [[]]
        for word in words:
            if word == ("mark", "("):
                depth += 1
                if depth == 1:
                    entries = [[]]
                    continue
            elif word == ("mark", ")"):
                depth -= 1
                if depth == 0:
                    yield entries
                    continue
            if depth == 1 and word == ("mark", ","):
                entries.append([])
            elif depth:
                entries[-1].append(word)

    def _named(self, words: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
        """The table's name, and what follows from the first parenthesis on."""
        at = words.index(("mark", "(")) if ("mark", "(") in words else len(words)
        names = [w for kind, w in words[:at] if kind in ("name", "bare") and w.lower() != "values"]
        return self._name(names[-1]) if names else "", words[at:]

    def _create(self) -> None:
        words = list(self._statement())
        if "table" not in [w.lower() for _, w in words[:4]]:
            return
        name, rest = self._named(words)
        for entries in self._groups(rest):
            columns = [self._name(e[0][1]) for e in entries if e and e[0][1].lower() not in _SQL_CONSTRAINTS]
            self.tables.setdefault(name, (columns, []))
            return

    @staticmethod
    def _value(entry: list[tuple[str, str]]) -> str:
        if len(entry) == 1 and entry[0][0] == "text":
            body = entry[0][1].lstrip("eE")[1:-1].replace("''", "'")
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), body, flags=re.DOTALL)
        text = "".join(w for _, w in entry)
        return "" if text.lower() == "null" else text

    def _insert(self) -> None:
        words = list(self._statement())
        at = next((i for i, w in enumerate(words) if w[1].lower() == "values"), None)
        if at is None:
            return
        name, listed = self._named(words[:at])
        columns = next(([self._name(e[0][1]) for e in entries if e] for entries in self._groups(listed)), None)
        rows = [[self._value(e) for e in entries] for entries in self._groups(words[at + 1 :])]
        if name not in self.tables:
            self.tables[name] = (columns or [f"col{i + 1}" for i in range(len(rows[0]) if rows else 0)], [])
        own = self.tables[name][0]
        if columns and columns != own:
            rows = [[dict(zip(columns, row, strict=False)).get(c, "") for c in own] for row in rows]
        self.tables[name][1].extend(rows)

    def _copy(self) -> None:
        words = list(self._statement())
        if [w.lower() for _, w in words[-2:]] != ["from", "stdin"]:
            return
        name, listed = self._named(words[:-2])
        columns = next(([self._name(e[0][1]) for e in entries if e] for entries in self._groups(listed)), [])
        body, mark, _ = self._text[self._at :].lstrip("\n").partition("\n\\.")
        self._at = self._text.index(body, self._at) + len(body) + len(mark) if body else self._at
        own = self.tables.setdefault(name, (columns, []))
        own[1].extend([["" if x == "\\N" else x for x in line.split("\t")] for line in body.split("\n") if line])


def sql_dump_text(content: str) -> str:
    """Tables of an SQL dump as labelled rows; a dump without tables as it is."""
    sections = []
    for name, (columns, rows) in _Dump(content).tables.items():
        lines = [", ".join(f"{c}: {row[i] if i < len(row) else ''}" for i, c in enumerate(columns)) for row in rows]
        sections.append("\n".join([f"Table: {name}", header_line(columns), "---", *lines]))
    return "\n\n".join(sections) if sections else content


_OFFICE = {"docx": formats.docx_text, "pptx": formats.pptx_text, "xlsx": formats.xlsx_text, "rtf": formats.rtf_text}


def extract_bytes(kind: str, content: bytes) -> str:
    """Text of one file of a kind that has no expression; of a mail what needs no conversion."""
    if kind in _OFFICE:
        return _OFFICE[kind](content)
    text = content.decode("utf-8", "replace")
    if kind in ("csv", "tsv"):
        return delimited_text(text, "," if kind == "csv" else "\t", kind == "tsv")
    if kind == "jsonl":
        return json_lines_text(text)
    if kind == "json":
        return "\n".join(flat_lines(json.loads(text)))
    if kind in ("yaml", "yml"):
        return "\n".join(flat_lines(formats.yaml_value(text)))
    if kind == "sql":
        return sql_dump_text(text)
    if kind in ("txt", "md", "log", "html"):
        return text
    raise ValueError(f"no extractor for {kind}")


_PARTS = ["text", "html", "after", "error"]
_STRUCT = pa.struct([(name, pa.string()) for name in _PARTS])
#: Files that stand as Python objects at a time.
_AT_ONCE = 64


@F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in _PARTS]))
def _extract(kind: pa.Array, content: pa.Array) -> pa.Array:
    """Text, or an error; a mail that has only an HTML body leaves it to the expressions, and what comes after it."""

    def one(k: str | None, c: bytes | None) -> dict:
        try:
            if k == "eml":
                head, body, html, files = formats.mail_parts(c or b"")
                whole = "\n\n".join(p for p in (head, body, "" if html else files) if p)
                return {"text": whole, "html": html or None, "after": files if html and files else None}
            return {"text": extract_bytes(k or "", c or b"")}
        except Exception as err:  # one bad file is a row with its error, not a failed job
            return {"error": f"{type(err).__name__}: {err}"}

    # A few files at a time stand as Python objects: a batch holds thousands, each several times its bytes while it is read.
    kinds = [kind.slice(at, _AT_ONCE).to_pylist() for at in range(0, len(kind), _AT_ONCE)]
    made = [pa.array([one(k, c) for k, c in zip(some, content.slice(i * _AT_ONCE, _AT_ONCE).to_pylist(), strict=True)], _STRUCT) for i, some in enumerate(kinds)]
    return pa.concat_arrays(made) if made else pa.array([], _STRUCT)


def _text_of(kind: Column, e: Column) -> Column:
    mail = F.concat_ws("\n\n", e["text"], extract_html(e["html"]), e["after"])
    return F.when(kind == "html", extract_html(e["text"])).when(e["html"].isNotNull(), mail).otherwise(e["text"])


def extracted(kind: Column, content: Column) -> Column:
    """Struct of text and error of a file's content (binary) of a kind."""
    e = _extract(kind, content.cast("binary"))
    return F.struct(_text_of(kind, e).alias("text"), e["error"].alias("error"))


def extract_files(files: DataFrame) -> DataFrame:
    """(path, content, ...) to path, content_type, text, error and the further columns; HTML through the expressions."""
    kind = content_type(F.col("path"))
    others = [c for c in files.columns if c not in ("path", "content")]
    read = files.select("path", *others, kind.alias("content_type"), _extract(kind, F.col("content")).alias("e"))
    return read.select("path", "content_type", _text_of(F.col("content_type"), F.col("e")).alias("text"), F.col("e.error").alias("error"), *others)
