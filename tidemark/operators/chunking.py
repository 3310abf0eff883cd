"""Chunkers: text to labelled chunks with offsets, per batch in an Arrow UDF.

Offsets and sizes are code points. Each chunker is a small scanner over one text; Spark distributes
the texts and explodes the chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import TIMESTAMPS, extension

SIZE, OVERLAP = 2800, 420
CHUNK = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("offset", T.IntegerType())])
)

Chunk = tuple[str, str, int]

_HEADING = re.compile(r"#{1,6}\s+.+")
_TABLE_ROW = re.compile(r"\|.+\|")
_LIST_ITEM = re.compile(r"\s*(?:[-*+]|\d+\.)\s")
_SENTENCE_END = re.compile(r".*[.?!][ \n]", re.DOTALL)
_STAMP = re.compile("|".join(f"(?:{p})" for p in TIMESTAMPS))


def _spans(text: str, size: int, overlap: int, cut: Callable[[str, int, int], int]) -> Iterator[tuple[int, int]]:
    """Windows of at most ``size``, each ending where ``cut`` says and the next starting ``overlap`` before."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= size else cut(text, at + size // 2, at + size)
        yield at, end
        if end >= len(text):
            return
        at += max(1, end - at - overlap)


def _after_last(text: str, mark: str, low: int, high: int) -> int | None:
    found = text.rfind(mark, low, high)
    return None if found < 0 else found + len(mark)


def _cut_anywhere(text: str, low: int, high: int) -> int:
    """After the last paragraph, else sentence, else space, else line of the window, else its end."""
    paragraph = _after_last(text, "\n\n", low, high)
    if paragraph is not None:
        return paragraph
    sentence = _SENTENCE_END.match(text[low:high])
    if sentence:
        return low + sentence.end()
    return _after_last(text, " ", low, high) or _after_last(text, "\n", low, high) or high


def _cut_paragraph(text: str, low: int, high: int) -> int:
    return _after_last(text, "\n\n", low, high) or _after_last(text, "\n", low, high) or high


def _cut_line(text: str, low: int, high: int) -> int:
    return _after_last(text, "\n", low, high) or high


def _lines(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def fixed(text: str, size: int, overlap: int) -> list[Chunk]:
    return [(text[a:b], "text", a) for a, b in _spans(text, size, overlap, _cut_anywhere)]


def markdown(text: str, size: int, overlap: int) -> list[Chunk]:
    """A section per heading; a long one is cut at paragraphs, its first part being the heading's."""
    sections: list[tuple[str, int, list[str]]] = [("", 0, [])]
    for at, line in _lines(text):
        if _HEADING.fullmatch(line):
            sections.append((line, at, []))
        else:
            sections[-1][2].append(line)
    out: list[Chunk] = []
    for heading, at, lines in sections:
        body = "\n".join(lines).strip()
        whole = f"{heading}\n\n{body}".strip() if heading else body
        if not whole:
            continue
        if len(whole) <= size:
            out.append((whole, "heading" if heading else "paragraph", at))
        else:
            spans = _spans(whole, size, overlap, _cut_paragraph)
            out += [(whole[a:b], "paragraph" if a else "heading", at + a) for a, b in spans]
    return out


def _line_label(line: str) -> str:
    body = line.lstrip()
    return "table" if _TABLE_ROW.fullmatch(body) else "list" if _LIST_ITEM.match(body) else "paragraph"


def structured(text: str, size: int, overlap: int) -> list[Chunk]:
    """Runs of lines of one kind (code fences, tables, lists, paragraphs); long ones are cut at lines."""
    blocks: list[tuple[str, int, list[str]]] = []
    fenced = False
    closed = True
    for at, line in _lines(text):
        fence = line.lstrip().startswith("```")
        if fence and not fenced:
            blocks.append(("code", at, [line]))
            fenced, closed = True, False
        elif fenced:
            blocks[-1][2].append(line)
            if fence:
                fenced, closed = False, True
        elif not line.strip():
            if not closed:
                blocks[-1][2].append(line)
        else:
            label = _line_label(line)
            if closed or blocks[-1][0] != label:
                blocks.append((label, at, []))
                closed = False
            blocks[-1][2].append(line)
    out: list[Chunk] = []
    for label, at, lines in blocks:
        body = "\n".join(lines)
        if body.strip():
            spans = [(0, len(body))] if len(body) <= size else _spans(body, size, overlap, _cut_line)
            out += [(body[a:b], label, at + a) for a, b in spans]
    return out


def _packed(units: list[str], size: int) -> list[Chunk]:
    """Units joined by line feeds, as many as fit; a unit that is too long stands alone."""
    out: list[Chunk] = []
    held: list[str] = []
    used = at = 0
    for unit in units:
        if held and used + len(unit) + 1 > size:
            body = "\n".join(held)
            out.append((body, "text", at))
            at, held, used = at + len(body) + 1, [], 0
        held.append(unit)
        used += len(unit) + 1
    if held:
        out.append(("\n".join(held), "text", at))
    return out


def log(text: str, size: int, overlap: int) -> list[Chunk]:
    """Whole entries, which start at time stamps; without a stamp in the first 20 lines, lines."""
    lines = text.split("\n")
    if not text.strip() and len(lines) == 1:
        return []
    if not any(map(_STAMP.match, lines[:20])):
        return _packed(lines, size)
    entries: list[list[str]] = []
    for line in lines:
        if not entries or _STAMP.match(line):
            entries.append([])
        entries[-1].append(line)
    return _packed(["\n".join(e) for e in entries], size)


def table(text: str, size: int, overlap: int) -> list[Chunk]:
    """Whole rows under the repeated header line."""
    first, _, rest = text.partition("\n")
    has_header = first.startswith("Columns:")
    prefix = f"{first}\n---\n" if has_header else ""
    rows = [r for r in (rest if has_header else text).split("\n") if r.strip()]
    at = len(first) + 1 if has_header else 0
    out: list[Chunk] = []
    held: list[str] = []
    used = len(prefix)
    for row in [*rows, None]:
        if held and (row is None or used + len(row) + 1 > size):
            out.append((prefix + "\n".join(held), "table", at))
            at += sum(len(r) + 1 for r in held)
            held, used = [], len(prefix)
        if row is not None:
            held.append(row)
            used += len(row) + 1
    return out


CHUNKERS = {"fixed": fixed, "markdown": markdown, "structured": structured, "log": log, "table": table}


def strategy(path: Column) -> Column:
    """The chunker that suits a file name."""
    ext = extension(path)
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("pdf", "docx", "pptx", "txt"), "structured").otherwise("fixed")


#: Texts of a batch whose chunks are Python objects at once.
PIECE = 64


def chunks_of(name: str, size: int = SIZE, overlap: int = OVERLAP):
    """A function of a text column to its chunks."""
    chunk = CHUNKERS[name]

    @F.arrow_udf(CHUNK)
    def run(text: pa.Array) -> pa.Array:
        kind, made = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("offset", pa.int32())])), []
        for at in range(0, len(text), PIECE):  # Python's objects of a piece go before those of the next come
            rows = [[{"text": t, "label": lab, "offset": o} for t, lab, o in chunk(x, size, overlap)] if x else [] for x in text.slice(at, PIECE).to_pylist()]
            made.append(pa.array(rows, kind))
        return pa.concat_arrays(made) if made else pa.array([], kind)

    return run


def chunk(df: DataFrame, text_col: str, name: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``df`` without its text, with one row per chunk: chunk_no, text, label, offset."""
    others = [c for c in df.columns if c != text_col]
    made = df.select(*others, chunks_of(name, size, overlap)(F.col(text_col)).alias("__chunks"))
    return made.select(*others, F.posexplode("__chunks").alias("chunk_no", "__chunk")).select(*others, "chunk_no", "__chunk.*")
