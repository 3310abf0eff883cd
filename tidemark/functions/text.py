"""Text functions as Column expressions: normalisation, tokens, sentences, hashes, redaction."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no topic.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by",
    "for", "from", "had", "has", "have", "if", "in", "into", "is", "it", "its",
    "of", "on", "or", "that", "the", "their", "then", "there", "these", "this",
    "to", "was", "were", "will", "with", "within", "without", "you", "your",
]

# Latin letters with marks and the letters they are made of, by rule from their decompositions.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def normalize_text(text: Column) -> Column:
    """NFC, line feeds, single spaces, at most one blank line, no white space at the ends."""
    steps = [(r"\r\n?", "\n"), (r"\t", " "), (r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")]
    out = nfc(text)
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    return out


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    # Matches only what isn't a single space already: most texts have few such places.
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def fold(text: Column) -> Column:
    """Lower case, without the marks of Latin letters."""
    return F.translate(F.lower(text), "".join(_MARKED), _PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return sentences_of_line(squeeze(text))


def sentences_of_line(flat: Column) -> Column:
    """Sentences of a text that is in single spaces already."""
    parts = F.split(flat, r"(?<=[.!?]) ")
    # By a lambda of one parameter: given F.trim itself, transform would pass the sentence's number as the characters to trim.
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def first_sentence_of_line(flat: Column) -> Column:
    """The first of ``sentences_of_line``, null if there is none; what follows isn't looked at."""
    one = lambda s: let(F.regexp_extract(s, r"(?s)^.*?[.!?](?= )", 0), lambda x: F.when(x != "", x).when(s != "", s))
    return let(flat, one)


def n_sentences_of_line(flat: Column) -> Column:
    """The number of ``sentences_of_line``: none is empty there, as no two spaces meet."""
    return F.when(flat == "", 0).otherwise(F.regexp_count(flat, F.lit("[.!?] ")) + 1)


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three being dots where something was cut."""
    return let(squeeze(text), lambda t: F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))))


def dedup_key(text: Column, title: Column) -> Column:
    return dedup_key_of_line(squeeze(text), title)


def dedup_key_of_line(flat: Column, title: Column) -> Column:
    """The key of a text that is in single spaces already, and so on one line."""
    body = F.regexp_replace(F.regexp_replace(F.lower(flat), r"^#+\s*", ""), r"(?=\d)(?<![A-Za-z0-9_])\d+[.)]\s+", "")
    head = F.regexp_replace(F.lower(squeeze(title)), r"^\d+[.)]\s+", "")
    return F.concat_ws("\n", squeeze(head), squeeze(body))


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def chunk_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(doc_id: Column, doc_version: Column, offset: Column, text_hash: Column) -> Column:
    return sha(doc_id, doc_version, offset.cast("string"), text_hash)


#: What stands before a secret, and the secret.
SECRETS = (
    r"(?i)(Bearer\s+)[^\s\"']+",
    r"(?i)((?:token|api_key|secret|password|authorization)\s*[:=]\s*[\"']?)[^\s\"',}]+",
    r"(?i)(\"(?:token|api_key|secret|password)\"\s*:\s*\")[^\"]+",
)


def redact(text: Column) -> Column:
    """Bearer tokens and the values of secret-named keys as ``***REDACTED***``."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "$1***REDACTED***")
    return text


#: Content type by file extension.
CONTENT_TYPES = {
    "txt": "txt", "md": "md", "markdown": "md", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx",
    "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "yaml": "yaml", "yml": "yaml", "html": "html",
    "htm": "html", "rtf": "rtf", "sql": "sql", "log": "log", "eml": "eml",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def content_type(path: Column) -> Column:
    """Null for extensions that no extractor reads."""
    pairs = [F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


#: How log lines begin.
TIMESTAMPS = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"^\[\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}",
    r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"^\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}",
)


def starts_entry(line: Column) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in TIMESTAMPS))
