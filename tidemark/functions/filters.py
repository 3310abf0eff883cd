"""Compiles filter documents to predicates.

A document maps a field to a value (equality), a list (any of), null (no constraint) or a mapping of
operators; all fields and all operators of a field must hold. Comparison is typed: a number never
equals a string. A missing field fails everything but ``$ne`` and ``$nin``, an unknown operator
always fails, and a document that is no mapping constrains nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDER = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


@dataclass(frozen=True)
class Field:
    """A metadata field: its column, and the kind of its values (number, string or boolean)."""

    column: Column
    kind: str


def kind_of(value: Any) -> str | None:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else None


def _equals(field: Field, value: Any) -> Column:
    """Null where the field is missing, which a filter takes as false; wrapped in nothing, so that scans can use it."""
    return field.column == F.lit(value) if kind_of(value) == field.kind else F.lit(False)


def _any_of(field: Field, values: Any) -> Column:
    fit = [v for v in values if kind_of(v) == field.kind] if isinstance(values, (list, tuple)) else []
    return field.column.isin(fit) if fit else F.lit(False)


def _operator(field: Field, name: str, value: Any) -> Column:
    if name in _ORDER:
        if kind_of(value) != field.kind or field.kind == "boolean":
            return F.lit(False)
        return getattr(field.column, _ORDER[name])(F.lit(value))
    if name == "$ne":
        return field.column.isNull() | ~_equals(field, value)
    if name == "$in":
        return _any_of(field, value)
    if name == "$nin":
        return field.column.isNull() | ~_any_of(field, value)
    return F.lit(False)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _field(field: Field | None, condition: Any) -> Column:
    field = field or Field(F.lit(None).cast("string"), "missing")
    if condition is None:
        return F.lit(True)
    if isinstance(condition, dict):
        return _all([_operator(field, k, v) for k, v in condition.items()])
    if isinstance(condition, (list, tuple)):
        return _any_of(field, condition)
    return _equals(field, condition)


def compile_filter(document: Any, fields: dict[str, Field]) -> Column:
    """A predicate for ``DataFrame.where``, null standing for false; comparisons on plain columns reach the scan."""
    if not isinstance(document, dict):
        return F.lit(True)
    return _all([_field(fields.get(k), v) for k, v in document.items()])


# Open metadata: a JSON object per row, whose fields are not declared and whose kinds may differ from row to row.

_NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
_TYPES = {"number": "double", "string": "string", "boolean": "boolean"}


def _stored(metadata: Column, field: str) -> Column:
    """The field's value as a variant: null if missing, the variant null if it is JSON null."""
    if "'" in field:  # paths can't name it
        return F.try_variant_get(metadata, "$", "map<string,variant>")[field]
    return F.try_variant_get(metadata, f"$['{field}']", "variant")


def _as(value: Column, kind: str) -> Column:
    """The value where it is of that kind, else null: a number is never read as text."""
    stored = F.schema_of_variant(value)
    right = stored.rlike(_NUMBERS) if kind == "number" else stored == kind.upper()
    return F.when(right, F.try_variant_get(value, "$", _TYPES[kind]))


def _open_equals(value: Column, wanted: Any) -> Column:
    if wanted is None:
        return F.coalesce(F.is_variant_null(value), F.lit(False))
    kind = kind_of(wanted)
    if kind is None:
        return F.lit(False)
    return F.coalesce(_as(value, kind) == F.lit(float(wanted) if kind == "number" else wanted), F.lit(False))


def _open_any(value: Column, wanted: Any) -> Column:
    parts = [_open_equals(value, v) for v in wanted] if isinstance(wanted, (list, tuple)) else []
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _open_operator(value: Column, name: str, wanted: Any) -> Column:
    if name in _ORDER:
        kind = kind_of(wanted)
        if kind not in ("number", "string"):
            return F.lit(False)
        return F.coalesce(getattr(_as(value, kind), _ORDER[name])(F.lit(float(wanted) if kind == "number" else wanted)), F.lit(False))
    if name == "$ne":
        return ~_open_equals(value, wanted)
    if name == "$in":
        return _open_any(value, wanted)
    if name == "$nin":
        return ~_open_any(value, wanted)
    return F.lit(False)


def compile_open_filter(document: Any, metadata: Column) -> Column:
    """A predicate over metadata given as JSON text, by the kind that each row stores: true or false, never null.

    Rows whose metadata is null, no JSON or no object pass only a filter that is no mapping. Numbers compare as doubles, strings
    by their bytes; values of other kinds, lists and objects, equal nothing; a field is a top-level key.
    """
    if not isinstance(document, dict):
        return F.lit(True)
    variant = F.try_parse_json(metadata)
    parts = [F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))]
    for field, condition in document.items():
        if condition is None:
            continue
        value = _stored(variant, field)
        if isinstance(condition, dict):
            parts += [_open_operator(value, k, v) for k, v in condition.items()]
        else:
            parts.append(_open_any(value, condition) if isinstance(condition, (list, tuple)) else _open_equals(value, condition))
    return _all(parts)


def _scalars(values: Any) -> bool:
    return isinstance(values, (list, tuple)) and all(kind_of(v) in ("number", "string") for v in values)


def _fits(name: str, value: Any) -> bool:
    if name in _ORDER:
        return kind_of(value) in ("number", "string")
    if name == "$ne":
        return value is None or kind_of(value) is not None
    return _scalars(value) if name in ("$in", "$nin") else True


def filter_errors(document: Any) -> list[str]:
    """What a caller should hear about a filter document before it is compiled; nothing if it is well formed.

    Unknown operators are well formed, though no row passes them.
    """
    if not isinstance(document, dict):
        return ["a filter is a mapping"]
    found = []
    for field, condition in document.items():
        if not isinstance(field, str):
            found.append(f"{field!r}: a field name is a string")
        elif isinstance(condition, dict):
            found += [f"{field}.{op}: unfit value" for op, value in condition.items() if not _fits(op, value)]
        elif not (condition is None or kind_of(condition) or _scalars(condition)):
            found.append(f"{field}: unfit value")
    return found


def cli_filter(source: str | None = None, content_type: str | None = None, label: str | None = None, known_types: tuple[str, ...] = ()) -> dict:
    """The filter document of the command-line options; an unknown content type is an error."""
    if content_type is not None and known_types and content_type not in known_types:
        raise ValueError(f"unknown content type {content_type}")
    found = {"source_uri": source, "content_type": content_type, "chunk_label": label}
    return {k: v for k, v in found.items() if v is not None}
