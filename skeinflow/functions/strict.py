"""Strict documents: unknown keys, missing or empty values and wrong types, found on the VARIANT of a JSON text.

``from_json`` drops keys that it doesn't know and makes null of what doesn't fit; here both are violations, named
by place and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ISO date and time with its offset.
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$"


@dataclass(frozen=True)
class Field:
    """What a value may be: its type (STRING, BOOLEAN or ARRAY, of strings), whether the key may be missing, the
    value null or empty, the values or the pattern it must be or have."""

    type: str = "STRING"
    optional: bool = False
    nullable: bool = False
    empty: bool = False
    values: tuple[str, ...] = ()
    pattern: str = ""


def _kind(v: Column) -> Column:
    """Type of a variant: OBJECT, ARRAY, STRING, BOOLEAN, VOID, ...; null for nothing at all."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _at(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _field_errors(v: Column, name: str, field: Field) -> Column:
    kind, text = _kind(_at(v, name)), _at(v, name, "string")
    bad = F.when(kind.isNull(), F.lit(None if field.optional else "missing")).when(kind == "VOID", F.lit(None if field.nullable else "null")).when(kind != field.type, "type")
    if field.type == "ARRAY":
        inner = _at(v, name, "array<variant>")
        bad = bad.when(F.exists(inner, lambda x: _kind(x) != "STRING"), "type").when(F.exists(inner, lambda x: x.cast("string") == ""), "empty")
    if field.type == "STRING":
        if not field.empty:
            bad = bad.when(text == "", "empty")
        if field.values:
            bad = bad.when(~text.isin(*field.values), "value")
        if field.pattern:
            bad = bad.when(~text.rlike(field.pattern), "value")
    return F.when(bad.isNotNull(), F.concat(F.lit(f"{name}: "), bad))


def _unknown(v: Column, known: list[str]) -> Column:
    extra = F.array_except(F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
    return F.transform(extra, lambda k: F.concat(k, F.lit(": unknown")))


def object_errors(v: Column, fields: dict[str, Field]) -> Column:
    """Violations of one object: array of 'key: reason'."""
    own = F.filter(F.array(*[_field_errors(v, name, f) for name, f in fields.items()]), lambda e: e.isNotNull())
    return F.when(_kind(v) != "OBJECT", F.array(F.lit("type"))).otherwise(F.concat(own, _unknown(v, list(fields))))


def document_errors(raw: Column, parts: dict[str, dict[str, Field]]) -> Column:
    """Violations of a JSON text whose root has some of the parts, each an array of objects with the fields: array
    of 'part: key: reason', or of 'json' or 'type' for the whole."""
    v = F.try_parse_json(raw)

    def of_part(part: str, fields: dict[str, Field]) -> Column:
        kind = _kind(_at(v, part))
        rows = F.coalesce(_at(v, part, "array<variant>"), F.array().cast("array<variant>"))
        inner = F.transform(F.flatten(F.transform(rows, lambda row: object_errors(row, fields))), lambda e: F.concat(F.lit(f"{part}: "), e))
        return F.when(kind.isNotNull() & (kind != "ARRAY"), F.array(F.lit(f"{part}: type"))).otherwise(inner)

    found = [_unknown(v, list(parts)), *[of_part(part, fields) for part, fields in parts.items()]]
    return F.when(v.isNull(), F.array(F.lit("json"))).when(_kind(v) != "OBJECT", F.array(F.lit("type"))).otherwise(F.array_distinct(F.concat(*found)))
