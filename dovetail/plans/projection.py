"""Output shapes that a small configuration declares, compiled to one select over canonical profiles.

Paths: a, a.b, a[0], a[], a[].b.  They are resolved against the schema when the plan is made, so Catalyst prunes the
columns that a configuration does not use; unknown paths are null.  A row's failure is data: its `error` column.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dovetail.functions.normalize import phone, skills

DEFAULT = {
    "fields": [
        {"path": "candidate_id", "type": "string", "required": True}, {"path": "full_name", "type": "string", "required": True},
        {"path": "emails", "type": "string[]"}, {"path": "phones", "type": "string[]"}, {"path": "location", "type": "object"},
        {"path": "links", "type": "object"}, {"path": "headline", "type": "string"}, {"path": "years_experience", "type": "number"},
        {"path": "skills", "type": "object[]"}, {"path": "experience", "type": "object[]"}, {"path": "education", "type": "object[]"},
    ],
    "include_confidence": True, "include_provenance": True, "on_missing": "null",
}
MISSING_POLICIES = ("null", "omit", "error")


@dataclass(frozen=True)
class Field:
    path: str
    source: str
    type: str
    required: bool
    normalize: str


@dataclass(frozen=True)
class Config:
    fields: tuple[Field, ...]
    confidence: bool
    provenance: bool
    on_missing: str


def parse(raw: str | dict | None) -> Config:
    """A configuration from JSON text or a dict; blank text and None are the default; other text that isn't JSON raises ValueError."""
    if raw is None or isinstance(raw, str) and not raw.strip():
        raw = DEFAULT
    elif isinstance(raw, str):
        raw = json.loads(raw)
    if not isinstance(raw, dict):
        raise ValueError("a configuration is a JSON object")
    fields = tuple(Field(f["path"], f.get("from", f["path"]), f.get("type", "string"), f.get("required", False), re.sub("[.-]", "", f.get("normalize") or "").upper()) for f in raw.get("fields", []))
    return Config(fields, raw.get("include_confidence", True), raw.get("include_provenance", True), raw.get("on_missing", "null"))


def confidence_key(path: str) -> str:
    """The canonical field that a path's confidence belongs to."""
    return path.split("[", 1)[0].rstrip(".")


Typed = tuple[Column, T.DataType] | None


def present(value: Column, kind: T.DataType) -> Column:
    return value.isNotNull() & (value != "") if isinstance(kind, T.StringType) else value.isNotNull()


def resolve(value: Column, kind: T.DataType, path: str) -> Typed:
    """What a path finds in a value of a type, with its type; None where the type has no such place."""
    if not path:
        return value, kind
    head = re.match(r"\[(\d*)\]\.?|([^.\[]+)\.?", path)
    rest = path[head.end() :]
    if head[2] is None:
        if not isinstance(kind, T.ArrayType):
            return None
        if head[1]:
            return resolve(F.get(value, F.lit(int(head[1]))), kind.elementType, rest)
        found: list[T.DataType] = []

        def inner(item: Column) -> Column:
            got = resolve(item, kind.elementType, rest)
            found[:] = [got[1]] if got else []
            return got[0] if got else F.lit(None).cast("string")

        if not rest:
            return value, kind
        items = F.transform(value, inner)
        if not found:
            return F.when(value.isNotNull(), F.array().cast("array<string>")), T.ArrayType(T.StringType())
        return F.filter(items, lambda x: present(x, found[0])), T.ArrayType(found[0])
    if isinstance(kind, T.StructType) and head[2] in kind.names:
        return resolve(value[head[2]], kind[head[2]].dataType, rest)
    if isinstance(kind, T.MapType):
        return resolve(value[head[2]], kind.valueType, rest)
    if isinstance(kind, T.ArrayType) and head[2].isdigit():
        return resolve(F.get(value, F.lit(int(head[2]))), kind.elementType, rest)
    return None


def text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else value.cast("string")


def coerced(value: Column, kind: T.DataType, wanted: str) -> tuple[Column, T.DataType, Column]:
    """The value as the wanted type, its type, and whether it can't be."""
    fine, strings = F.lit(False), T.ArrayType(T.StringType())
    if wanted == "string":
        return text(value, kind), T.StringType(), fine
    if wanted == "number":
        if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
            return F.lit(None).cast("double"), T.DoubleType(), value.isNotNull()
        number = value.try_cast("double")
        return number, T.DoubleType(), value.isNotNull() & number.isNull()
    if wanted == "string[]":
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda v: text(v, kind.elementType)), strings, fine
        return F.when(value.isNotNull(), F.array(text(value, kind))), strings, fine
    if wanted == "object[]" and not isinstance(kind, T.ArrayType):
        return F.when(value.isNotNull(), F.array(value)), T.ArrayType(kind), fine
    return value, kind, fine


def normalized(value: Column, field: Field) -> Column:
    if field.normalize == "E164" and field.type == "string":
        return F.coalesce(phone(value)["e164"], value)
    if field.normalize == "CANONICAL" and field.type == "string[]":
        return F.transform(skills(value), lambda s: s["name"])
    return value


def compiled(config: Config, schema: T.StructType) -> tuple[list[tuple[str, Column, Column | None]], Column]:
    """(name, value, when to leave it out) for each output key, in order; and the row's error."""
    out: list[tuple[str, Column, Column | None]] = []
    errors = []
    for f in config.fields:
        root = re.match(r"[^.\[]+", f.source)
        found: Typed = None
        if root and root[0] in schema.names:
            found = resolve(F.col(root[0]), schema[root[0]].dataType, f.source[root.end() :].lstrip("."))
        value, kind = found or (F.lit(None).cast("string"), T.StringType())
        missing = ~present(value, kind)
        new, kind, wrong = coerced(value, kind, f.type)
        empty = F.array().cast(kind) if isinstance(kind, T.ArrayType) and f.type in ("string[]", "object[]") else F.lit(None).cast(kind)
        absent = missing if config.on_missing == "omit" else None
        out.append((f.path, F.when(missing, empty).otherwise(normalized(new, f)), absent))
        if f.required and config.on_missing == "error":
            errors.append(F.when(missing, F.lit(f"Required field missing: {f.path}")))
        errors.append(F.when(wrong & ~missing, F.lit(f"Field {f.path} expected {f.type}")))
        if config.confidence:
            out.append((f"{f.path}_confidence", F.col("field_confidence")[confidence_key(f.source)], absent))
    if config.provenance:
        out.append(("provenance", F.transform("provenance", lambda p: F.struct(p["field"].alias("field"), p["source"].alias("source"), p["method"].alias("method"))), None))
    if config.confidence:
        wanted = {confidence_key(f.source) for f in config.fields} | {f.path for f in config.fields}
        out.append(("field_reasoning", F.map_filter("field_reasoning", lambda k, _: k.isin(*sorted(wanted)) if wanted else F.lit(False)), None))
        out.append(("overall_confidence", F.col("overall_confidence"), None))
    return out, F.coalesce(*errors) if errors else F.lit(None).cast("string")


def project(profiles: DataFrame, config: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """One typed column for each output key, and `error`; rows with an error have no valid output."""
    out, error = compiled(config, profiles.schema)
    return profiles.select(*keep, *[v.alias(k) for k, v, _ in out], error.alias("error"))


#: Keys of nested values that a JSON document leaves out where they are null.
OPTIONAL = ("best_match", "best_score", "notes", "candidate_values", "is_current")


def json_of(value: Column) -> Column:
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    bare = F.substring(whole, F.lit(6), F.char_length(whole) - 6)
    for key in OPTIONAL:
        bare = F.regexp_replace(bare, f',"{key}":null', "")
    return bare


def project_json(profiles: DataFrame, config: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's output as one JSON document, `error` beside it; keys that are to be omitted are left out."""
    out, error = compiled(config, profiles.schema)
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), json_of(v)) if gone is None else F.when(~gone, F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), json_of(v))) for k, v, gone in out]
    document = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>"), ","), F.lit("}"))
    return profiles.select(*keep, F.when(error.isNull(), document).alias("output"), error.alias("error"))
