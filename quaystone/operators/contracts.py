"""Validation against a subset of JSON Schema, compiled to columns.

A schema is a dict as JSON gives it. validate() makes one array column of
errors from it and the typed columns it describes, so a table is checked in one
projection, without Python. Known keywords: type, enum, const, pattern,
minimum, maximum, required, properties, patternProperties,
additionalProperties (false), minItems, maxItems, items, allOf, and if / then /
else with a description. Objects are structs, or maps whose keys are texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KIND = {
    "object": (T.StructType, T.MapType), "array": (T.ArrayType,), "string": (T.StringType,), "boolean": (T.BooleanType,),
    "number": (T.NumericType,), "null": (T.NullType,),
}


def _error(wrong: Column, path: Column, text: str) -> Column:
    """An array of one error, or of none."""
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.concat(path, F.lit(f": {text}")))).otherwise(F.array().cast("array<string>"))


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _shown(x) -> str:
    return "null" if x is None else str(x)


def errors(value: Column, kind: T.DataType, schema: dict, path: Column, nulls: frozenset = frozenset()) -> Column:
    """The errors of a value of a Spark type, as an array of texts. A field of
    a struct counts as absent where it is null, unless its schema allows null:
    then it is a null, also to the rules that speak of it. nulls: the names of
    such fields that an outer schema gives."""
    out: list[Column] = []
    if (names := schema.get("type")) is not None:
        names = names if isinstance(names, list) else [names]
        fits = any(isinstance(kind, _KIND[n]) and not (n == "number" and isinstance(kind, T.BooleanType)) for n in names)
        wrong = F.lit(False) if fits and "null" in names else value.isNull() if fits else value.isNotNull() if "null" in names else F.lit(True)
        out.append(_error(wrong, path, f"is no {' or '.join(names)}"))
    if "enum" in schema:
        listed = [x for x in schema["enum"] if x is not None]
        known = value.isin(*listed) if listed else F.lit(False)
        out.append(_error(F.when(value.isNull(), None not in schema["enum"]).otherwise(~known), path, f"is none of {', '.join(map(_shown, schema['enum']))}"))
    if "const" in schema:
        same = value.isNull() if schema["const"] is None else value.eqNullSafe(F.lit(schema["const"]))
        out.append(_error(~same, path, f"is not {_shown(schema['const'])}"))
    if "pattern" in schema and isinstance(kind, T.StringType):
        out.append(_error(~value.rlike(schema["pattern"]), path, f"does not match {schema['pattern']}"))
    if isinstance(kind, T.NumericType):
        if "minimum" in schema:
            out.append(_error(value < schema["minimum"], path, f"is below {schema['minimum']}"))
        if "maximum" in schema:
            out.append(_error(value > schema["maximum"], path, f"is above {schema['maximum']}"))
    if isinstance(kind, T.StructType):
        nulls = nulls | {n for n, of in schema.get("properties", {}).items() if _allows_null(of)}
        out.append(_of_struct(value, kind, schema, path, nulls))
    if isinstance(kind, T.MapType):
        out.append(_of_map(value, kind, schema, path))
    if isinstance(kind, T.ArrayType):
        if "minItems" in schema:
            out.append(_error(F.size(value) < schema["minItems"], path, f"has fewer than {schema['minItems']} items"))
        if "maxItems" in schema:
            out.append(_error(F.size(value) > schema["maxItems"], path, f"has more than {schema['maxItems']} items"))
        if "items" in schema:
            each = F.transform(value, lambda x, i: errors(x, kind.elementType, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            out.append(F.coalesce(F.flatten(each), F.array().cast("array<string>")))
    for rule in schema.get("allOf", []):
        if "if" not in rule:
            out.append(errors(value, kind, rule, path, nulls))
            continue
        holds = F.size(errors(value, kind, rule["if"], path, nulls)) == 0
        broken = lambda branch: F.size(errors(value, kind, rule[branch], path, nulls)) > 0 if branch in rule else F.lit(False)  # noqa: B023, E731
        out.append(_error(F.when(holds, broken("then")).otherwise(broken("else")), path, rule.get("description", "breaks a rule without a name")))
    return _all(out)


def _of_struct(value: Column, kind: T.StructType, schema: dict, path: Column, nulls: frozenset) -> Column:
    fields = {f.name: f.dataType for f in kind.fields}
    known = schema.get("properties", {})
    none = F.array().cast("array<string>")
    out = []
    for name in schema.get("required", []):
        absent = F.lit(True) if name not in fields else F.lit(False) if name in nulls else value.getField(name).isNull()
        out.append(_error(value.isNotNull() & absent, path, f"lacks {name}"))
    for name, of in fields.items():
        inner = value.getField(name)
        of_name = known[name] if name in known else _by_pattern(schema, name)
        if of_name is not None:
            absent = F.lit(False) if name in nulls else inner.isNull()
            out.append(F.when(value.isNull() | absent, none).otherwise(errors(inner, of, of_name, F.concat(path, F.lit(f".{name}")))))
        elif schema.get("additionalProperties", True) is False:
            out.append(_error(inner.isNotNull(), path, f"has unknown {name}"))
    return _all(out)


def _by_pattern(schema: dict, name: str) -> dict | None:
    """The schema of the first pattern that matches at the beginning of a name."""
    return next((of for pattern, of in schema.get("patternProperties", {}).items() if re.match(pattern, name)), None)


def _of_map(value: Column, kind: T.MapType, schema: dict, path: Column) -> Column:
    """The errors of a map: of the keys it lacks, and of each entry, in order
    of keys, by the schema of its name, else of the first pattern that its name
    begins with. An entry that is there with null is a null."""
    out = [_error(value.isNotNull() & ~F.coalesce(F.map_contains_key(value, F.lit(name)), F.lit(False)), path, f"lacks {name}") for name in schema.get("required", [])]
    named = [(lambda k, n=n: k == n, of) for n, of in schema.get("properties", {}).items()]
    named += [(lambda k, p=p: k.rlike(f"^(?:{p})"), of) for p, of in schema.get("patternProperties", {}).items()]

    def of_entry(entry: Column) -> Column:
        key, inner = entry["key"], entry["value"]
        at = F.concat(path, F.lit("."), key)
        unknown = F.array(F.concat(path, F.lit(": has unknown "), key))
        found = unknown if schema.get("additionalProperties", True) is False else F.array().cast("array<string>")
        for holds, of in reversed(named):
            found = F.when(holds(key), errors(inner, kind.valueType, of, at)).otherwise(found)
        return found

    if named or schema.get("additionalProperties", True) is False:
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out.append(F.coalesce(F.flatten(F.transform(entries, of_entry)), F.array().cast("array<string>")))
    return _all(out)


def _allows_null(schema: dict) -> bool:
    names = schema.get("type", [])
    return "null" in (names if isinstance(names, list) else [names]) or None in schema.get("enum", []) or ("const" in schema and schema["const"] is None)


def validate(rows: DataFrame, schema: dict, out: str = "errors") -> DataFrame:
    """rows with the errors of each against the schema of an object, whose
    properties are the columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.withColumn(out, errors(whole, rows.schema, schema, F.lit("$")))


def broken_rules(rows: DataFrame, schema: dict) -> DataFrame:
    """error, n: the errors of all rows, counted."""
    return validate(rows, schema, "_errors").select(F.explode("_errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))



# The contract of a result's flat entry.
ENTRY = {
    "type": "object",
    "required": ["category", "status", "review_reason", "has_defect", "defect_fields"],
    "properties": {
        "category": {"enum": ["BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "GENERAL", "SPAM"]},
        "status": {"enum": ["OK", "MISMATCH", "NEEDS_REVIEW"]},
        "review_reason": {"enum": ["wrong_doc_type", "missing_attachment", "unreadable", "missing_value", None]},
        "has_defect": {"type": "boolean"},
        "defect_fields": {"type": "array", "maxItems": 7, "items": {"enum": ["shipper", "consignee", "notify_party", "port_of_loading", "port_of_discharge", "container_count", "gross_weight_kg"]}},
    },
    "allOf": [
        {"description": "a review has a reason", "if": {"properties": {"status": {"const": "NEEDS_REVIEW"}}}, "then": {"properties": {"review_reason": {"type": "string"}}}, "else": {"properties": {"review_reason": {"const": None}}}},
        {"description": "a mismatch has defects", "if": {"properties": {"status": {"const": "MISMATCH"}}}, "then": {"properties": {"defect_fields": {"minItems": 1}}}, "else": {"properties": {"defect_fields": {"maxItems": 0}}}},
        {"description": "defects are told", "if": {"properties": {"has_defect": {"const": True}}}, "then": {"properties": {"defect_fields": {"minItems": 1}}}, "else": {"properties": {"defect_fields": {"maxItems": 0}}}},
    ],
}
