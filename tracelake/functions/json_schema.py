"""JSON schemas as column expressions (inventory K8, L8): a schema is compiled once, on the driver, to paths of a Variant."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By JSON type: what schema_of_variant tells of such a value.
SHAPES = {"string": "^STRING", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": "^(BIGINT|DECIMAL|DOUBLE)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def _none() -> Column:
    return F.array().cast("array<string>")


def value_problems(value: Column, schema: dict, at: str = "") -> Column:
    """The problems of a Variant against a schema, as texts `kind:path`, in the order of the schema. It takes type (a name or a
    list), enum, properties, required, additionalProperties (false or true) and items. A part whose type is wrong is one
    problem, and its inside isn't looked at. Values are never cast: "1" is no integer."""
    parts, where = [], at or "$"
    kinds = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type") or []
    fits = F.schema_of_variant(value).rlike("|".join(SHAPES[k] for k in kinds)) if kinds else F.lit(True)
    if "enum" in schema:
        listed = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]
        parts.append(F.when(~F.to_json(value).isin(*listed), F.array(F.lit(f"enum:{where}"))).otherwise(_none()))
    fields, required = schema.get("properties", {}), schema.get("required", [])
    if fields or required or schema.get("additionalProperties") is False:
        held = F.try_variant_get(value, "$", "map<string,variant>")
        there = lambda k: F.coalesce(F.map_contains_key(held, k), F.lit(False))
        own = [F.when(~there(k), F.array(F.lit(f"missing:{at}/{k}"))).otherwise(_none()) for k in required]
        own += [F.when(there(k), value_problems(F.element_at(held, F.lit(k)), s, f"{at}/{k}")).otherwise(_none()) for k, s in fields.items()]
        if schema.get("additionalProperties") is False:
            more = F.array_sort(F.array_except(F.map_keys(held), F.array(*map(F.lit, fields)) if fields else _none()))
            own.append(F.transform(more, lambda k: F.concat(F.lit(f"extra:{at}/"), k)))
        parts.append(F.when(held.isNotNull(), F.concat(*own)).otherwise(_none()))
    if "items" in schema:
        inner = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: value_problems(x, schema["items"], f"{at}/*")))
        parts.append(F.coalesce(F.array_distinct(inner), _none()))
    found = F.concat(*parts) if parts else _none()
    return F.when(value.isNull() | ~F.coalesce(fits, F.lit(False)), F.array(F.lit(f"type:{where}"))).otherwise(found)


def json_problems(text: str | Column, schema: dict) -> Column:
    """The problems of a JSON text; `no_json` if it isn't any. A null text is no JSON."""
    value = F.try_parse_json(text)
    return F.when(value.isNull(), F.array(F.lit("no_json"))).otherwise(value_problems(value, schema))
