"""Data-parallel workflow operators (inventory L1-L9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut


def route(df: DataFrame, edges: dict[str, Column | None]) -> tuple[DataFrame, DataFrame]:
    """L1: (routed rows with edge_id, decisions with edge_id and state). Every edge whose condition holds is taken, an edge
    without one always; a null condition counts as failed, and a row with a failed condition goes nowhere."""
    states = [F.struct(F.lit(e).alias("edge_id"), F.when(F.lit(True) if c is None else c, "selected").when(c.isNull() if c is not None else F.lit(False), "failed").otherwise("skipped").alias("state")) for e, c in edges.items()]
    decided = df.withColumn("_d", F.array(*states))
    failed = F.exists("_d", lambda d: d["state"] == "failed")
    decisions = decided.select(*df.columns, F.explode("_d").alias("d")).select(*df.columns, "d.edge_id", "d.state")
    taken = decided.withColumn("_t", F.when(failed, F.array().cast("array<string>")).otherwise(F.transform(F.filter("_d", lambda d: d["state"] == "selected"), lambda d: d["edge_id"])))
    return taken.select(*df.columns, F.explode("_t").alias("edge_id")), decisions


def fan_in(branches: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """L2: the input of each row after a fan-in, as JSON: the value of the only source, an object of several by source name,
    or the invocation's input if nothing came in. branches (key, source, value JSON); inputs (key, value JSON)."""
    met = branches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source", "value"))).alias("b"))
    many = F.concat(F.lit("{"), F.array_join(F.transform("b", lambda x: F.concat(F.lit('"'), x["source"], F.lit('":'), F.coalesce(x["value"], F.lit("null")))), ","), F.lit("}"))
    rows = inputs.select(key, F.col("value").alias("_input")).join(met, key, "left")
    return rows.select(key, F.when(F.size("b") > 1, many).when(F.size("b") == 1, F.get("b", F.lit(0))["value"]).otherwise(F.col("_input")).alias("value"))


def map_items(df: DataFrame, key: str, items: str, mappings: bool = False) -> tuple[DataFrame, DataFrame]:
    """L3: (items, errors): a row for each element of a JSON array column, with item_index and idempotency key `key:index`.
    A value that isn't an array, or with `mappings` an element that isn't an object, fails the row before any call."""
    parsed = F.from_json(items, "array<string>")
    shape = F.substring(F.trim(items), 1, 1)
    odd = F.exists(parsed, lambda x: F.coalesce(~F.trim(x).startswith("{"), F.lit(True))) if mappings else F.lit(False)
    error = F.when(F.coalesce(shape, F.lit("")) != "[", "not_iterable").when(parsed.isNull(), "not_iterable").when(odd, "item_not_mapping")
    rows = df.withColumn("_e", error)
    errors = rows.filter("_e IS NOT NULL").select(key, F.col("_e").alias("error"))
    good = rows.filter("_e IS NULL").select(*df.columns, F.posexplode(parsed).alias("item_index", "item"))
    return good.withColumn("idempotency_key", F.concat_ws(":", F.col(key).cast("string"), F.col("item_index").cast("string"))), errors


def map_aggregate(items: DataFrame, key: str, aggregate: Callable[[Column], Column] | None = None) -> DataFrame:
    """L4: (key, output, error) of the items (key, item_index, output, error): any failed item fails the whole; else the outputs
    in order as an array, or what `aggregate` makes of it."""
    out = items.groupBy(key).agg(F.min(F.when(F.col("error").isNotNull(), F.struct("item_index", "error"))).alias("bad"), F.array_sort(F.collect_list(F.struct("item_index", "output"))).alias("o"))
    outputs = F.transform("o", lambda x: x["output"])
    return out.select(key, F.when(F.col("bad").isNull(), outputs if aggregate is None else aggregate(outputs)).alias("output"), F.col("bad.error").alias("error"))


def replicate(df: DataFrame, count: int) -> DataFrame:
    """Each row `count` times with item_index; its outputs go through map_aggregate, or a chooser such as max_by."""
    return df.withColumn("item_index", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count > 0 else df.withColumn("item_index", F.lit(0)).filter(F.lit(False))


ATTEMPT = T.StructType([T.StructField("operator_index", T.IntegerType()), T.StructField("attempt_index", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("error", T.StringType())])


def call_with_retry(df: DataFrame, value: str, functions: list[Callable[[str], str]], max_attempts: int, budget: int | None = None, mapping: Callable[[str], str] | None = None) -> DataFrame:
    """Df with `output`, `error` and `attempts`: each function is tried up to `max_attempts` times on the value, whatever it
    raises, then the next one; attempts count against `budget` together. `mapping` makes the functions' input of the
    value before the first attempt: an error of it is final, with no attempt."""
    schema = T.StructType([*df.schema.fields, T.StructField("output", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.ArrayType(ATTEMPT))])

    def one(x) -> tuple:
        tried: list[dict] = []
        try:
            x = mapping(x) if mapping else x
        except Exception as e:  # noqa: BLE001  the caller's function
            return None, str(e), tried
        for i, f in enumerate(functions):
            for n in range(max_attempts):
                if budget is not None and len(tried) >= budget:
                    return None, "attempt_budget_exhausted", tried
                reason = "retry" if n else "fallback" if i else "normal"
                try:
                    out = f(x)
                except Exception as e:  # noqa: BLE001  any failure of the caller's function is an attempt
                    tried.append({"operator_index": i, "attempt_index": n, "reason": reason, "error": str(e)})
                else:
                    return out, None, [*tried, {"operator_index": i, "attempt_index": n, "reason": reason, "error": None}]
        return None, tried[-1]["error"] if tried else "no_operator", tried

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(x) for x in b[value]]
            yield b.assign(output=[m[0] for m in made], error=[m[1] for m in made], attempts=[m[2] for m in made])

    return df.mapInPandas(run, schema)


def bounded_loop(df: DataFrame, body: Callable[[DataFrame], DataFrame], done: Column, max_rounds: int) -> DataFrame:
    """Df after as many rounds of `body` as each row needs until `done`, with `rounds` and `error`. The limit is checked
    before a round: a row that is not done after `max_rounds` of them fails. Rows that are done leave the loop; a round's
    rest is written to the shared folder."""
    active, out = df.withColumn("rounds", F.lit(0)), None
    for n in range(max_rounds + 1):
        if n:
            active = cut(body(active.drop("rounds")).withColumn("rounds", F.lit(n)))
        ok = F.coalesce(done, F.lit(False)) if n else F.lit(False)  # the body runs at least once
        ended = active.filter(ok).withColumn("error", F.lit(None).cast("string"))
        out = ended if out is None else out.unionByName(ended)
        active = active.filter(~ok)
        if n and active.isEmpty():
            return out
    return out.unionByName(active.withColumn("error", F.lit("LOOP_LIMIT")))


def validate_rows(df: DataFrame, column: str, fields: dict[str, tuple[str, bool]], allow_extra: bool = False) -> DataFrame:
    """Df with `problems` of a JSON object column against {name: (type, required)}; types string, integer, number, boolean,
    object, array. Values are never cast: "1" is no integer."""
    shapes = {"string": '^"', "integer": r"^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$", "boolean": "^(true|false)$", "object": r"^\{", "array": r"^\["}
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    raw = F.from_json(column, "map<string,variant>")
    problems = [F.when(F.json_object_keys(column).isNull(), "not_an_object")]
    for name, (kind, required) in fields.items():
        there = F.array_contains(keys, name)
        text = F.to_json(F.element_at(raw, F.lit(name)))
        null = F.coalesce(text == "null", F.lit(True))
        if required:
            problems.append(F.when(~there & F.json_object_keys(column).isNotNull(), f"missing:{name}"))
        problems.append(F.when(there & (null | ~text.rlike(shapes[kind])), f"type:{name}"))
    if not allow_extra:
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, fields))))
        problems.append(F.when(F.size(extra) > 0, F.concat(F.lit("extra:"), F.array_join(extra, ","))))
    return df.withColumn("problems", F.array_compact(F.array(*problems)))


def emit_user_events(df: DataFrame, key: str, mappings: list[tuple[str, Column, Column]]) -> DataFrame:
    """(key, position, type, data): events in the order of the mappings (type, data, failed). Null data is no event; where
    `failed` holds there is a `user_event_mapping_failed` event instead, and the others stay."""
    events = [F.when(F.coalesce(failed, F.lit(False)), F.struct(F.lit("user_event_mapping_failed").alias("type"), F.to_json(F.struct(F.lit(kind).alias("type"))).alias("data"))).when(data.isNotNull(), F.struct(F.lit(kind).alias("type"), data.alias("data"))) for kind, data, failed in mappings]
    return df.select(key, F.posexplode(F.array_compact(F.array(*events))).alias("position", "e")).select(key, F.col("position").cast("long").alias("position"), "e.type", "e.data")
