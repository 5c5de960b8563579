"""Agent conversations from user events and model records (inventory K1-K11, D16, D18, E11, L11)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.json_schema import json_problems
from ..schemas import DELTA_TYPES

#: The event types that belong to a conversation, and the request fields that options can't override.
KNOWN_TYPES = (*DELTA_TYPES, "message_completed", "tool_call_requested", "tool_result", "agent_output", "message_aborted", "agent_failed")
RESERVED_OPTIONS = ("model", "messages", "tools", "tool_choice", "response_format", "temperature", "max_completion_tokens", "stream", "stream_options", "extra_body")
ROLES = ("system", "user", "assistant", "tool")
CALL = "array<struct<tool_call_id string, name string, raw_arguments string>>"
RESULT = "array<struct<tool_call_id string, output string, error string>>"


def field(path: str) -> Column:
    return F.get_json_object("data_json", f"$.{path}")


def with_blocks(user_events: DataFrame) -> DataFrame:
    """K3: events with block_kind and block_key. A react block is a workflow path that isn't empty or has ever told an
    output or a failure; other known events make a block for each call; each unknown event is a block of its own."""
    path = F.coalesce(F.nullif(F.array_join(F.from_json("workflow_path_json", "array<string>"), "/"), F.lit("")), F.lit("<root>"))
    rows = user_events.withColumn("_path", path)
    told = F.max(F.col("type").isin("agent_output", "agent_failed").cast("int")).over(W.partitionBy("invocation_id", "_path")) == 1
    react = (F.col("_path") != "<root>") | told
    known = F.col("type").isin(*KNOWN_TYPES)
    kind = F.when(~known, "custom").when(react, "react").otherwise("llm")
    key = F.when(~known, F.col("id")).when(react, F.concat(F.lit("react:"), "_path")).otherwise(F.concat(F.lit("llm:"), F.coalesce("operator_call_id", "node_execution_id", "node_id")))
    return rows.withColumn("block_kind", kind).withColumn("block_key", key).drop("_path")


def activity_blocks(user_events: DataFrame) -> DataFrame:
    """K3: the blocks of each invocation with their first sequence, number of events, and output."""
    out = F.col("type") == "agent_output"
    return with_blocks(user_events).groupBy("invocation_id", "block_kind", "block_key").agg(
        F.min("sequence").alias("first_sequence"), F.count("*").alias("events"),
        F.max_by(F.when(out, field("output")), F.when(out, F.col("sequence"))).alias("output"), F.max(F.when(out, F.col("sequence"))).alias("output_sequence"),
    )


def messages(user_events: DataFrame, keys: tuple[str, ...] = ("invocation_id",)) -> DataFrame:
    """K1: a row for each message of a call. Deltas are joined in order; a completed message replaces what was there;
    reasoning is that of the deltas, else of the completed message; a tool request's reasoning replaces it."""
    kind = F.col("type")
    asks = (kind == "tool_call_requested") & field("reasoning_content").isNotNull()
    rows = user_events.filter(kind.isin("reasoning_delta", "message_delta", "message_completed") | asks)
    rows = rows.withColumn("message_key", F.coalesce("operator_call_id", "node_execution_id", F.concat(F.lit("message:"), F.col("sequence").cast("string"))))
    rows = rows.withColumn("_delta", field("delta")).withColumn("_content", field("message.content")).withColumn("_thought", F.coalesce(field("message.reasoning_content"), field("reasoning_content")))
    pairs = lambda c, when: F.array_sort(F.collect_list(F.when(when & c.isNotNull(), F.struct(F.col("sequence").alias("s"), c.alias("v")))))
    seq = F.col("sequence")
    message, done, thought = kind == "message_delta", kind == "message_completed", (kind == "reasoning_delta") & (F.length("_delta") > 0)
    out = rows.groupBy(*keys, "message_key").agg(
        pairs(F.col("_delta"), message).alias("texts"), F.max(F.when(done & F.col("_content").isNotNull(), F.struct(seq.alias("s"), F.col("_content").alias("v")))).alias("whole"),
        pairs(F.col("_delta"), thought).alias("thoughts"), F.max(F.when(asks, F.struct(seq.alias("s"), F.col("_thought").alias("v")))).alias("asked"),
        F.min(F.when(done & (F.length("_thought") > 0), F.struct(seq.alias("s"), F.col("_thought").alias("v")))).alias("told"),
        F.min("sequence").alias("first_sequence"), F.min(F.when(message | done, seq)).alias("message_sequence"), F.min(F.when((kind == "reasoning_delta") | asks, seq)).alias("_thought_sequence"),
        F.bool_or(done).alias("completed"), F.max(F.when(message | done, F.col("occurred_at_ms"))).alias("occurred_at_ms"),
    )
    text = lambda parts, after: F.array_join(F.transform(F.filter(parts, lambda x: x["s"] > after), lambda x: x["v"]), "")
    content = F.concat(F.coalesce("whole.v", F.lit("")), text(F.col("texts"), F.coalesce("whole.s", F.lit(-1))))
    first = F.coalesce(F.get("thoughts", F.lit(0))["s"], F.lit(1 << 60))
    by_message = F.col("told").isNotNull() & (F.col("told.s") < first)
    base = F.when(F.col("asked").isNotNull(), F.col("asked")).when(by_message, F.col("told"))
    reasoning = F.concat(F.coalesce(base["v"], F.lit("")), text(F.col("thoughts"), F.coalesce(base["s"], F.lit(-1))))
    at = F.least("_thought_sequence", F.when(by_message & F.col("asked").isNull(), F.col("told.s")))
    return out.select(*keys, "message_key", "first_sequence", "message_sequence", F.when(F.length(reasoning) > 0, at).alias("reasoning_sequence"), content.alias("content"), reasoning.alias("reasoning"), "completed", "occurred_at_ms")


def tool_calls(user_events: DataFrame, keys: tuple[str, ...] = ("invocation_id",)) -> DataFrame:
    """K2: a row for each tool call. Deltas of one call and index take the id that appears on them or in the request of that
    call and index; results are matched by id in the invocation, and a result without a request makes a row too."""
    kind = F.col("type")
    scope = F.coalesce("operator_call_id", "node_execution_id")
    d = user_events.filter(kind == "tool_call_delta").select(*keys, "sequence", scope.alias("_scope"), F.coalesce(field("tool_call_index").cast("int"), F.lit(0)).alias("_i"), field("tool_call_id").alias("_id"), field("tool_name").alias("_name"), field("arguments_delta").alias("_args"))
    d = d.groupBy(*keys, "_scope", "_i").agg(F.min_by("_id", F.when(F.col("_id").isNotNull(), F.col("sequence"))).alias("delta_id"), F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("sequence"))).alias("delta_name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", F.coalesce("_args", F.lit("")).alias("v")))), lambda x: x["v"]), "").alias("delta_args"), F.min("sequence").alias("delta_sequence"))
    r = user_events.filter(kind == "tool_call_requested").select(*keys, "sequence", "occurred_at_ms", scope.alias("_scope"), F.posexplode(F.from_json(field("calls"), CALL)).alias("_i", "c"))
    r = r.select(*keys, "_scope", "_i", F.coalesce(F.nullif("c.tool_call_id", F.lit("")), F.concat_ws(":", F.col("sequence").cast("string"), F.col("_i").cast("string"))).alias("id"), F.col("c.name").alias("name"), F.nullif("c.raw_arguments", F.lit("")).alias("args"), F.col("occurred_at_ms").alias("requested_at_ms"), F.col("sequence").alias("request_sequence"))
    met = r.join(d, [*keys, "_scope", "_i"], "full")
    met = met.select(*keys, F.coalesce("id", "delta_id", F.concat(F.lit("index:"), F.coalesce("_scope", F.lit("")), F.lit(":"), F.col("_i").cast("string"))).alias("tool_key"), F.coalesce("name", "delta_name").alias("name"), F.coalesce("args", "delta_args", F.lit("")).alias("raw_arguments"), "requested_at_ms", F.least("request_sequence", "delta_sequence").alias("first_sequence"))
    met = met.groupBy(*keys, "tool_key").agg(F.min_by(F.struct("name", "raw_arguments", "requested_at_ms"), "first_sequence").alias("m"), F.min("first_sequence").alias("first_sequence"))
    res = user_events.filter(kind == "tool_result").select(*keys, "sequence", "occurred_at_ms", F.explode(F.from_json(field("results"), RESULT)).alias("x"))
    res = res.groupBy(*keys, F.col("x.tool_call_id").alias("tool_key")).agg(F.max_by(F.struct("x.output", "x.error", "occurred_at_ms"), "sequence").alias("r"), F.min("sequence").alias("result_sequence"))
    out = met.join(res, [*keys, "tool_key"], "full")
    return out.select(*keys, "tool_key", "m.name", F.coalesce("m.raw_arguments", F.lit("")).alias("raw_arguments"), "m.requested_at_ms", F.col("r.output").alias("output"), F.col("r.error").alias("error"), F.col("r.occurred_at_ms").alias("completed_at_ms"), F.coalesce("first_sequence", "result_sequence").alias("first_sequence"))


def activity_items(user_events: DataFrame) -> DataFrame:
    """K4: thinking, message, tool and generic items of each block; messages are hidden once the block has an output."""
    rows = with_blocks(user_events).filter("block_kind <> 'custom'")
    keys = ("invocation_id", "block_key")
    told = rows.filter("type = 'agent_output'").select(*keys).distinct()
    m = messages(rows, keys)
    item = lambda df, kind, key, seq: df.select(*keys, F.lit(kind).alias("kind"), key.alias("item_key"), seq.alias("sequence"))
    thinking = item(m.filter("reasoning <> '' AND reasoning_sequence IS NOT NULL"), "thinking", F.concat(F.lit("thinking:"), "message_key"), F.col("reasoning_sequence"))
    shown = item(m.filter("content <> '' AND message_sequence IS NOT NULL").join(told, list(keys), "left_anti"), "message", F.concat(F.lit("message:"), "message_key"), F.col("message_sequence"))
    tools = item(tool_calls(rows, keys), "tool", F.concat(F.lit("tool:"), "tool_key"), F.col("first_sequence"))
    other = item(rows.filter(F.col("type").isin("message_aborted", "agent_failed")), "generic", F.col("id"), F.col("sequence"))
    return thinking.union(shown).union(tools).union(other)


def unread_keys(user_events: DataFrame, read_through: DataFrame) -> DataFrame:
    """(invocation_id, key): the logical keys past each invocation's cursor (invocation_id, read_through; 0 where there is none)."""
    n = F.col("id")
    numbered = lambda path, kind: F.transform(F.from_json(field(path), CALL if path == "calls" else RESULT), lambda c, i: F.concat(F.lit(kind), F.coalesce(F.nullif(c["tool_call_id"], F.lit("")), F.concat(n, F.lit(":"), i.cast("string")))))
    kind = F.col("type")
    keys = (
        F.when(kind.isin(*DELTA_TYPES), F.array().cast("array<string>"))
        .when(kind == "tool_call_requested", numbered("calls", "tool_call:"))
        .when(kind == "tool_result", numbered("results", "tool_result:"))
        .when(kind == "message_completed", F.array(F.concat(F.lit("message:"), F.coalesce("operator_call_id", "node_execution_id", "id"))))
        .when(kind == "agent_output", F.array(F.concat(F.lit("agent_output:"), "invocation_id")))
        .otherwise(F.array(F.concat(F.lit("event:"), n)))
    )
    rows = user_events.join(read_through, "invocation_id", "left").filter(F.col("sequence") > F.coalesce("read_through", F.lit(0)))
    return rows.select("invocation_id", F.explode(keys).alias("key"))


def unread_counts(user_events: DataFrame, read_through: DataFrame) -> DataFrame:
    """Distinct logical keys past each invocation's cursor."""
    return unread_keys(user_events, read_through).groupBy("invocation_id").agg(F.countDistinct("key").alias("unread"))


def session_history(messages: DataFrame) -> DataFrame:
    """The message list of each (session, workflow path) in order; `<root>` for an empty path. messages (session_id,
    workflow_path array, seq, role, content)."""
    key = F.coalesce(F.nullif(F.array_join("workflow_path", "/"), F.lit("")), F.lit("<root>"))
    out = messages.groupBy("session_id", key.alias("path_key")).agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("m"))
    return out.select("session_id", "path_key", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))


def prepare_requests(turns: DataFrame, instructions: str) -> DataFrame:
    """K5: the request of each call of a conversation. turns (conversation_id, call_index, kind, messages array of
    struct(role, content), history array, has_tools, provider_options, mode). The first call has the instructions, history
    and its messages; later ones all of the call before and theirs; options and mode are those of the first."""
    w = W.partitionBy("conversation_id").orderBy("call_index")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.row_number().over(w) == 1
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(instructions).alias("content")))
    own = F.when(first, F.concat(system, F.coalesce("history", F.array().cast(turns.schema["messages"].dataType)), "messages")).otherwise(F.col("messages"))
    rows = turns.withColumn("_own", own)
    return rows.select(
        "conversation_id", "call_index", F.flatten(F.collect_list("_own").over(so_far)).alias("messages"),
        F.when((F.col("kind") == "output_repair") | ~F.col("has_tools"), "none").otherwise("auto").alias("tool_choice"),
        F.first("provider_options").over(so_far).alias("provider_options"), F.first("mode").over(so_far).alias("mode"),
    )


def normalize_initial(value: Column) -> Column:
    """K6: struct(messages JSON, error) of an input as JSON: text is a user message, an object gives its `messages` or its
    `input` as one, a list is taken as messages."""
    user = lambda text: F.to_json(F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))))
    text = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    shape = F.substring(F.trim(value), 1, 1)
    given, asked = F.get_json_object(value, "$.messages"), F.get_json_object(value, "$.input")
    out = F.when(shape == '"', user(text)).when(shape == "[", value).when(shape == "{", F.coalesce(given, F.when(asked.isNotNull(), user(asked))))
    return F.struct(out.alias("messages"), F.when(out.isNull(), "input_or_messages_required").alias("error"))


def validate_messages(messages: DataFrame) -> DataFrame:
    """K7: messages (role, reasoning_content, provider_options map) with the problems found."""
    role = F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown_role")
    reasoning = F.when(F.col("reasoning_content").isNotNull() & ~F.col("role").eqNullSafe("assistant"), "reasoning_on_other_role")
    overlap = F.array_sort(F.array_intersect(F.coalesce(F.map_keys("provider_options"), F.array().cast("array<string>")), F.array(*map(F.lit, RESERVED_OPTIONS))))
    options = F.when(F.size(overlap) > 0, F.concat(F.lit("reserved_options:"), F.array_join(overlap, ",")))
    return messages.withColumn("problems", F.array_compact(F.array(role, reasoning, options)))


def validate_tool_calls(calls: DataFrame, tools: DataFrame, max_repairs: int, schemas: dict[str, dict] | None = None) -> DataFrame:
    """K8: calls (conversation_id, response_index, call_index, id, name, raw_arguments) with the first error that applies, and
    placeholders for empty ids and names; `exhausted` once a response fails after `max_repairs` failed ones. tools (name,
    required array): arguments must be a JSON object that has all required keys, and must fit the tool's JSON schema where
    `schemas` has one by its name (types, enums, extra keys, nested objects and lists; see json_schema). Tools are few
    and are broadcast: dealt by name, all calls of a tool would be one task's."""
    rows = calls.join(F.broadcast(tools.withColumnRenamed("name", "_tool").withColumn("_known", F.lit(True))), F.col("name") == F.col("_tool"), "left")
    parsed = F.from_json("raw_arguments", "map<string,string>")
    bad = parsed.isNull() | F.exists(F.coalesce("required", F.array().cast("array<string>")), lambda k: ~F.coalesce(F.map_contains_key(parsed, k), F.lit(False)))
    for name, schema in (schemas or {}).items():
        bad = bad | F.coalesce((F.col("name") == name) & (F.size(json_problems("raw_arguments", schema)) > 0), F.lit(False))
    error = F.when(F.trim("id") == "", "empty_id").when(F.trim("name") == "", "empty_name").when(F.col("_known").isNull(), "unknown_tool").when(bad, "invalid_arguments")
    rows = rows.withColumn("error", error)
    own = W.partitionBy("conversation_id", "response_index")
    rows = rows.withColumn("_failed", F.max(F.col("error").isNotNull().cast("int")).over(own)).withColumn("_first", (F.row_number().over(own.orderBy("call_index")) == 1).cast("int"))
    before = F.sum(F.col("_failed") * F.col("_first")).over(W.partitionBy("conversation_id").orderBy("response_index").rangeBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("previous_failures", F.coalesce(before, F.lit(0)).cast("long"))
    return rows.select(
        "conversation_id", "response_index", "call_index", F.when(F.trim("id") == "", F.concat(F.lit("invalid_tool_call_"), F.col("call_index").cast("string"))).otherwise(F.col("id")).alias("id"),
        F.when(F.trim("name") == "", "__invalid_tool__").otherwise(F.col("name")).alias("name"), "error", "previous_failures", ((F.col("_failed") == 1) & (F.col("previous_failures") >= max_repairs)).alias("exhausted"),
    )


def tool_result_messages(responses: DataFrame, calls: DataFrame, executions: DataFrame) -> DataFrame:
    """K9: the message list of each response: the assistant's, then one tool message for each call in order, with its
    output, or its error as JSON. responses (response_id, content); calls (response_id, call_index, id, name, raw_arguments,
    error); executions (response_id, call_index, output, error_type, error_message)."""
    rows = calls.join(executions, ["response_id", "call_index"], "left")
    failed = F.to_json(F.struct(F.struct(F.lit("tool_arguments_validation_error").alias("type"), F.col("name").alias("tool"), F.col("error").alias("message"), "raw_arguments").alias("error")))
    broken = F.to_json(F.struct(F.struct(F.lit("tool_execution_error").alias("type"), F.col("name").alias("tool"), F.col("error_type").alias("exception_type"), F.col("error_message").alias("message")).alias("error")))
    content = F.when(F.col("error").isNotNull(), failed).when(F.col("error_type").isNotNull(), broken).otherwise(F.col("output"))
    tool = rows.select("response_id", F.col("call_index").cast("long").alias("i"), F.lit("tool").alias("role"), F.col("id").alias("tool_call_id"), content.alias("content"))
    first = responses.select("response_id", F.lit(-1).cast("long").alias("i"), F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("tool_call_id"), "content")
    out = first.union(tool).groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "tool_call_id", "content"))).alias("m"))
    return out.select("response_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["tool_call_id"].alias("tool_call_id"), x["content"].alias("content"))).alias("messages"))


def validate_outputs(responses: DataFrame, schema: str | None, max_repairs: int) -> DataFrame:
    """Responses (conversation_id, response_index, content) with `status`: valid, repair, or exhausted once more than
    `max_repairs` have failed. Without a schema all are valid; with one the content must be JSON with all its fields."""
    if schema is None:
        return responses.withColumn("status", F.lit("valid")).withColumn("value", F.col("content"))
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    parsed = F.from_json("content", StructType.fromDDL(f"{schema}, _bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = F.col("content").isNotNull() & parsed["_bad"].isNull()
    for f in fields.fields:
        good = good & parsed[f.name].isNotNull()
    rows = responses.withColumn("_ok", F.coalesce(good, F.lit(False)))
    w = W.partitionBy("conversation_id").orderBy("response_index").rowsBetween(W.unboundedPreceding, -1)
    failures = F.coalesce(F.sum((~F.col("_ok")).cast("int")).over(w), F.lit(0))
    rows = rows.withColumn("status", F.when(F.col("_ok"), "valid").when(failures >= max_repairs, "exhausted").otherwise("repair"))
    return rows.withColumn("value", F.when(F.col("_ok"), F.col("content"))).drop("_ok")


def decode_usage(raw: Column) -> Column:
    """struct(input_tokens, output_tokens, total_tokens) of a provider's usage object; what isn't an integer is null."""
    one = lambda name: F.when(F.get_json_object(raw, f"$.usage.{name}").rlike("^-?[0-9]+$"), F.get_json_object(raw, f"$.usage.{name}").try_cast("long"))
    return F.struct(one("prompt_tokens").alias("input_tokens"), one("completion_tokens").alias("output_tokens"), one("total_tokens").alias("total_tokens"))


def coalesce_deltas(chunks: DataFrame, chars: int = 32, delay_ms: int = 8) -> DataFrame:
    """Adjacent deltas of a call merged while they are compatible, until they have `chars` characters or the first is
    `delay_ms` old; a completed chunk flushes. chunks (call_id, seq, at_ms, type, text, tool_index, tool_id, tool_name).

    The merge starts anew after each flush, so it is a fold over the ordered chunks of a call, which end with the call. A
    task reads its calls in order and holds what one merge has so far, so calls of any length take linear time. Chunks
    without a type or time merge with none; a null text counts as empty where it is merged.
    """
    columns = ("call_id", "seq", "at_ms", "type", "text", "tool_index", "tool_id", "tool_name")
    kinds = ("string", "bigint", "bigint", "string", "string", "int", "string", "string")
    rows = chunks.select(*[F.col(c).cast(k).alias(c) for c, k in zip(columns, kinds, strict=True)]).repartition("call_id").sortWithinPartitions(*columns)

    def fits(a: dict, c: dict) -> bool:
        free = lambda name: a[name] is None or c[name] is None or a[name] == c[name]
        tool = c["type"] != "tool_call_delta" or (a["tool_index"] is not None and a["tool_index"] == c["tool_index"] and free("tool_id") and free("tool_name"))
        return c["type"] is not None and a["type"] == c["type"] and tool and None not in (a["at_ms"], c["at_ms"]) and c["at_ms"] - a["at_ms"] < delay_ms

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, position, pending, size, out = None, 0, None, 0, []

        def flush() -> None:
            nonlocal pending, position
            if pending:
                parts = pending["text"]
                out.append((call, position, pending["type"], parts[0] if len(parts) == 1 else "".join(x or "" for x in parts), pending["seq"]))
                pending, position = None, position + 1

        def told() -> pa.RecordBatch:
            names = ("call_id", "position", "type", "text", "first_seq")
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

        for b in batches:
            for c in b.to_pylist():
                if c["call_id"] != call:
                    flush()
                    call, position = c["call_id"], 0
                if c["type"] == "completed" or not (pending and fits(pending, c)):
                    flush()
                    pending, size = {**c, "text": [c["text"]]}, len(c["text"] or "")
                else:
                    pending["text"].append(c["text"])
                    pending["tool_id"], pending["tool_name"] = pending["tool_id"] or c["tool_id"], pending["tool_name"] or c["tool_name"]
                    size += len(c["text"] or "")
                if size >= chars or c["type"] == "completed":
                    flush()
            yield told()
        flush()
        yield told()

    return rows.mapInArrow(merged, "call_id string, position bigint, type string, text string, first_seq bigint")


def stream_reduce(chunks: DataFrame) -> DataFrame:
    """The output of each call's completed chunk; none or several of them are an error."""
    done = F.col("type") == "completed"
    out = chunks.groupBy("call_id").agg(F.count_if(done).alias("n"), F.max_by(F.when(done, F.col("text")), F.when(done, F.col("seq"))).alias("output"))
    error = F.when(F.col("n") == 0, "no_completed_chunk").when(F.col("n") > 1, "several_completed_chunks")
    return out.select("call_id", F.when(F.col("n") == 1, F.col("output")).alias("output"), error.alias("error"))
