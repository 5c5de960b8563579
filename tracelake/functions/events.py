"""Scalar rules of the journal as column expressions (inventory H)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of revision ids.
REVISION_NAMESPACE = "fe569b0d-f5dd-4de8-aa91-fc77bb4ddd21"


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def event_type(name: Column) -> Column:
    """H1: the type that an event's name stands for; unknown prefixes are phases. Null gives null."""
    return (
        F.when(name.isNull(), None)
        .when(name.startswith("invocation.") | name.startswith("node."), "state_change")
        .when(name.startswith("recovery."), "recovery")
        .when(name.startswith("wait."), "wait")
        .when(name.startswith("edge.") | name.startswith("routing."), "routing")
        .when(name.startswith("operator_call."), "operator_call")
        .otherwise("phase")
    )


def event_subject(kind: Column, payload: Column, execution_ids: Column, invocation_id: Column) -> Column:
    """H2: struct(subject_type, subject_id); the first rule that applies."""
    pair = lambda t, i: F.struct(F.lit(t).alias("subject_type"), i.alias("subject_id"))
    return (
        F.when((kind == "routing") & payload["edge_id"].isNotNull(), pair("edge", payload["edge_id"]))
        .when((kind == "operator_call") & payload["operator_call_id"].isNotNull(), pair("operator_call", payload["operator_call_id"]))
        .when((kind == "wait") & payload["wait_key"].isNotNull(), pair("wait", payload["wait_key"]))
        .when(kind == "recovery", pair("recovery", invocation_id))
        .when(F.size(execution_ids) > 0, pair("node", F.get(execution_ids, F.lit(0))))
        .when(payload["node_execution_id"].isNotNull(), pair("node", payload["node_execution_id"]))
        .when(payload["node_id"].isNotNull(), pair("node", payload["node_id"]))
        .otherwise(pair("invocation", invocation_id))
    )


def event_status(name: Column, state: Column) -> Column:
    """H3: the detail's state, else the last dotted part of the name, else null."""
    return F.coalesce(state, F.when(F.contains(name, F.lit(".")), last_part(name)))


def valid_user_event_type(value: Column) -> Column:
    """H4: whether the trimmed name is lower-case snake case."""
    return F.coalesce(F.trim(value).rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), F.lit(False))


def coerce_timestamp_ms(value: Column) -> Column:
    """H5: milliseconds of a JSON scalar: an integer as it is, a float cut, ISO text with Z, an offset or none (UTC).

    Booleans and all else give null, which callers report as errors. The session's time zone must be UTC.
    """
    text = F.trim(value, F.lit('"'))
    number, stamp = text.try_cast("double"), F.unix_millis(text.try_cast("timestamp"))
    return F.when(value.rlike(r"^-?[0-9]+$"), value.try_cast("long")).when(value.rlike(r"^-?[0-9]+\.[0-9]+$"), number.cast("long")).when(value.isin("true", "false"), None).when(text.rlike("^[0-9]{4}-"), stamp)


def scope_key(scope: Column) -> Column:
    """H6: `root`, or loop:iteration joined by slashes."""
    joined = F.array_join(F.transform(scope, lambda f: F.concat(f["loop_region_id"], F.lit(":"), f["iteration"].cast("string"))), "/")
    return F.when(F.coalesce(F.size(scope), F.lit(0)) <= 0, "root").otherwise(joined)


def instance_key(id_: Column, scope: Column) -> Column:
    """H6: the key of a node or edge in a scope: id, or id@scope."""
    return F.when(F.coalesce(F.size(scope), F.lit(0)) <= 0, id_).otherwise(F.concat(id_, F.lit("@"), scope_key(scope)))


node_instance_key = edge_occurrence_key = instance_key


def revision_id(workflow_id: Column, definition_hash: Column) -> Column:
    """H7: the name-based UUID (version 5) of the workflow and its definition's hash."""
    name = F.concat(F.unhex(F.lit(REVISION_NAMESPACE.replace("-", ""))), F.encode(workflow_id, "UTF-8"), F.unhex(F.lit("00")), F.encode(definition_hash, "UTF-8"))
    h = F.substring(F.sha1(name), 1, 32)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    variant = F.substring(variant, -1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def definition_hash(canonical_json: Column) -> Column:
    """H7: SHA-256 of a definition's canonical JSON."""
    return F.sha2(canonical_json, 256)


def retry_delay_ms(mode: Column, delay: Column, multiplier: Column, most: Column, jitter: Column, i: Column) -> Column:
    """struct(low, high) of the delay before retry i; limited before jitter widens it downwards."""
    raw = F.when(mode == "fixed", delay.cast("double")).when(mode == "linear", delay * (1 + multiplier * i)).otherwise(delay * F.pow(multiplier, i))
    high = F.coalesce(F.least(raw, most), raw)
    low = F.when(jitter == "full", 0.0).when(jitter == "equal", high / 2).otherwise(high)
    return F.struct(low.alias("low"), high.alias("high"))


def attempt_reason(operator_index: Column, attempt_index: Column, recovery: Column) -> Column:
    """H12"""
    return F.when(attempt_index > 0, "retry").when(operator_index > 0, "fallback").when(recovery, "recovery").otherwise("normal")


def valid_tool_name(value: Column) -> Column:
    """H13"""
    return F.coalesce(value.rlike(r"\A[A-Za-z_][A-Za-z0-9_-]{0,63}\z"), F.lit(False))


def schema_name(value: Column) -> Column:
    """Other characters become underscores, a leading digit or dash gets a prefix, 64 characters at most."""
    clean = F.left(F.regexp_replace(value, "[^A-Za-z0-9_-]", "_"), F.lit(64))
    return F.when(clean.rlike("^[A-Za-z_]"), clean).otherwise(F.left(F.concat(F.lit("response_"), clean), F.lit(64)))


def event_tone(kind: Column) -> Column:
    """H14"""
    return F.when(kind.endswith("_failed") | kind.contains("error") | (kind == "message_aborted"), "error").otherwise("default")


def persistence_status(unserializable: Column, gap: Column, admitted: Column, durable: Column, expected: Column, pending: Column, backend_down: Column) -> Column:
    """H15"""
    return (
        F.when(unserializable, "unserializable")
        .when(gap, "degraded")
        .when(admitted & (durable >= expected) & ~pending, "durable")
        .when(backend_down, "degraded")
        .otherwise("pending")
    )


def group_paths(path: Column) -> Column:
    """Array of struct(path, id, parent, label): each prefix of a nested path, outermost first."""

    def one(n: Column) -> Column:
        head = F.slice(path, F.lit(1), n)
        return F.struct(head.alias("path"), F.array_join(head, "/").alias("id"), F.when(n > 1, F.array_join(F.slice(path, F.lit(1), n - 1), "/")).alias("parent"), F.element_at(path, n).alias("label"))

    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), one))
