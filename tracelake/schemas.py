"""Declared schemas of the journal. Payloads are parsed with these and never inferred."""

from __future__ import annotations

#: The journal's tables and columns.
TABLES = {
    "workflow_versions": "id string, workflow_id string, workflow_version string, ir_version string, compiler_version string, definition_hash string, definition_json string, created_at_ms bigint",
    "sessions": "id string, workflow_id string, workflow_revision_id string, session_key string, current_invocation_id string, context_json string, created_at_ms bigint, updated_at_ms bigint",
    "invocations": "id string, session_id string, workflow_version_id string, entry_node_id string, state string, execution_mode string, event_mode string, durable_sequence bigint, input_json string, result_json string, error_json string, genesis_state_json string, created_at_ms bigint, updated_at_ms bigint",
    "runtime_events": "id string, invocation_id string, sequence bigint, schema_version int, event_type string, event_name string, subject_type string, subject_id string, occurred_at_ms bigint, elapsed_ns bigint, status string, timing_json string, payload_json string, input_json string, output_json string, operations_json string",
    "user_events": "id string, session_id string, invocation_id string, sequence bigint, schema_version int, type string, data_json string, node_id string, workflow_path_json string, node_execution_id string, operator_call_id string, occurred_at_ms bigint",
    "runtime_recovery_states": "invocation_id string, event_sequence bigint, state_json string, updated_at_ms bigint",
    "artifacts": "id string, owner_invocation_id string, kind string, storage string, uri string, media_type string, encoding string, size_bytes bigint, sha256 string, payload_blob binary, metadata_json string, created_at_ms bigint",
}

#: The fields that payloads of all events together can have.
PAYLOAD = (
    "node_id string, node_execution_id string, node_instance_key string, state string, edge_id string, source_execution_id string, target_node_id string, selected boolean, "
    "operator_call_id string, operator_id string, operator_ids array<string>, kind string, reason string, streaming boolean, stream_chunk_count bigint, "
    "error struct<code string, message string, detail string>, "
    "summary struct<call_count bigint, attempt_count bigint, success_count bigint, failure_count bigint, cancelled_count bigint, retry_count bigint, fallback_count bigint, "
    "total_duration_ns bigint, min_duration_ns bigint, max_duration_ns bigint, peak_parallelism bigint, streaming_call_count bigint, stream_chunk_count bigint>, "
    "wait_key string, wait_keys array<string>, waits array<struct<wait_key string, node_execution_id string, node_id string, wait_type string, payload string>>, "
    "recovery_requeued array<string>, code string, message string"
)

#: States after which an execution or an invocation does not go on.
TERMINAL_NODE = ("completed", "failed", "cancelled", "interrupted", "skipped")
TERMINAL_INVOCATION = ("completed", "failed", "cancelled", "interrupted")
ACTIVE_INVOCATION = ("created", "running", "waiting")
DELTA_TYPES = ("message_delta", "reasoning_delta", "tool_call_delta")

#: One edit of a state tree.
OPERATIONS = "array<struct<op string, path array<string>, value string>>"
