"""Queries of the projection operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import projection as P
from ..sources.adapters import EVENTS_SQL, runtime_events
from .registry import query

WITH = f"WITH {EVENTS_SQL}"

EXEC_SQL = """
node_ev AS (SELECT * FROM ev WHERE event_name LIKE 'node.%'),
d1a AS (
  SELECT invocation_id, execution_id, min(sequence) AS first_event_sequence, max(sequence) AS last_event_sequence,
    arg_max(ms, sequence) FILTER (event_name = 'node.running') AS started_at_ms,
    arg_max(struct_pack(n := node, s := status, e := node_error, m := ms, el := elapsed_ns), sequence) AS l
  FROM node_ev WHERE execution_id IS NOT NULL GROUP BY 1, 2),
d1 AS (
  SELECT invocation_id, execution_id, l.n AS node_id, first_event_sequence, last_event_sequence, l.s AS state, l.e AS error_code, started_at_ms,
    CASE WHEN l.s IN ('completed','failed','cancelled','interrupted','skipped') THEN l.m END AS ended_at_ms, l.el AS elapsed_ns,
    CAST(row_number() OVER (PARTITION BY invocation_id, l.n ORDER BY first_event_sequence, execution_id) AS BIGINT) AS ordinal
  FROM d1a)"""

CALLS_SQL = f"""{EXEC_SQL},
cc AS (SELECT ev.*, d1.node_id AS own_node FROM ev JOIN d1 USING (invocation_id, execution_id) WHERE event_name = 'operator_call.completed' AND ev.sequence > d1.first_event_sequence),
cl AS (
  SELECT invocation_id, execution_id, own_node, call_id, count(*) AS n, count(*) FILTER (call_state <> 'completed') AS f, count(*) FILTER (reason = 'retry') AS r,
    count(*) FILTER (reason = 'fallback') AS b, count(*) FILTER (is_timeout) AS t, max(sequence) AS upto,
    arg_max(struct_pack(kind := kind, k := k, op := operator_id, reason := reason, st := call_state, ms := ms, el := elapsed_ns), sequence) AS l
  FROM cc GROUP BY 1, 2, 3, 4),
d4 AS (
  SELECT invocation_id, execution_id, own_node, CAST(sum(n) AS BIGINT) AS operator_call_count, CAST(sum(f) AS BIGINT) AS failed_operator_call_count, CAST(sum(r) AS BIGINT) AS retry_count,
    CAST(sum(b) AS BIGINT) AS fallback_count, CAST(sum(t) AS BIGINT) AS timeout_count,
    CAST(sum(CASE WHEN l.kind = 'map' THEN l.k%9 ELSE 0 END) AS BIGINT) AS parallel_call_count,
    CAST(sum(CASE WHEN l.kind = 'map' THEN l.k%2 WHEN l.k%4=0 THEN 1 ELSE 0 END) AS BIGINT) AS streaming_call_count,
    CAST(sum(CASE WHEN l.kind = 'map' THEN l.k%5 ELSE l.k%6 END) AS BIGINT) AS stream_chunk_count,
    arg_max(l.kind, upto) AS latest_operator_kind, max(upto) AS last_call_sequence
  FROM cl GROUP BY 1, 2, 3)"""


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prepare(runtime_events(spark, sf_dir))


def with_code(df: DataFrame, json: str, code: str) -> DataFrame:
    """Errors compare by their code."""
    return df.withColumn(code, F.get_json_object(json, "$.code")).drop(json)


@query(f"{WITH}, {EXEC_SQL} SELECT * FROM d1")
def d1_node_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_code(P.project_node_executions(prepared(spark, sf_dir)), "error", "error_code").drop("timing_json")


@query(f"""{WITH}, {CALLS_SQL},
seen AS (SELECT invocation_id, node AS node_id, count(*) FILTER (event_name = 'node.skipped') AS skipped_count, arg_max(instance_key, sequence) FILTER (event_name = 'node.skipped') AS latest_skipped_instance_key,
  max(sequence) AS latest_occurrence_sequence, arg_max(struct_pack(s := status, e := node_error, el := elapsed_ns), sequence) AS l FROM node_ev GROUP BY 1, 2),
top AS (SELECT invocation_id, node_id, count(*) AS execution_count, arg_max(struct_pack(x := execution_id, s := state, e := error_code, el := elapsed_ns), ordinal) AS x FROM d1 GROUP BY 1, 2),
tt AS (SELECT invocation_id, own_node AS node_id, arg_max(execution_id, last_call_sequence) AS touched, max(last_call_sequence) AS upto FROM d4 GROUP BY 1, 2),
j AS (SELECT seen.*, execution_count, x, CASE WHEN tt.upto > latest_occurrence_sequence THEN tt.touched ELSE x.x END AS counted FROM seen LEFT JOIN top USING (invocation_id, node_id) LEFT JOIN tt USING (invocation_id, node_id))
SELECT j.invocation_id, node_id, CASE WHEN x IS NOT NULL THEN x.s ELSE l.s END AS state, l.s AS latest_occurrence_state, latest_occurrence_sequence, latest_skipped_instance_key, x.x AS latest_execution_id,
  COALESCE(execution_count, 0) AS execution_count, skipped_count, CASE WHEN x IS NOT NULL THEN x.e ELSE l.e END AS latest_error_code, CASE WHEN x IS NOT NULL THEN x.el ELSE l.el END AS latest_elapsed_ns,
  COALESCE(operator_call_count, 0) AS operator_call_count, COALESCE(failed_operator_call_count, 0) AS failed_operator_call_count, COALESCE(retry_count, 0) AS retry_count, COALESCE(fallback_count, 0) AS fallback_count,
  COALESCE(timeout_count, 0) AS timeout_count, COALESCE(parallel_call_count, 0) AS parallel_call_count, COALESCE(streaming_call_count, 0) AS streaming_call_count, COALESCE(stream_chunk_count, 0) AS stream_chunk_count, latest_operator_kind
FROM j LEFT JOIN d4 ON d4.invocation_id = j.invocation_id AND d4.execution_id = j.counted""")
def d2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_code(P.project_nodes(prepared(spark, sf_dir)), "latest_error", "latest_error_code").drop("latest_timing")


@query(f"""{WITH}, a AS (SELECT invocation_id, edge_id, count(*) AS evaluation_count, count(*) FILTER (selected) AS selected_count, count(*) FILTER (edge_state = 'skipped') AS skipped_count,
  count(*) FILTER (edge_state = 'failed') AS failed_count, max(sequence) AS latest_evaluation_sequence, arg_max(struct_pack(s := edge_state, y := selected, x := exec0, k := k, el := elapsed_ns), sequence) AS l
  FROM ev WHERE event_name = 'edge.evaluated' GROUP BY 1, 2)
SELECT invocation_id, edge_id, CASE WHEN failed_count > 0 THEN 'failed' WHEN selected_count > 0 THEN 'selected' ELSE l.s END AS state, l.s AS latest_state, latest_evaluation_sequence, selected_count > 0 AS selected, l.y AS latest_selected,
  evaluation_count, selected_count, skipped_count, failed_count, l.x AS source_execution_id, 'n' || (l.k+1)%4 AS target_node_id, 'r' || l.k%3 AS reason, l.el AS elapsed_ns FROM a""")
def d3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.project_edges(prepared(spark, sf_dir))


@query(f"{WITH}, {CALLS_SQL} SELECT * EXCLUDE (own_node) FROM d4")
def d4_operator_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.operator_rollup(prepared(spark, sf_dir))


@query(f"{WITH} SELECT invocation_id, call_id, arg_max(call_state, sequence) AS state FROM ev WHERE call_id IS NOT NULL GROUP BY 1, 2")
def d5_operator_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.operator_states(prepared(spark, sf_dir))


@query(f"""{WITH}, w AS (SELECT invocation_id, wait_key, arg_max(struct_pack(o := event_name = 'wait.created', m := ms, k := k, n := node), sequence) AS l FROM ev WHERE event_name LIKE 'wait.%' GROUP BY 1, 2)
SELECT invocation_id, wait_key, l.m AS created_at_ms, CASE WHEN l.k%4 >= 2 THEN 'human' END AS wait_type, CASE WHEN l.k%4 >= 2 THEN l.n END AS node_id FROM w WHERE l.o""")
def d6_active_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.active_waits(prepared(spark, sf_dir))


STATES_SQL = """st AS (SELECT invocation_id, COALESCE(arg_max(CASE WHEN event_name = 'wait.created' THEN 'waiting' ELSE status END, sequence) FILTER (event_name LIKE 'invocation.%' OR event_name = 'wait.created'), 'created') AS state,
  max(sequence) AS through_sequence FROM ev GROUP BY 1)"""


@query(f"{WITH}, {STATES_SQL} SELECT * FROM st")
def d7_invocation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.invocation_states(prepared(spark, sf_dir))


@query(f"{WITH}, a AS (SELECT invocation_id, max_by(struct_pack(n := event_name, s := subject_id, t := status, m := ms, e := elapsed_ns), sequence) AS l FROM ev WHERE event_type = 'phase' GROUP BY 1) SELECT invocation_id, l.n AS event_name, l.s AS subject_id, l.t AS status, l.m AS occurred_at_ms, l.e AS elapsed_ns FROM a")
def d8_latest_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest_phase(prepared(spark, sf_dir))


@query(f"{WITH}, g AS (SELECT invocation_id, sequence, COALESCE(lag(sequence) OVER (PARTITION BY invocation_id ORDER BY sequence), 0) + 1 AS expected FROM ev WHERE event_id % 97 <> 0) SELECT invocation_id, min_by(expected, sequence) AS expected, min(sequence) AS got FROM g WHERE sequence <> expected GROUP BY 1")
def e2_journal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.journal_gaps(runtime_events(spark, sf_dir).filter(F.substring("id", 2, 20).cast("long") % 97 != 0))


@query(f"{WITH}, {EXEC_SQL} SELECT invocation_id, node_id, execution_id, ordinal FROM d1")
def e1_execution_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.project_node_executions(prepared(spark, sf_dir)).select("invocation_id", "node_id", "execution_id", "ordinal")


INVOCATIONS_SQL = "inv AS (SELECT invocation_id, min(ms) - 5 AS created_at_ms FROM ev GROUP BY 1)"


def invocation_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime_events(spark, sf_dir).groupBy(F.col("invocation_id").alias("id")).agg((F.min("occurred_at_ms") - 5).alias("created_at_ms"))


@query(f"""{WITH}, {EXEC_SQL}, {INVOCATIONS_SQL} SELECT invocation_id, execution_id, node_id, state, COALESCE(started_at_ms, created_at_ms) AS start_ms, ended_at_ms AS end_ms, elapsed_ns/1e6 AS duration_ms, first_event_sequence AS span_order FROM d1 JOIN inv USING (invocation_id)""")
def n1_timeline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.timeline_spans(P.project_node_executions(prepared(spark, sf_dir)), invocation_starts(spark, sf_dir))


@query(f"{WITH}, {CALLS_SQL} SELECT invocation_id, execution_id, call_id, l.ms - COALESCE(l.el, 0)/1e6 AS start_ms, l.ms AS end_ms, CAST(row_number() OVER (PARTITION BY invocation_id, execution_id ORDER BY upto) AS BIGINT) AS call_number FROM cl")
def n2_operator_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.operator_spans(P.operator_calls(prepared(spark, sf_dir)))


@query(f"""{WITH}, {EXEC_SQL}, {INVOCATIONS_SQL}, a AS (SELECT invocation_id, max(ms) AS e FROM ev GROUP BY 1), b AS (SELECT invocation_id, max(COALESCE(ended_at_ms, started_at_ms, created_at_ms)) AS s FROM d1 JOIN inv USING (invocation_id) GROUP BY 1)
SELECT invocation_id, created_at_ms AS start_ms, greatest(created_at_ms + 1, e, s) AS end_ms FROM inv LEFT JOIN a USING (invocation_id) LEFT JOIN b USING (invocation_id)""")
def n3_timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = invocation_starts(spark, sf_dir)
    spans = P.timeline_spans(P.project_node_executions(prepared(spark, sf_dir)), starts)
    return P.timeline_range(spans, runtime_events(spark, sf_dir), starts)


@query(f"""{WITH}, t AS (SELECT invocation_id, sequence, elapsed_ns, 'queue' AS name, CAST(t_queue AS DOUBLE) AS ns FROM ev UNION ALL SELECT invocation_id, sequence, elapsed_ns, 'run', CAST(t_run AS DOUBLE) FROM ev)
SELECT invocation_id, sequence, name, ns, ns / greatest(CAST(COALESCE(elapsed_ns, 0) AS DOUBLE), max(ns) OVER (PARTITION BY invocation_id, sequence), 1.0) AS share, CAST(row_number() OVER (PARTITION BY invocation_id, sequence ORDER BY ns DESC, name) AS BIGINT) AS rank FROM t""")
def n4_timing_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.timing_breakdown(runtime_events(spark, sf_dir))


@query(f"""{WITH}, {CALLS_SQL} SELECT invocation_id, execution_id, call_id, upto AS sequence, l.op AS operator_id, l.kind AS kind, l.reason AS reason, l.st AS state, l.ms AS occurred_at_ms, l.el AS elapsed_ns FROM cl""")
def d4_operator_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.operator_calls(prepared(spark, sf_dir))


@query(f"""{WITH}, {EXEC_SQL}, o AS (SELECT invocation_id, execution_id, arg_max('{{"v":' || k || '}}', sequence) AS output_json FROM ev WHERE event_name = 'node.completed' GROUP BY 1, 2),
l AS (SELECT invocation_id, node_id, arg_max(struct_pack(x := execution_id, s := state), ordinal) AS x FROM d1 WHERE node_id IN ('n2', 'n3') GROUP BY 1, 2),
r AS (SELECT l.invocation_id, node_id, COALESCE(output_json, 'null') AS v FROM l LEFT JOIN o ON o.invocation_id = l.invocation_id AND o.execution_id = x.x WHERE x.s = 'completed')
SELECT invocation_id, CASE WHEN count(*) = 1 THEN '{{"output":' || min(v) || '}}' ELSE '{{"outputs":{{' || string_agg('"' || node_id || '":' || v, ',' ORDER BY node_id) || '}}}}' END AS result_json FROM r GROUP BY 1""")
def d15_invocation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = runtime_events(spark, sf_dir)
    done = events.filter("event_name = 'node.completed'").withColumn("execution_id", F.get_json_object("payload_json", "$.node_execution_id"))
    outputs = done.groupBy("invocation_id", "execution_id").agg(F.max_by("output_json", "sequence").alias("output_json"))
    exits = events.select(F.explode(F.array(F.lit("n2"), F.lit("n3"))).alias("node_id")).distinct()
    return P.invocation_results(P.project_node_executions(P.prepare(events)), exits, outputs)
