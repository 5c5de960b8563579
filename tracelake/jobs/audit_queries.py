"""Queries of audits and scalar rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import events as H
from ..operators import audit as A
from ..operators import projection as P
from ..sources.adapters import JOURNAL_SQL, invocations, numbered_events, runtime_events, sessions
from ..sources.scratch import cut
from .projection_queries import EXEC_SQL, prepared
from .registry import query

WITH = f"WITH {JOURNAL_SQL}"
#: Attempts: the line items of an order, numbered by what tells them apart.
ATTEMPTS_SQL = """att AS (SELECT CAST(l_orderkey AS VARCHAR) AS execution_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS BIGINT) AS seq,
  'op' || l_suppkey%9 AS operator_id, l_linenumber, l_partkey, CASE l_linenumber%3 WHEN 1 THEN 'normal' WHEN 2 THEN 'retry' ELSE 'fallback' END AS reason, CASE WHEN l_returnflag = 'R' THEN 'E' || l_linenumber END AS error_code,
  CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 AS duration_ns, l_linestatus = 'O' AS streaming, CAST(l_quantity AS BIGINT) AS chunks,
  epoch_us(l_shipdate)//1000 AS started_at_ms, CASE WHEN l_returnflag <> 'A' THEN epoch_us(l_shipdate)//1000 + CAST(l_quantity AS BIGINT) * 86400000 END AS ended_at_ms FROM lineitem)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    m, start = F.col("l_linenumber") % 3, F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("execution_id"), F.row_number().over(w).cast("long").alias("seq"), F.concat(F.lit("op"), (F.col("l_suppkey") % 9).cast("string")).alias("operator_id"), "l_linenumber", "l_partkey",
        F.when(m == 1, "normal").when(m == 2, "retry").otherwise("fallback").alias("reason"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("E"), F.col("l_linenumber").cast("string"))).alias("error_code"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 1000).alias("duration_ns"), (F.col("l_linestatus") == "O").alias("streaming"), F.col("l_quantity").cast("long").alias("chunks"),
        start.alias("started_at_ms"), F.when(F.col("l_returnflag") != "A", start + F.col("l_quantity").cast("long") * 86400000).alias("ended_at_ms"))


@query(f"""{WITH}, r AS (SELECT invocation_id, sequence - sequence%4 AS event_sequence FROM ev WHERE sequence >= 4 GROUP BY 1, 2), g AS (SELECT id AS invocation_id, CAST(0 AS BIGINT) AS event_sequence FROM iv WHERE event_mode = 'full'),
t AS (SELECT DISTINCT invocation_id, sequence AS target_sequence FROM ev WHERE k%4=1)
SELECT t.*, (SELECT max(event_sequence) FROM (SELECT * FROM r UNION ALL SELECT * FROM g) u WHERE u.invocation_id = t.invocation_id AND event_sequence <= target_sequence) AS snapshot_sequence FROM t""")
def c6_snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir)
    recovery = e.filter("sequence >= 4").select("invocation_id", (F.col("sequence") - F.col("sequence") % 4).alias("event_sequence"), F.lit("{}").alias("state_json")).distinct()
    genesis = invocations(spark, sf_dir).filter("event_mode = 'full'").select(F.col("id").alias("invocation_id"), F.col("genesis_state_json").alias("state_json"))
    return A.snapshot_asof(genesis, recovery, e.filter("k % 4 = 1").select("invocation_id", F.col("sequence").alias("target_sequence"))).drop("state_json")


@query(f"""{WITH}, {EXEC_SQL}, o AS (SELECT execution_id, arg_max('{{"v":' || k || '}}', sequence) FILTER (event_name = 'node.completed') AS v FROM ev WHERE execution_id IS NOT NULL AND event_name LIKE 'node.%' GROUP BY 1),
a AS (SELECT id, edge_id, exec0 AS src, sequence FROM ev WHERE selected)
SELECT 'x' || a.id AS execution_id, CAST(sequence%3 AS BIGINT) AS position, edge_id, src AS source_execution_id, v AS value, CASE WHEN o.execution_id IS NULL THEN 'unknown_source' END AS error FROM a LEFT JOIN o ON o.execution_id = src""")
def c7_incoming_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = runtime_events(spark, sf_dir)
    p = P.prepare(events).filter("branch = 'edge' AND p.selected")
    ids = events.select("invocation_id", "sequence", "id")
    acts = p.join(ids, ["invocation_id", "sequence"]).select(F.concat(F.lit("x"), F.col("id")).alias("execution_id"), (F.col("sequence") % 3).alias("position"), F.col("p.edge_id").alias("edge_id"), F.col("p.source_execution_id").alias("source_execution_id"))
    done = events.filter("event_name LIKE 'node.%'").withColumn("execution_id", F.get_json_object("payload_json", "$.node_execution_id")).filter("execution_id IS NOT NULL")
    out = done.groupBy("execution_id").agg(F.max_by("output_json", F.when(F.col("event_name") == "node.completed", F.col("sequence"))).alias("output_json"))
    return A.incoming_outputs(acts, out)


PATHS_SQL = "w AS (SELECT 'c' || user_id%40 AS context_id, event_id AS write_id, event_id - 1 - k%60 AS base_revision, event_id AS revision, 'data/a' || k%5 || CASE WHEN k%4=0 THEN '' ELSE '/b' || k%3 || CASE WHEN k%4=3 THEN '/c' ELSE '' END END AS path FROM ev WHERE event_type = 'state_change')"


def path_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = numbered_events(spark, sf_dir).filter("event_name LIKE 'node.%' OR event_name LIKE 'invocation.%'"), F.col("k")
    tail = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("/b"), (k % 3).cast("string"), F.when(k % 4 == 3, "/c").otherwise("")))
    return e.select(F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("context_id"), F.col("event_id").alias("write_id"), (F.col("event_id") - 1 - k % 60).alias("base_revision"), F.col("event_id").alias("revision"), F.concat(F.lit("data/a"), (k % 5).cast("string"), tail).alias("path"))


@query(f"""{WITH}, {PATHS_SQL} SELECT w.context_id, w.write_id, w.path, o.write_id AS other_id FROM w JOIN w o ON w.context_id = o.context_id AND o.revision > w.base_revision AND o.revision < w.revision AND (w.path = o.path OR starts_with(w.path, o.path || '/') OR starts_with(o.path, w.path || '/'))""")
def c9_context_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.context_conflicts(path_writes(spark, sf_dir))


@query(f"""{WITH}, {PATHS_SQL} SELECT w.context_id, w.write_id, w.path, arg_max(o.write_id, o.revision) AS other_id, max(o.revision) AS other_revision FROM w JOIN w o ON w.context_id = o.context_id AND o.revision > w.base_revision AND o.revision < w.revision AND (w.path = o.path OR starts_with(w.path, o.path || '/') OR starts_with(o.path, w.path || '/')) GROUP BY 1, 2, 3""")
def c9_newest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.newest_conflicts(path_writes(spark, sf_dir))


@query(f"""WITH {ATTEMPTS_SQL}, u AS (SELECT CAST(o_orderkey AS VARCHAR) AS execution_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS state FROM orders),
us AS (SELECT execution_id, count(*) AS call_count, count(*) FILTER (state = 'completed') AS success_count, count(*) FILTER (state = 'failed') AS failure_count FROM u GROUP BY 1),
s AS (SELECT execution_id, count(*) AS attempt_count, count(*) FILTER (reason = 'retry') AS retry_count, count(*) FILTER (reason = 'fallback') AS fallback_count, CAST(sum(duration_ns) AS BIGINT) AS total_duration_ns, min(duration_ns) AS min_duration_ns, max(duration_ns) AS max_duration_ns,
  count(*) FILTER (streaming) AS streaming_call_count, CAST(sum(chunks) AS BIGINT) AS stream_chunk_count, min(started_at_ms) AS started_at_ms, max(COALESCE(ended_at_ms, started_at_ms)) AS ended_at_ms FROM att GROUP BY 1),
f AS (SELECT execution_id, string_agg(error_code || ':' || operator_id, ',' ORDER BY seq) AS failures FROM (SELECT * FROM att WHERE error_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY seq) <= 8) GROUP BY 1),
d AS (SELECT execution_id, string_agg(operator_id, ',' ORDER BY s) AS operator_ids FROM (SELECT execution_id, operator_id, min(seq) AS s FROM att GROUP BY 1, 2) GROUP BY 1)
SELECT execution_id, COALESCE(call_count, 0) AS call_count, COALESCE(success_count, 0) AS success_count, COALESCE(failure_count, 0) AS failure_count, greatest(0, COALESCE(call_count - success_count - failure_count, 0)) AS cancelled_count,
  COALESCE(attempt_count, 0) AS attempt_count, COALESCE(retry_count, 0) AS retry_count, COALESCE(fallback_count, 0) AS fallback_count, COALESCE(total_duration_ns, 0) AS total_duration_ns, min_duration_ns, max_duration_ns, COALESCE(streaming_call_count, 0) AS streaming_call_count,
  COALESCE(stream_chunk_count, 0) AS stream_chunk_count, started_at_ms, ended_at_ms, COALESCE(failures, '') AS failures, operator_ids FROM us FULL JOIN s USING (execution_id) LEFT JOIN f USING (execution_id) LEFT JOIN d USING (execution_id)""")
def d10_parallel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    units = o.select(F.col("o_orderkey").cast("string").alias("execution_id"), F.lit("u").alias("unit_id"), F.when(o.o_orderstatus == "F", "completed").when(o.o_orderstatus == "O", "failed").otherwise("pending").alias("state"))
    out = A.parallel_summary(attempts(spark, sf_dir), units)
    failures = F.array_join(F.transform(F.coalesce("failure_samples", F.array()), lambda x: F.concat(x["error_code"], F.lit(":"), x["operator_id"])), ",")
    return out.withColumn("failures", failures).withColumn("operator_ids", F.array_join("operator_ids", ",")).drop("failure_samples")


@query(f"""WITH {ATTEMPTS_SQL} SELECT execution_id, CAST(sum(duration_ns) AS BIGINT) AS duration_ns, CAST(sum(duration_ns//2) AS BIGINT) AS execution_ns, CAST(sum(duration_ns//3) AS BIGINT) AS concurrency_wait_ns, CAST(sum(CASE WHEN chunks%2=0 THEN chunks ELSE 0 END) AS BIGINT) AS thread_pool_queue_ns,
CAST(sum(seq*1000) AS BIGINT) AS retry_backoff_ns, CAST(sum(chunks*7) AS BIGINT) AS stream_consumption_ns, CAST(sum(l_linenumber) AS BIGINT) AS stream_reduction_ns, CAST(sum(duration_ns) AS BIGINT)//1000000 AS duration_ms FROM att GROUP BY 1""")
def d11_resource_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.col("chunks")
    counters = {"execution_ns": F.expr("duration_ns div 2"), "concurrency_wait_ns": F.expr("duration_ns div 3"), "thread_pool_queue_ns": F.when(chunks % 2 == 0, chunks), "retry_backoff_ns": F.col("seq") * 1000, "stream_consumption_ns": chunks * 7, "stream_reduction_ns": F.col("l_linenumber").cast("long")}
    return A.resource_usage(attempts(spark, sf_dir).withColumns(counters))


@query(f"""WITH {ATTEMPTS_SQL}, e AS (SELECT 'i' || l_partkey%50 AS invocation_id, 'n' || l_linenumber AS node_id, execution_id || '-' || seq AS execution_id, CAST(execution_id AS BIGINT) * 1000 + seq AS sequence, CASE WHEN chunks%2=0 THEN duration_ns//1000000 ELSE 0 END AS duration_ms, started_at_ms, ended_at_ms FROM att),
p AS (SELECT DISTINCT node_id, 20 + length(node_id) AS max_executions, 12 AS max_attempts, 5000000000 AS max_runtime_ms FROM e),
x AS (SELECT e.*, max_executions, max_attempts, max_runtime_ms, row_number() OVER w AS n, sum(CASE WHEN duration_ms <> 0 THEN duration_ms ELSE greatest(0, COALESCE(ended_at_ms - started_at_ms, 0)) END) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM e JOIN p USING (node_id) WINDOW w AS (PARTITION BY invocation_id, node_id ORDER BY sequence))
SELECT invocation_id, node_id, 'executions' AS kind, arg_min(CAST(n AS BIGINT), sequence) AS actual, CAST(any_value(max_executions) AS BIGINT) AS "limit", arg_min(execution_id, sequence) AS execution_id FROM x WHERE n > max_executions GROUP BY 1, 2
UNION ALL SELECT invocation_id, node_id, 'attempts', arg_min(CAST(n AS BIGINT), sequence), CAST(any_value(max_attempts) AS BIGINT), arg_min(execution_id, sequence) FROM x WHERE n > max_attempts GROUP BY 1, 2
UNION ALL SELECT invocation_id, node_id, 'runtime_ms', CAST(arg_min(total, sequence) AS BIGINT), CAST(any_value(max_runtime_ms) AS BIGINT), arg_min(execution_id, sequence) FROM x WHERE total > max_runtime_ms GROUP BY 1, 2""")
def d12_resource_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    e = a.select(F.concat(F.lit("i"), (F.col("l_partkey") % 50).cast("string")).alias("invocation_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("node_id"), F.concat_ws("-", "execution_id", F.col("seq").cast("string")).alias("execution_id"),
                 (F.col("execution_id").cast("long") * 1000 + F.col("seq")).alias("sequence"), F.when(F.col("chunks") % 2 == 0, F.expr("duration_ns div 1000000")).otherwise(0).alias("duration_ms"), "started_at_ms", "ended_at_ms")
    p = e.select("node_id").distinct().select("node_id", (F.length("node_id") + 20).alias("max_executions"), F.lit(12).alias("max_attempts"), F.lit(5000000000).alias("max_runtime_ms"))
    return A.resource_violations(e, e.withColumnRenamed("sequence", "seq"), p)


@query(f"""{WITH}, j AS (SELECT event_type, length(CASE WHEN event_name = 'node.running' THEN '{{"i":' || k || '}}' ELSE '' END) + length(CASE WHEN event_name = 'node.completed' THEN '{{"v":' || k || '}}' ELSE '' END) AS n FROM ev) SELECT event_type, count(*) AS rows, CAST(sum(n) AS BIGINT) AS json_chars FROM j GROUP BY ROLLUP (event_type)""")
def d13_journal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.journal_size(runtime_events(spark, sf_dir), ("input_json", "output_json"))


@query(f"{WITH}, r AS (SELECT id, workflow_version_id AS g, updated_at_ms - created_at_ms AS v FROM iv), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM r) SELECT g, count(*) AS runs, quantile_cont(v, 0.5) AS median, max(v) FILTER (i = CAST(floor((n - 1) * 0.95) AS BIGINT)) AS p95, count(*) * 1000 / sum(v) AS runs_per_s FROM o GROUP BY 1")
def d14_latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = invocations(spark, sf_dir).select(F.col("workflow_version_id").alias("g"), (F.col("updated_at_ms") - F.col("created_at_ms")).alias("v"))
    return A.latency_stats(runs, "g", "v")


@query(f"""{WITH}, r AS (SELECT id, workflow_version_id AS g, updated_at_ms - created_at_ms AS v FROM iv), s AS (SELECT g, count(*) AS runs, quantile_cont(v, 0.5) AS median, count(*) * 1000 / sum(v) AS runs_per_s FROM r GROUP BY 1), b AS (SELECT * FROM s WHERE g = 'v0')
SELECT s.g, s.runs, s.median, s.runs_per_s, (s.median / b.median - 1) * 100 AS latency_change_percent, (s.runs_per_s / b.runs_per_s - 1) * 100 AS throughput_change_percent FROM s CROSS JOIN b""")
def d14_latency_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions against the first one."""
    runs = invocations(spark, sf_dir).select(F.col("workflow_version_id").alias("g"), (F.col("updated_at_ms") - F.col("created_at_ms")).alias("v"))
    stats = cut(A.latency_stats(runs, "g", "v"))
    return A.latency_change(stats, stats.filter("g = 'v0'"), "g").drop("p95")


@query(f"""{WITH} SELECT 'invocations' AS part, count(*) AS rows, CAST(COALESCE(sum(CASE WHEN event_mode = 'full' THEN 2 ELSE 0 END), 0) AS BIGINT) AS size FROM iv
UNION ALL SELECT 'genesis', count(*), CAST(COALESCE(sum(CASE WHEN event_mode = 'full' THEN 2 ELSE 0 END), 0) AS BIGINT) FROM iv UNION ALL SELECT 'context', count(*), CAST(2 * count(*) AS BIGINT) FROM se
UNION ALL SELECT 'recovery', count(*), CAST(COALESCE(sum(length('{{"n":' || durable_sequence || '}}')), 0) AS BIGINT) FROM iv WHERE event_mode <> 'minimal' UNION ALL SELECT 'artifacts', count(*), CAST(sum(strlen(text)) AS BIGINT) FROM documents""")
def d13_journal_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = invocations(spark, sf_dir)
    recovery = i.filter("event_mode <> 'minimal'").select(F.concat(F.lit('{"n":'), F.col("durable_sequence").cast("string"), F.lit("}")).alias("state_json"))
    artifacts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").cast("binary").alias("payload_blob"))
    return A.journal_sizes({"invocations": i, "sessions": sessions(spark, sf_dir), "runtime_recovery_states": recovery, "artifacts": artifacts})


@query("SELECT p_brand AS workflow, count(*) FILTER (p_size%3=0) = 0 AS ok, count(*) FILTER (p_size%3=0) AS errors, count(*) FILTER (p_size%3=1) AS warnings, count(*) FILTER (p_size%3=2) AS infos FROM part GROUP BY 1")
def d17_diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return A.diagnostic_summary(p.select(F.col("p_brand").alias("workflow"), F.when(p.p_size % 3 == 0, "error").when(p.p_size % 3 == 1, "warning").otherwise("info").alias("severity")), "workflow")


@query("SELECT p_brand AS model, p_type AS finish_reason, count(*) AS responses, CAST(sum(CASE WHEN p_size%5<>0 THEN p_size END) AS BIGINT) AS input_tokens, CAST(sum(p_size * 2) AS BIGINT) AS output_tokens, count(*) FILTER (p_size%5=0) AS without_usage FROM part GROUP BY 1, 2")
def d20_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("long")
    return A.usage_rollup(p.select(F.col("p_brand").alias("model"), F.col("p_type").alias("finish_reason"), F.when(size % 5 != 0, size).alias("input_tokens"), (size * 2).alias("output_tokens")))


@query(f"""{WITH}, d AS (SELECT invocation_id, node, sequence, k FROM ev WHERE event_name = 'node.completed'), q AS (SELECT DISTINCT invocation_id, sequence AS viewer_sequence FROM ev WHERE event_name = 'node.running')
SELECT q.invocation_id, viewer_sequence, node AS node_id, '{{"v":' || arg_max(k, sequence) || '}}' AS latest, max(sequence) AS latest_sequence, count(*) AS all_count FROM q JOIN d ON d.invocation_id = q.invocation_id AND d.sequence <= viewer_sequence GROUP BY 1, 2, 3""")
def e4_output_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runtime_events(spark, sf_dir)
    done = e.filter("event_name = 'node.completed'").select("invocation_id", F.get_json_object("payload_json", "$.node_id").alias("node_id"), "sequence", F.lit("completed").alias("state"), "output_json")
    return A.output_view(done, e.filter("event_name = 'node.running'").select("invocation_id", F.col("sequence").alias("viewer_sequence")))


DONE_SQL = "d AS (SELECT invocation_id, node, sequence, k FROM ev WHERE event_name = 'node.completed'), q AS (SELECT DISTINCT invocation_id, sequence AS viewer_sequence FROM ev WHERE event_name = 'node.running')"


def done_and_viewers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = runtime_events(spark, sf_dir)
    done = e.filter("event_name = 'node.completed'").select("invocation_id", F.get_json_object("payload_json", "$.node_id").alias("node_id"), "sequence", F.lit("completed").alias("state"), "output_json")
    return done, e.filter("event_name = 'node.running'").select("invocation_id", F.col("sequence").alias("viewer_sequence"))


@query(f"{WITH}, {DONE_SQL} SELECT q.invocation_id, viewer_sequence, (SELECT count(*) FROM d WHERE d.invocation_id = q.invocation_id AND d.sequence <= viewer_sequence) AS seen FROM q")
def e4_output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.output_lists(*done_and_viewers(spark, sf_dir))[1]


@query(f"""{WITH}, {DONE_SQL}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) AS BIGINT) AS place FROM d)
SELECT q.invocation_id, viewer_sequence, 'first' AS node, p.node AS node_id, place, sequence, '{{"v":' || k || '}}' AS output_json FROM q JOIN p ON p.invocation_id = q.invocation_id AND p.sequence <= viewer_sequence AND p.node = 'n0'
UNION ALL SELECT q.invocation_id, viewer_sequence, NULL, p.node, place, sequence, '{{"v":' || k || '}}' FROM q JOIN p ON p.invocation_id = q.invocation_id AND p.sequence <= viewer_sequence""")
def e4_output_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outputs of a node by its alias, and the timeline, of every viewer."""
    done, viewers = done_and_viewers(spark, sf_dir)
    outputs, views = A.output_lists(done, viewers)
    node = F.explode(F.array(F.lit("first"), F.lit(None).cast("string"))).alias("node")
    aliases = spark.createDataFrame([("first", "n0")], "alias string, node_id string")
    return A.read_outputs(outputs, views, viewers.distinct().select("invocation_id", "viewer_sequence", node), aliases)


@query("""WITH o AS (SELECT p_brand AS c, 'p' || p_partkey AS id, p_size AS pr, p_partkey%5<>0 AS en, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS df, p_partkey, CASE length(p_brand) + CAST(right(p_brand, 1) AS INT) % 3 - length(p_brand) WHEN 0 THEN 'priority' WHEN 1 THEN 'first_available' ELSE 'default' END AS mode, right(p_brand, 1) IN ('1', '2', '3') AS fb, max(p_partkey) OVER (PARTITION BY p_brand) AS mx FROM part),
k AS (SELECT *, CASE WHEN p_partkey = mx THEN 0 ELSE 1 END AS pf FROM o WHERE en AND p_partkey%7<>0),
r AS (SELECT c, id, row_number() OVER (PARTITION BY c ORDER BY pf, CASE WHEN mode = 'default' AND NOT df THEN 1 ELSE 0 END, CASE WHEN mode = 'first_available' THEN 0 ELSE -pr END, id) AS n, fb FROM k)
SELECT c AS capability_id, id AS operator_id, CAST(n AS BIGINT) AS rank, CAST(NULL AS VARCHAR) AS error FROM r WHERE fb OR n = 1
UNION ALL SELECT DISTINCT c, NULL, NULL, 'CAPABILITY_UNAVAILABLE' FROM o WHERE c NOT IN (SELECT c FROM k)""")
def e7_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = W.partitionBy("p_brand")
    ops = p.select(F.col("p_brand").alias("capability_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("operator_id"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 5 != 0).alias("enabled"), (F.col("p_partkey") == F.min("p_partkey").over(own)).alias("is_default"), "p_partkey")
    digit = F.right("capability_id", F.lit(1)).cast("int")
    excluded = F.collect_list(F.when(F.col("p_partkey") % 7 == 0, F.col("operator_id")))
    pol = ops.groupBy("capability_id").agg(F.array(F.max_by("operator_id", "p_partkey")).alias("preferred"), excluded.alias("excluded"))
    pol = pol.withColumn("mode", F.when(digit % 3 == 0, "priority").when(digit % 3 == 1, "first_available").otherwise("default")).withColumn("allow_fallback", digit.isin(1, 2, 3))
    return A.rank_candidates(ops.drop("p_partkey"), pol)


@query(f"{WITH}, g AS (SELECT id, invocation_id, ms, sequence, CASE WHEN COALESCE(ms - lag(ms) OVER w, 99999999999) >= 3600000 THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY invocation_id ORDER BY ms, sequence)) SELECT id, CAST(sum(n) OVER (PARTITION BY invocation_id ORDER BY ms, sequence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g")
def e8_burst_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.burst_clusters(runtime_events(spark, sf_dir), 3600000).select("id", "cluster")


@query(f"""{WITH}, {EXEC_SQL}, x AS (SELECT d1.*, CAST(first_event_sequence%3 AS BIGINT) AS ra, CASE WHEN first_event_sequence%2=0 THEN 'key' || first_event_sequence END AS ik, event_mode FROM d1 JOIN iv ON iv.id = invocation_id WHERE d1.state = 'running' ),
j AS (SELECT *, CASE WHEN node_id = 'n3' THEN 'absent_node' WHEN node_id = 'n1' THEN 'not_permitted' WHEN ra >= 2 THEN 'attempts_exhausted' END AS rejection, event_mode = 'full' AS fast FROM x),
s AS (SELECT *, fast AND COALESCE(bool_or(rejection IS NOT NULL) OVER (PARTITION BY invocation_id ORDER BY first_event_sequence, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS stopped FROM j)
SELECT invocation_id, execution_id, node_id, CASE WHEN stopped THEN 'not_handled' WHEN rejection IS NULL THEN 'requeue' WHEN fast THEN 'interrupt_invocation' ELSE 'reject' END AS action, rejection, CASE WHEN NOT stopped AND rejection IS NULL THEN ra + 1 END AS next_attempt, CASE WHEN NOT stopped AND rejection IS NULL THEN COALESCE(ik, execution_id) END AS idempotency_key FROM s""")
def e9_recovery_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("first_event_sequence")
    x = P.project_node_executions(prepared(spark, sf_dir)).select("invocation_id", "execution_id", "node_id", seq.alias("sequence"), "state", (seq % 3).alias("recovery_attempt"), F.when(seq % 2 == 0, F.concat(F.lit("key"), seq.cast("string"))).alias("idempotency_key"))
    pol = x.select("node_id").distinct().filter("node_id <> 'n3'").select("node_id", F.when(F.col("node_id") == "n1", "never").otherwise("requeue").alias("mode"), F.lit(2).alias("max_attempts"))
    modes = invocations(spark, sf_dir).select(F.col("id").alias("invocation_id"), F.when(F.col("event_mode") == "full", "fail_fast").otherwise("continue").alias("failure_mode"))
    return A.recovery_requeue(x, pol, modes)


@query(f"""WITH {ATTEMPTS_SQL}, i AS (SELECT execution_id, started_at_ms AS s, COALESCE(ended_at_ms, started_at_ms + 86400000) AS e FROM att), t AS (SELECT execution_id, s AS t, 1 AS d FROM i UNION ALL SELECT execution_id, e, -1 FROM i),
q AS (SELECT execution_id, t, d, sum(d) AS n FROM t GROUP BY 1, 2, 3)
SELECT execution_id, CAST(max(live) AS BIGINT) AS peak FROM (SELECT execution_id, sum(n) OVER (PARTITION BY execution_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS live FROM q) GROUP BY 1""")
def e10_peak_parallelism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.peak_parallelism(attempts(spark, sf_dir).withColumn("ended_at_ms", F.coalesce("ended_at_ms", F.col("started_at_ms") + 86400000)))


EDGES_SQL = "eg AS (SELECT DISTINCT edge_id, split_part(edge_id, '>', 2) AS t FROM ev WHERE edge_id IS NOT NULL), dc AS (SELECT invocation_id || '/' || k%3 AS scope_key, edge_id, arg_max(selected, sequence) AS selected FROM ev WHERE edge_id IS NOT NULL GROUP BY 1, 2)"


def edge_decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = P.prepare(runtime_events(spark, sf_dir)).filter("branch = 'edge'").join(numbered_events(spark, sf_dir).select("invocation_id", "sequence", "k"), ["invocation_id", "sequence"])
    e = e.withColumn("edge_id", F.col("p.edge_id"))
    decisions = e.groupBy(F.concat_ws("/", "invocation_id", (F.col("k") % 3).cast("string")).alias("scope_key"), "edge_id").agg(F.max_by(F.coalesce(F.col("p.selected"), F.lit(False)), "sequence").alias("selected"))
    return e.select("edge_id", F.substring_index("edge_id", ">", -1).alias("to")).distinct(), decisions


@query(f"""{WITH}, {EDGES_SQL}, tt AS (SELECT DISTINCT scope_key, t FROM dc JOIN eg USING (edge_id)) SELECT * FROM (SELECT tt.scope_key, tt.t AS node_id, count(*) AS incoming, count(dc.selected) AS decided, CASE WHEN count(dc.selected) < count(*) THEN 'pending' WHEN bool_or(dc.selected) THEN 'ready' ELSE 'skipped' END AS status
FROM tt JOIN eg ON eg.t = tt.t LEFT JOIN dc ON dc.scope_key = tt.scope_key AND dc.edge_id = eg.edge_id GROUP BY 1, 2)""")
def j10_fan_in_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fan_in_status(*edge_decisions(spark, sf_dir))


LOOPS_SQL = """he AS (SELECT edge_id, t AS n, CASE WHEN split_part(edge_id, '>', 1) < t THEN 'entry' ELSE 'back' END AS role FROM eg WHERE t IN ('n1', 'n2')),
ds AS (SELECT invocation_id, k%3 AS it, edge_id, bool_or(selected) AS selected FROM ev WHERE edge_id IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"""{WITH}, {EDGES_SQL}, {LOOPS_SQL}, tt AS (SELECT DISTINCT invocation_id, it, t AS n, CASE WHEN t IN ('n1', 'n2') THEN CASE WHEN it = 0 THEN 'entry' ELSE 'back' END END AS role FROM ds JOIN eg USING (edge_id)),
nd AS (SELECT tt.*, eg.edge_id FROM tt JOIN eg ON eg.t = tt.n WHERE role IS NULL UNION ALL SELECT tt.*, he.edge_id FROM tt JOIN he ON he.n = tt.n AND he.role = tt.role)
SELECT invocation_id, it AS iteration, n AS node_id, count(*) AS incoming, count(selected) AS decided, CASE WHEN count(selected) < count(*) THEN 'pending' WHEN bool_or(selected) THEN 'ready' WHEN role = 'entry' THEN 'loop_skipped' ELSE 'skipped' END AS status
FROM nd LEFT JOIN ds USING (invocation_id, it, edge_id) GROUP BY 1, 2, 3, role""")
def j10_fan_in_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loops with headers n1 and n2, whose edges from smaller nodes are entries; the iteration of both is k % 3."""
    e = P.prepare(runtime_events(spark, sf_dir)).filter("branch = 'edge'").join(numbered_events(spark, sf_dir).select("invocation_id", "sequence", "k"), ["invocation_id", "sequence"]).withColumn("edge_id", F.col("p.edge_id"))
    edges = e.select("edge_id", F.substring_index("edge_id", ">", -1).alias("to")).distinct()
    frame = lambda loop: F.struct(F.lit(loop).alias("loop_id"), (F.col("k") % 3).alias("iteration"))
    decisions = e.select("invocation_id", F.array(frame("n1"), frame("n2")).alias("scope"), "edge_id", F.coalesce(F.col("p.selected"), F.lit(False)).alias("selected"))
    headers = edges.filter(F.col("to").isin("n1", "n2")).select(F.col("to").alias("node_id"), F.col("to").alias("loop_id"), "edge_id", F.when(F.substring_index("edge_id", ">", 1) < F.col("to"), "entry").otherwise("back").alias("role"))
    return A.fan_in_loops(edges, decisions, headers).select("invocation_id", F.col("scope")[0]["iteration"].alias("iteration"), "node_id", "incoming", "decided", "status")


@query(f"""{WITH}, {EDGES_SQL}, le AS (SELECT 'loop_' || CASE WHEN t IN ('n0', 'n1') THEN 0 ELSE 1 END AS loop_id, edge_id, CASE WHEN t IN ('n0', 'n2') THEN 'back' ELSE 'exit' END AS role FROM eg), q AS (SELECT DISTINCT loop_id, scope_key FROM dc JOIN le USING (edge_id)),
a AS (SELECT q.loop_id, q.scope_key, count(*) > count(selected) AS open, COALESCE(bool_or(role = 'back' AND selected), FALSE) AS b, COALESCE(bool_or(role = 'exit' AND selected), FALSE) AS x FROM q JOIN le ON le.loop_id = q.loop_id LEFT JOIN dc ON dc.scope_key = q.scope_key AND dc.edge_id = le.edge_id GROUP BY 1, 2)
SELECT loop_id, scope_key, CASE WHEN open THEN 'incomplete' WHEN b AND x THEN 'conflict' WHEN b THEN 'continue' WHEN x THEN 'exit' ELSE 'dead_end' END AS outcome FROM a""")
def j12_loop_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, decisions = edge_decisions(spark, sf_dir)
    loops = edges.select(F.when(F.col("to").isin("n0", "n1"), "loop_0").otherwise("loop_1").alias("loop_id"), "edge_id", F.when(F.col("to").isin("n0", "n2"), "back").otherwise("exit").alias("role"))
    return A.loop_outcomes(loops, decisions)


@query(f"{WITH} SELECT invocation_id, CAST(row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) AS BIGINT) AS step, edge_id, exec0 AS source_execution_id, CAST(row_number() OVER (PARTITION BY invocation_id, edge_id ORDER BY sequence) AS BIGINT) AS iteration FROM ev WHERE selected")
def j13_path_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = prepared(spark, sf_dir).filter("branch = 'edge'")
    return A.path_trace(e.select("invocation_id", "sequence", F.col("p.edge_id").alias("edge_id"), F.col("p.source_execution_id").alias("source_execution_id"), F.coalesce("p.selected", F.lit(False)).alias("selected")))


@query(f"""{WITH}, {EXEC_SQL}, x AS (SELECT invocation_id, execution_id, first_event_sequence AS s, d1.state, error_code, user_id FROM d1 JOIN iv ON iv.id = invocation_id), f AS (SELECT invocation_id, arg_min(error_code, s) AS code, min(s) AS m FROM x WHERE state = 'failed' GROUP BY 1)
SELECT invocation_id, execution_id, CASE WHEN user_id%2=0 AND m IS NOT NULL AND state = 'running' THEN 'cancelled' ELSE state END AS final_state, code AS invocation_error FROM x LEFT JOIN f USING (invocation_id)""")
def l10_apply_failure_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = P.project_node_executions(prepared(spark, sf_dir)).select("invocation_id", "execution_id", F.col("first_event_sequence").alias("sequence"), "state", F.get_json_object("error", "$.code").alias("error_code"))
    modes = invocations(spark, sf_dir).select(F.col("id").alias("invocation_id"), F.when(F.col("session_id").cast("long") % 2 == 0, "fail_fast").otherwise("continue").alias("failure_mode"))
    return A.apply_failure_policy(x, modes)


@query(f"{WITH} SELECT id, event_type, CASE WHEN event_name = 'edge.evaluated' THEN 'edge' WHEN call_id IS NOT NULL THEN 'operator_call' WHEN event_name = 'wait.resumed' THEN 'wait' WHEN event_name LIKE 'node.%' THEN 'node' ELSE 'invocation' END AS subject_type, CASE WHEN event_name = 'edge.evaluated' THEN edge_id WHEN call_id IS NOT NULL THEN call_id WHEN event_name = 'wait.resumed' THEN wait_key WHEN event_name LIKE 'node.%' THEN COALESCE(execution_id, node) ELSE invocation_id END AS subject_id, CASE WHEN call_id IS NOT NULL THEN call_state WHEN edge_id IS NOT NULL AND k%6<>1 THEN edge_state ELSE status END AS status FROM ev")
def h1_event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2, H3"""
    p = runtime_events(spark, sf_dir).join(P.prepare(runtime_events(spark, sf_dir)).select("invocation_id", "sequence", "p"), ["invocation_id", "sequence"])
    kind = H.event_type(F.col("event_name"))
    subject = H.event_subject(kind, F.col("p"), F.array().cast("array<string>"), F.col("invocation_id"))
    return p.select("id", kind.alias("event_type"), subject.alias("s"), H.event_status(F.col("event_name"), F.col("p.state")).alias("status")).select("id", "event_type", "s.subject_type", "s.subject_id", "status")


@query("SELECT event_id, regexp_full_match(trim(v), '[a-z][a-z0-9]*(_[a-z0-9]+)*') AS valid, CASE WHEN v LIKE '%\\_failed' ESCAPE '\\' OR contains(v, 'error') OR v = 'message_aborted' THEN 'error' ELSE 'default' END AS tone FROM (SELECT event_id, CASE event_id%6 WHEN 0 THEN event_type WHEN 1 THEN event_type || '_failed' WHEN 2 THEN ' ' || event_type || '_2 ' WHEN 3 THEN upper(event_type) WHEN 4 THEN event_type || '__x' ELSE 'message_aborted' END AS v FROM events)")
def h4_user_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4, H14"""
    e, d, t = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 6, F.col("event_type")
    v = F.when(d == 0, t).when(d == 1, F.concat(t, F.lit("_failed"))).when(d == 2, F.concat(F.lit(" "), t, F.lit("_2 "))).when(d == 3, F.upper(t)).when(d == 4, F.concat(t, F.lit("__x"))).otherwise("message_aborted")
    return e.select("event_id", H.valid_user_event_type(v).alias("valid"), H.event_tone(v).alias("tone"))


@query("SELECT event_id, CASE event_id%5 WHEN 4 THEN NULL WHEN 0 THEN epoch_us(ts)//1000 WHEN 1 THEN CAST(trunc(value) AS BIGINT) ELSE (epoch_us(ts)//1000000)*1000 - CASE WHEN event_id%5=3 THEN 7200000 ELSE 0 END END AS ms FROM events")
def h5_coerce_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 5
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    v = F.when(d == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).when(d == 1, F.format_string("%.2f", "value")).when(d == 2, F.concat(F.lit('"'), iso, F.lit('Z"'))).when(d == 3, F.concat(F.lit('"'), iso, F.lit('+02:00"'))).otherwise("true")
    return e.select("event_id", H.coerce_timestamp_ms(v).alias("ms"))


@query("SELECT event_id, CASE event_id%3 WHEN 0 THEN 'root' WHEN 1 THEN 'l1:' || event_id%7 ELSE 'l1:' || event_id%7 || '/l2:' || event_id%5 END AS scope_key, CASE event_id%3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '@l1:' || event_id%7 ELSE event_type || '@l1:' || event_id%7 || '/l2:' || event_id%5 END AS instance_key FROM events")
def h6_scope_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    frame = lambda name, m: F.struct(F.lit(name).alias("loop_region_id"), (n % m).cast("int").alias("iteration"))
    scope = F.slice(F.array(frame("l1", 7), frame("l2", 5)), F.lit(1), (n % 3).cast("int"))
    return e.select("event_id", H.scope_key(scope).alias("scope_key"), H.instance_key(F.col("event_type"), scope).alias("instance_key"))


@query("SELECT p_partkey AS id, greatest(0, CASE WHEN j = 'full' THEN 0 WHEN j = 'equal' THEN h/2 ELSE h END) AS low, h AS high FROM (SELECT p_partkey, CASE p_size%3 WHEN 0 THEN 'none' WHEN 1 THEN 'full' ELSE 'equal' END AS j, least(CASE p_partkey%3 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN 100 * (1 + 2.0::DOUBLE * (p_size%5)) ELSE 100 * pow(2.0, p_size%5) END, CASE WHEN p_size%4<>0 THEN 900.0::DOUBLE ELSE 1e18 END) AS h FROM part)")
def h11_retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m, s = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 3, F.col("p_size")
    mode, jitter = F.when(m == 0, "fixed").when(m == 1, "linear").otherwise("exponential"), F.when(s % 3 == 0, "none").when(s % 3 == 1, "full").otherwise("equal")
    d = H.retry_delay_ms(mode, F.lit(100.0), F.lit(2.0), F.when(s % 4 != 0, 900.0), jitter, s % 5)
    return p.select(F.col("p_partkey").alias("id"), d.alias("d")).select("id", "d.low", "d.high")


@query(f"WITH {ATTEMPTS_SQL} SELECT execution_id, seq, CASE WHEN l_linenumber%3 > 0 THEN 'retry' WHEN seq%2 > 0 THEN 'fallback' WHEN streaming THEN 'recovery' ELSE 'normal' END AS reason FROM att")
def h12_attempt_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(spark, sf_dir).select("execution_id", "seq", H.attempt_reason(F.col("seq") % 2, F.col("l_linenumber") % 3, F.col("streaming")).alias("reason"))


@query("SELECT p_partkey AS id, regexp_full_match(v, '[A-Za-z_][A-Za-z0-9_-]{0,63}') AS valid, CASE WHEN regexp_matches(c, '^[A-Za-z_]') THEN c ELSE left('response_' || c, 64) END AS schema_name FROM (SELECT *, left(regexp_replace(v, '[^A-Za-z0-9_-]', '_', 'g'), 64) AS c FROM (SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN p_name WHEN 1 THEN p_size || p_name WHEN 2 THEN p_brand || repeat('x', 70) ELSE replace(p_name, ' ', '_') END AS v FROM part))")
def h13_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 4
    v = F.when(m == 0, F.col("p_name")).when(m == 1, F.concat(F.col("p_size").cast("string"), "p_name")).when(m == 2, F.concat("p_brand", F.repeat(F.lit("x"), F.lit(70)))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return p.select(F.col("p_partkey").alias("id"), H.valid_tool_name(v).alias("valid"), H.schema_name(v).alias("schema_name"))


@query(f"{WITH} SELECT id, CASE WHEN user_id%11=0 THEN 'unserializable' WHEN user_id%7=0 THEN 'degraded' WHEN user_id%5<>0 AND durable_sequence >= 12 AND NOT durable_sequence%3=0 THEN 'durable' WHEN user_id%2=0 THEN 'degraded' ELSE 'pending' END AS status FROM iv")
def h15_persistence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u, d = invocations(spark, sf_dir), F.col("session_id").cast("long"), F.col("durable_sequence")
    return i.select("id", H.persistence_status(u % 11 == 0, u % 7 == 0, u % 5 != 0, d, F.lit(12), d % 3 == 0, u % 2 == 0).alias("status"))


@query("WITH p AS (SELECT p_partkey AS id, string_split(p_type, ' ')[1:p_partkey%4] AS a FROM part), u AS (SELECT id, a, CAST(unnest(range(1, len(a) + 1)) AS BIGINT) AS n FROM p) SELECT id, n AS depth, array_to_string(a[1:n], '/') AS group_id, CASE WHEN n > 1 THEN array_to_string(a[1:n-1], '/') END AS parent, a[n] AS label FROM u")
def h16_group_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.slice(F.split("p_type", " "), F.lit(1), (F.col("p_partkey") % 4).cast("int"))
    g = p.select(F.col("p_partkey").alias("id"), F.explode(H.group_paths(path)).alias("g"))
    return g.select("id", F.size("g.path").cast("long").alias("depth"), F.col("g.id").alias("group_id"), "g.parent", "g.label")


@query("SELECT doc_id, sha256(text) AS definition_hash, CAST(NULL AS VARCHAR) AS none FROM documents")
def h7_definition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", H.definition_hash(F.col("text")).alias("definition_hash"), F.lit(None).cast("string").alias("none"))


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{H.REVISION_NAMESPACE.replace("-", "")}') || encode(source) || unhex('00') || encode(sha256(text))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)%4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS revision_id FROM h""")
def h7_revision_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", H.revision_id(F.col("source"), F.sha2("text", 256)).alias("revision_id"))
