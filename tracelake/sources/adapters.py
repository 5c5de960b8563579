"""A journal derived from the benchmark's tables by fixed rules, so that queries can be compared with SQL on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEEK_MS = 604_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the keys that all rules use: ms, k, invocation_id, sequence, event_name."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("ms", ms).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    e = e.withColumn("invocation_id", F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("ms") / WEEK_MS).cast("string")))
    e = e.withColumn("sequence", F.row_number().over(W.partitionBy("invocation_id").orderBy("ms", "event_id")).cast("long"))
    kind, d = F.col("event_type"), F.col("k") % 10
    name = (
        F.when(kind == "signup", F.when(d == 3, "invocation.running").otherwise("node.running"))
        .when(kind == "view", F.when(d == 0, "wait.created").when(d == 1, "wait.resumed").when(d == 2, "node.skipped").when(d == 6, "input_mapping.completed").otherwise("edge.evaluated"))
        .when(kind == "click", "operator_call.completed")
        .when(kind == "purchase", F.when(d == 4, "invocation.completed").otherwise("node.completed"))
        .otherwise(F.when(d == 5, "invocation.failed").otherwise("node.failed"))
    )
    return e.withColumn("event_name", name)


def runtime_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal's runtime events (schemas.TABLES), with payloads as JSON text."""
    e, k, name = numbered_events(spark, sf_dir), F.col("k"), F.col("event_name")
    node = F.concat(F.lit("n"), (k % 4).cast("string"))
    execution = F.concat_ws(":", "invocation_id", node, (k % 2).cast("string"))
    failed = k % 5 == 0
    selected = k % 3 != 0
    state = F.when(selected, "selected").when(k % 11 == 0, "failed").otherwise("skipped")
    error = F.struct(F.when(k % 10 == 0, "OPERATOR_TIMEOUT").otherwise("OPERATOR_FAILED").alias("code"), F.concat(F.lit("m"), k.cast("string")).alias("message"))
    node_error = F.struct(F.concat(F.lit("E"), (k % 7).cast("string")).alias("code"), F.lit("node").alias("message"))
    payload = (
        F.when(name == "node.skipped", _json(node_id=node, node_instance_key=F.concat(node, F.lit("@l:"), (k % 5).cast("string"))))
        .when(name == "node.failed", _json(node_id=node, node_execution_id=execution, error=node_error))
        .when(name.startswith("node."), _json(node_id=node, node_execution_id=execution))
        .when(name == "edge.evaluated", _json(
            edge_id=F.concat(node, F.lit(">n"), ((k + 1) % 4).cast("string")), target_node_id=F.concat(F.lit("n"), ((k + 1) % 4).cast("string")),
            source_execution_id=execution, selected=F.when(k % 13 != 0, selected), state=F.when(k % 6 != 1, state), reason=F.concat(F.lit("r"), (k % 3).cast("string"))))
        .when(name == "operator_call.completed", _json(
            operator_call_id=F.concat(F.lit("c"), (F.col("event_id") - F.col("event_id") % 2).cast("string")), node_execution_id=execution, operator_id=F.when(k % 8 != 3, F.concat(F.lit("op"), (k % 6).cast("string"))),
            operator_ids=F.when(k % 16 == 3, F.array(F.lit("a"), F.lit("b"))), kind=F.when(k % 7 == 0, "map").when(k % 9 != 2, "direct"),
            reason=F.when(k % 3 == 0, "normal").when(k % 3 == 1, "retry").otherwise("fallback"), state=F.when(failed, "failed").otherwise("completed"),
            error=F.when(failed, error), streaming=k % 4 == 0, stream_chunk_count=k % 6,
            summary=F.when(k % 7 == 0, F.struct((k % 9).alias("call_count"), (k % 2).alias("streaming_call_count"), (k % 5).alias("stream_chunk_count")))))
        .when(name == "wait.created", F.when(k % 4 < 2, _json(wait_keys=F.array(F.concat(F.lit("w"), (k % 3).cast("string"))))).otherwise(
            _json(waits=F.array(F.struct(F.concat(F.lit("w"), (k % 3).cast("string")).alias("wait_key"), F.lit("human").alias("wait_type"), node.alias("node_id"))))))
        .when(name == "wait.resumed", _json(wait_key=F.concat(F.lit("w"), (k % 3).cast("string"))))
        .otherwise(F.lit("{}"))
    )
    kind = F.when(name.startswith("invocation.") | name.startswith("node."), "state_change").when(name.startswith("wait."), "wait").when(name.startswith("edge."), "routing").when(name.startswith("operator_call."), "operator_call").otherwise("phase")
    edits = F.concat(F.lit('[{"op":"replace","path":["nodes","'), node, F.lit('"],"value":'), k.cast("string"), F.lit("}]"))
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), "invocation_id", "sequence", F.lit(1).alias("schema_version"), kind.alias("event_type"), "event_name",
        F.when(name.startswith("invocation."), "invocation").otherwise("node").alias("subject_type"), F.when(name.startswith("invocation."), F.col("invocation_id")).otherwise(node).alias("subject_id"),
        F.col("ms").alias("occurred_at_ms"), F.round(F.col("value") * 1000).cast("long").alias("elapsed_ns"), F.substring_index(name, ".", -1).alias("status"),
        _json(queue=k % 50, run=k % 70).alias("timing_json"), payload.alias("payload_json"),
        F.when(name == "node.running", _json(i=k)).alias("input_json"), F.when(name == "node.completed", _json(v=k)).alias("output_json"),
        F.when(name.startswith("node."), edits).alias("operations_json"),
    )


#: The same rules as SQL common table expressions: `ev`, one row an event with its payload's fields as columns.
EVENTS_SQL = """
ev0 AS (
  SELECT *, epoch_us(ts)//1000 AS ms, CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k FROM events
), ev1 AS (
  SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(ms//604800000 AS VARCHAR) AS invocation_id FROM ev0
), ev2 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY invocation_id ORDER BY ms, event_id) AS BIGINT) AS sequence,
    CASE event_type
      WHEN 'signup' THEN CASE WHEN k%10=3 THEN 'invocation.running' ELSE 'node.running' END
      WHEN 'view' THEN CASE k%10 WHEN 0 THEN 'wait.created' WHEN 1 THEN 'wait.resumed' WHEN 2 THEN 'node.skipped' WHEN 6 THEN 'input_mapping.completed' ELSE 'edge.evaluated' END
      WHEN 'click' THEN 'operator_call.completed'
      WHEN 'purchase' THEN CASE WHEN k%10=4 THEN 'invocation.completed' ELSE 'node.completed' END
      ELSE CASE WHEN k%10=5 THEN 'invocation.failed' ELSE 'node.failed' END END AS event_name,
    'n' || k%4 AS node
  FROM ev1
), ev AS (
  SELECT 'e' || event_id AS id, event_id, user_id, invocation_id, sequence, ms, k, event_name, node, value,
    CASE WHEN event_name LIKE 'invocation.%' OR event_name LIKE 'node.%' THEN 'state_change' WHEN event_name LIKE 'wait.%' THEN 'wait'
         WHEN event_name LIKE 'edge.%' THEN 'routing' WHEN event_name LIKE 'operator_call.%' THEN 'operator_call' ELSE 'phase' END AS event_type,
    CASE WHEN event_name LIKE 'invocation.%' THEN 'invocation' ELSE 'node' END AS subject_type,
    CASE WHEN event_name LIKE 'invocation.%' THEN invocation_id ELSE node END AS subject_id,
    split_part(event_name,'.',2) AS status, CAST(round(value*1000) AS BIGINT) AS elapsed_ns,
    k%50 AS t_queue, k%70 AS t_run,
    invocation_id || ':' || node || ':' || k%2 AS exec0,
    CASE WHEN (event_name LIKE 'node.%' AND event_name <> 'node.skipped') OR event_name = 'operator_call.completed' THEN invocation_id || ':' || node || ':' || k%2 END AS execution_id,
    CASE WHEN event_name = 'node.skipped' THEN node || '@l:' || k%5 END AS instance_key,
    CASE WHEN event_name = 'node.failed' THEN 'E' || k%7 END AS node_error,
    CASE WHEN event_name = 'edge.evaluated' THEN node || '>n' || (k+1)%4 END AS edge_id,
    CASE WHEN event_name = 'edge.evaluated' THEN COALESCE(CASE WHEN k%13<>0 THEN k%3<>0 END, FALSE) END AS selected,
    CASE WHEN event_name = 'edge.evaluated' THEN CASE WHEN k%6<>1 THEN CASE WHEN k%3<>0 THEN 'selected' WHEN k%11=0 THEN 'failed' ELSE 'skipped' END ELSE 'evaluated' END END AS edge_state,
    CASE WHEN event_name = 'operator_call.completed' THEN 'c' || (event_id - event_id%2) END AS call_id,
    CASE WHEN event_name = 'operator_call.completed' THEN CASE WHEN k%8<>3 THEN 'op' || k%6 WHEN k%16=3 THEN 'a, b' WHEN k%7=0 THEN 'map' WHEN k%9<>2 THEN 'direct' ELSE 'operator' END END AS operator_id,
    CASE WHEN event_name = 'operator_call.completed' THEN CASE WHEN k%7=0 THEN 'map' ELSE 'direct' END END AS kind,
    CASE WHEN event_name = 'operator_call.completed' THEN CASE k%3 WHEN 0 THEN 'normal' WHEN 1 THEN 'retry' ELSE 'fallback' END END AS reason,
    CASE WHEN event_name = 'operator_call.completed' THEN CASE WHEN k%5=0 THEN 'failed' ELSE 'completed' END END AS call_state,
    event_name = 'operator_call.completed' AND k%10=0 AS is_timeout,
    'w' || k%3 AS wait_key
  FROM ev2
)"""


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocations of the derived journal; the event mode follows the user."""
    e = numbered_events(spark, sf_dir)
    told = F.when(F.col("event_name").startswith("invocation."), F.substring_index("event_name", ".", -1)).when(F.col("event_name") == "wait.created", "waiting")
    out = e.groupBy("invocation_id", "user_id").agg(
        F.coalesce(F.max_by(told, F.when(told.isNotNull(), F.col("sequence"))), F.lit("created")).alias("state"),
        F.max("sequence").alias("durable_sequence"), (F.min("ms") - 5).alias("created_at_ms"), F.max("ms").alias("updated_at_ms"),
    )
    u = F.col("user_id")
    return out.select(
        F.col("invocation_id").alias("id"), u.cast("string").alias("session_id"), F.concat(F.lit("v"), (u % 5).cast("string")).alias("workflow_version_id"), F.lit("n0").alias("entry_node_id"), "state",
        F.when(u % 2 == 0, "live").otherwise("test").alias("execution_mode"), F.when(u % 3 == 0, "minimal").when(u % 3 == 1, "standard").otherwise("full").alias("event_mode"),
        "durable_sequence", F.lit(None).cast("string").alias("input_json"), F.lit(None).cast("string").alias("result_json"), F.lit(None).cast("string").alias("error_json"),
        F.when(u % 3 == 2, "{}").alias("genesis_state_json"), "created_at_ms", "updated_at_ms",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user; the current invocation is the newest by (created_at_ms, id)."""
    out = invocations(spark, sf_dir).groupBy("session_id", "workflow_version_id").agg(
        F.max_by("id", F.struct("created_at_ms", "id")).alias("current_invocation_id"), F.min("created_at_ms").alias("created_at_ms"), F.max("updated_at_ms").alias("updated_at_ms"))
    key = F.col("session_id")
    return out.select(
        key.alias("id"), F.concat(F.lit("wf"), (key.cast("long") % 5 % 3).cast("string")).alias("workflow_id"), F.col("workflow_version_id").alias("workflow_revision_id"),
        F.concat(F.lit("s"), key).alias("session_key"), "current_invocation_id", F.lit("{}").alias("context_json"), "created_at_ms", "updated_at_ms",
    )


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version for each customer, of 97 workflows (SQL: `cv`)."""
    n = F.col("c_custkey").cast("long")
    s = n.cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("v"), s).alias("id"), F.concat(F.lit("wf"), (n % 97).cast("string")).alias("workflow_id"), F.lit("1").alias("workflow_version"), F.lit("ir1").alias("ir_version"),
        F.lit("c1").alias("compiler_version"), F.concat(F.lit("h"), s).alias("definition_hash"), F.concat(F.lit('{"n":'), s, F.lit("}")).alias("definition_json"), (n * 1000).alias("created_at_ms"), n.alias("n"))


CUSTOMER_VERSIONS_SQL = "cv AS (SELECT 'v' || c_custkey AS id, 'wf' || c_custkey%97 AS workflow_id, 'h' || c_custkey AS definition_hash, CAST(c_custkey AS BIGINT)*1000 AS created_at_ms, c_custkey AS n FROM customer)"


def workflow_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of all customers; no customer has the number of version v0."""
    return customer_versions(spark, sf_dir).drop("n")


#: SQL of the three tables: `iv`, `se`, `ve`. Follows EVENTS_SQL.
JOURNAL_SQL = f"""{EVENTS_SQL},
iv AS (
  SELECT invocation_id AS id, CAST(user_id AS VARCHAR) AS session_id, 'v' || user_id%5 AS workflow_version_id,
    COALESCE(arg_max(CASE WHEN event_name = 'wait.created' THEN 'waiting' ELSE status END, sequence) FILTER (event_name LIKE 'invocation.%' OR event_name = 'wait.created'), 'created') AS state,
    CASE WHEN user_id%2=0 THEN 'live' ELSE 'test' END AS execution_mode, CASE user_id%3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'standard' ELSE 'full' END AS event_mode,
    max(sequence) AS durable_sequence, min(ms) - 5 AS created_at_ms, max(ms) AS updated_at_ms, user_id
  FROM ev GROUP BY invocation_id, user_id),
se AS (
  SELECT session_id AS id, 'wf' || CAST(session_id AS BIGINT)%5%3 AS workflow_id, workflow_version_id AS workflow_revision_id, 's' || session_id AS session_key,
    arg_max(id, (created_at_ms, id)) AS current_invocation_id, min(created_at_ms) AS created_at_ms, max(updated_at_ms) AS updated_at_ms
  FROM iv GROUP BY session_id, workflow_version_id),
ve AS (SELECT 'v' || c_custkey AS id, 'wf' || c_custkey%97 AS workflow_id, 'h' || c_custkey AS definition_hash, CAST(c_custkey AS BIGINT)*1000 AS created_at_ms FROM customer)"""


#: Characters of a delta that the adapter cuts assistant turns into.
DELTA_CHARS = 40


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events derived from conversations: assistant turns are deltas, at times with reasoning, and mostly a completed
    message; user turns are tool requests, results or custom events; system turns are outputs or failures."""
    c, t, n = F.col("conv_id"), F.col("turn"), F.length("text")
    m = c + t
    js = lambda **f: _json(**f)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / DELTA_CHARS)), lambda i: F.struct(F.lit("message_delta").alias("type"), F.to_json(F.struct(F.substring("text", (i * DELTA_CHARS + 1).cast("int"), F.lit(DELTA_CHARS)).alias("delta"))).alias("data")))
    one = lambda kind, data: F.array(F.struct(F.lit(kind).alias("type"), data.alias("data")))
    none = F.array().cast("array<struct<type:string,data:string>>")
    done = F.struct(F.when(m % 4 == 1, F.concat(F.lit("C:"), "text")).alias("content"), F.when(m % 3 == 0, F.lit("told")).alias("reasoning_content"))
    assistant = F.concat(F.when(m % 3 == 1, one("reasoning_delta", js(delta=F.lit("think ")))).otherwise(none), F.when(n > 0, cut).otherwise(none), F.when(m % 4 != 0, one("message_completed", js(message=done))).otherwise(none))
    call = F.array(F.struct(F.concat(F.lit("t"), t.cast("string")).alias("tool_call_id"), F.concat(F.lit("tool"), (c % 3).cast("string")).alias("name"), F.concat(F.lit('{"n":'), t.cast("string"), F.lit("}")).alias("raw_arguments")))
    pieces = F.concat(one("tool_call_delta", js(tool_call_index=F.lit(0), tool_name=F.lit("streamed"), arguments_delta=F.lit("{"))), one("tool_call_delta", js(tool_call_index=F.lit(0), tool_call_id=F.concat(F.lit("t"), t.cast("string")), arguments_delta=F.lit("}"))))
    result = F.array(F.struct(F.concat(F.lit("t"), (t - t % 2).cast("string")).alias("tool_call_id"), F.concat(F.lit("o"), t.cast("string")).alias("output"), F.when(m % 5 == 0, F.lit("bad")).alias("error")))
    user = F.when(m % 3 == 0, F.concat(F.when(m % 2 == 0, pieces).otherwise(none), one("tool_call_requested", js(calls=call, reasoning_content=F.when(m % 9 == 0, F.lit("asked")))))).when(m % 3 == 1, one("tool_result", js(results=result))).otherwise(one("note", js(v=t)))
    system = F.when(c % 5 == 0, one("agent_output", js(output=t))).when(c % 5 == 1, one("agent_failed", js(e=t))).otherwise(one("note", js(v=t)))
    rows = table(spark, sf_dir, "conversations").withColumn("e", F.when(F.col("role") == "assistant", assistant).when(F.col("role") == "user", user).otherwise(system))
    rows = rows.select("conv_id", "turn", F.posexplode("e").alias("pos", "e"))
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "pos")).cast("long")
    inv = c.cast("string")
    return rows.select(
        F.concat_ws("-", F.lit("u"), inv, seq.cast("string")).alias("id"), (c % 50).cast("string").alias("session_id"), inv.alias("invocation_id"), seq.alias("sequence"), F.lit(1).alias("schema_version"), F.col("e.type").alias("type"), F.col("e.data").alias("data_json"),
        F.lit("n0").alias("node_id"), F.when(c % 4 == 0, '["a","b"]').otherwise("[]").alias("workflow_path_json"), F.concat(F.lit("x"), inv).alias("node_execution_id"),
        F.when(t % 7 != 3, F.concat_ws("-", F.lit("c"), inv, t.cast("string"))).alias("operator_call_id"), (c * 100000 + t * 100 + F.col("pos")).alias("occurred_at_ms"),
    )


#: SQL of the same rows: `ue`, with the fields of the data as columns.
USER_EVENTS_SQL = f"""
ct AS (SELECT *, conv_id + turn AS m FROM conversations),
u0 AS (
  SELECT conv_id, turn, m, 0 AS pos, 'reasoning_delta' AS type, 'think ' AS delta, NULL AS content, NULL AS thought FROM ct WHERE role = 'assistant' AND m%3=1
  UNION ALL SELECT conv_id, turn, m, 1 + i, 'message_delta', substring(text, CAST(i*{DELTA_CHARS} + 1 AS BIGINT), {DELTA_CHARS}), NULL, NULL FROM (SELECT *, unnest(range(CAST(CASE WHEN length(text) > 0 THEN (length(text)-1)//{DELTA_CHARS} + 1 ELSE 0 END AS BIGINT))) AS i FROM ct WHERE role = 'assistant')
  UNION ALL SELECT conv_id, turn, m, 1000000, 'message_completed', NULL, CASE WHEN m%4=1 THEN 'C:' || text END, CASE WHEN m%3=0 THEN 'told' END FROM ct WHERE role = 'assistant' AND m%4<>0
  UNION ALL SELECT conv_id, turn, m, i, 'tool_call_delta', CASE i WHEN 0 THEN '{{' ELSE '}}' END, NULL, NULL FROM (SELECT *, unnest([0, 1]) AS i FROM ct WHERE role = 'user' AND m%3=0 AND m%2=0)
  UNION ALL SELECT conv_id, turn, m, 2, 'tool_call_requested', NULL, NULL, CASE WHEN m%9=0 THEN 'asked' END FROM ct WHERE role = 'user' AND m%3=0
  UNION ALL SELECT conv_id, turn, m, 0, CASE WHEN m%3=1 THEN 'tool_result' ELSE 'note' END, NULL, NULL, NULL FROM ct WHERE role = 'user' AND m%3<>0
  UNION ALL SELECT conv_id, turn, m, 0, CASE conv_id%5 WHEN 0 THEN 'agent_output' WHEN 1 THEN 'agent_failed' ELSE 'note' END, NULL, NULL, NULL FROM ct WHERE role NOT IN ('assistant', 'user')),
ue AS (
  SELECT *, CAST(conv_id AS VARCHAR) AS invocation_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS BIGINT) AS sequence,
    CASE WHEN turn%7<>3 THEN 'c-' || conv_id || '-' || turn END AS call_id, 'x' || conv_id AS exec_id,
    CAST(conv_id*100000 + turn*100 + row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS BIGINT) AS at_ms,
    'u-' || conv_id || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS id,
    CASE WHEN conv_id%4=0 THEN 'a/b' ELSE '<root>' END AS path,
    (conv_id%4=0 OR bool_or(type IN ('agent_output', 'agent_failed')) OVER (PARTITION BY conv_id)) AS react, type <> 'note' AS known
  FROM u0)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph for every twelve customers: a chain, and jumps from every fourth node. Some edges lead to
    nodes that are not there; `known_edges` leaves those out."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 12).alias("i"), F.floor(F.col("c_custkey") / 12).alias("r"))
    rev = F.concat(F.lit("r"), F.col("r").cast("string"))
    letters = [F.lit(x) for x in "ab"]
    path = F.when(F.col("i") < 4, F.array().cast("array<string>")).when(F.col("i") < 8, F.array(letters[0])).when(F.col("i") < 10, F.array(*letters)).otherwise(F.array(F.lit("c")))
    nodes = c.select(rev.alias("revision_id"), F.concat(F.lit("n"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("node_id"), F.col("i").alias("ord"), path.alias("workflow_path"))
    one = lambda to, o: F.struct(to.alias("to"), o.alias("ord"))
    arcs = F.array_compact(F.array(F.when(F.col("i") < 11, one(F.col("i") + 1, F.col("i") * 2)), F.when((F.col("i") + F.col("r")) % 4 == 0, one((F.col("i") * 5 + F.col("r")) % 11 + 1, F.col("i") * 2 + 1))))
    edges = c.select(rev.alias("revision_id"), F.concat(F.lit("n"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("from"), path.alias("workflow_path"), F.explode(arcs).alias("a"))
    return nodes, edges.select("revision_id", F.concat(F.lit("e"), F.col("a.ord").cast("string")).alias("edge_id"), "from", F.concat(F.lit("n"), F.lpad(F.col("a.to").cast("string"), 2, "0")).alias("to"), F.col("a.ord").alias("ord"), "workflow_path")


def known_edges(nodes: DataFrame, edges: DataFrame, forward: bool = False) -> DataFrame:
    """Edges between nodes that are there. Joined by shuffles: Spark takes the nodes for small by their compressed column, and
    would send them whole through the driver."""
    out = edges.join(nodes.select("revision_id", F.col("node_id").alias("to")).hint("merge"), ["revision_id", "to"], "left_semi")
    return out.filter(F.col("from") < F.col("to")) if forward else out


#: SQL of the graph: `gn`, all edges `ga`, those between known nodes `ge`.
GRAPH_SQL = """
g0 AS (SELECT c_custkey%12 AS i, c_custkey//12 AS r FROM customer),
gn AS (SELECT 'r' || r AS revision_id, 'n' || lpad(CAST(i AS VARCHAR), 2, '0') AS node_id, i AS ord, CASE WHEN i < 4 THEN '' WHEN i < 8 THEN 'a' WHEN i < 10 THEN 'a/b' ELSE 'c' END AS path, r FROM g0),
g1 AS (SELECT r, i, i+1 AS t, 2*i AS o FROM g0 WHERE i < 11 UNION ALL SELECT r, i, (5*i+r)%11+1, 2*i+1 FROM g0 WHERE (i+r)%4=0),
ga AS (SELECT 'r' || r AS revision_id, 'e' || o AS edge_id, 'n' || lpad(CAST(i AS VARCHAR), 2, '0') AS f, 'n' || lpad(CAST(t AS VARCHAR), 2, '0') AS t, o AS ord, CASE WHEN i < 4 THEN '' WHEN i < 8 THEN 'a' WHEN i < 10 THEN 'a/b' ELSE 'c' END AS path FROM g1),
ge AS (SELECT ga.* FROM ga JOIN gn ON gn.revision_id = ga.revision_id AND gn.node_id = ga.t)"""
