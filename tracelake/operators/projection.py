"""Trace projection of event journals (inventory D1-D9, D15, E1, E2, N1-N4).

All operators group by invocation_id first. `prepare` parses payloads once and deals the events out by invocation, and
Spark reuses that partitioning in each operator on its result. Sequences decide order, never clocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import PAYLOAD, TERMINAL_NODE

COUNTERS = ("operator_call_count", "failed_operator_call_count", "retry_count", "fallback_count", "timeout_count", "parallel_call_count", "streaming_call_count", "stream_chunk_count")


def prepare(events: DataFrame, through: int | None = None) -> DataFrame:
    """Events with the parsed payload `p`, the derived node, execution, edge and call ids, and `branch`, the first
    projection rule that applies. Repeats of (invocation_id, sequence) are dropped; later ones than `through` too."""
    rows = events if through is None else events.filter(F.col("sequence") <= through)
    rows = rows.select("invocation_id", "sequence", "event_type", "event_name", "subject_id", "occurred_at_ms", "elapsed_ns", "status", "timing_json", "payload_json")
    return derive(rows.repartition("invocation_id").dropDuplicates(["invocation_id", "sequence"]))


def derive(rows: DataFrame) -> DataFrame:
    """The columns that prepare() adds, for batches and streams."""
    name, p = F.col("event_name"), F.col("p")
    rows = rows.withColumn("p", F.from_json("payload_json", PAYLOAD)).drop("payload_json")
    branch = (
        F.when(name.startswith("invocation."), "invocation")
        .when(name.startswith("node."), "node")
        .when(name == "edge.evaluated", "edge")
        .when(name == "operator_call.completed", "call")
        .when(name == "wait.created", "wait_created")
        .when(name == "wait.resumed", "wait_resumed")
        .otherwise("other")
    )
    state = F.coalesce(F.when(name == "operator_call.completed", p["state"]), "status", F.substring_index(name, ".", -1))
    return (
        rows.withColumn("branch", branch)
        .withColumn("state", state)
        .withColumn("execution_id", p["node_execution_id"])
        .withColumn("node_id", F.when(F.col("branch") == "node", F.coalesce(p["node_id"], "subject_id")))
        .withColumn("call_id", F.when(F.col("branch") == "call", F.coalesce(p["operator_call_id"], "subject_id")))
    )


def _latest(*columns: str | Column) -> Column:
    return F.max_by(F.struct(*columns), "sequence").alias("last")


def project_node_executions(prepared: DataFrame) -> DataFrame:
    """A row for each execution: the latest node event decides state, error, times and timing; E1 numbers it."""
    nodes = prepared.filter((F.col("branch") == "node") & F.col("execution_id").isNotNull())
    out = nodes.groupBy("invocation_id", "execution_id").agg(
        F.min("sequence").alias("first_event_sequence"),
        F.max("sequence").alias("last_event_sequence"),
        F.max_by(F.when(F.col("state") == "running", F.col("occurred_at_ms")), F.when(F.col("state") == "running", F.col("sequence"))).alias("started_at_ms"),
        _latest("node_id", "state", F.to_json("p.error").alias("error"), "occurred_at_ms", "elapsed_ns", "timing_json"),
    )
    ended = F.when(F.col("last.state").isin(*TERMINAL_NODE), F.col("last.occurred_at_ms")).alias("ended_at_ms")
    out = out.select("invocation_id", "execution_id", "last.node_id", "first_event_sequence", "last_event_sequence", "last.state", "last.error", "started_at_ms", ended, "last.elapsed_ns", "last.timing_json")
    return execution_ordinals(out)


def execution_ordinals(executions: DataFrame) -> DataFrame:
    """1, 2, 3 ... of the executions of each node of an invocation, by their first event."""
    w = W.partitionBy("invocation_id", "node_id").orderBy("first_event_sequence", "execution_id")
    return executions.withColumn("ordinal", F.row_number().over(w).cast("long"))


def _counted_calls(prepared: DataFrame) -> DataFrame:
    """Calls of executions that a node event has begun before."""
    w = W.partitionBy("invocation_id", "execution_id").orderBy("sequence").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = F.min(F.when(F.col("branch") == "node", F.col("sequence"))).over(w)
    both = prepared.filter(F.col("branch").isin("node", "call") & F.col("execution_id").isNotNull())
    return both.withColumn("known", known).filter((F.col("branch") == "call") & F.col("known").isNotNull())


def operator_rollup(prepared: DataFrame) -> DataFrame:
    """Call counters of each execution. Calls are counted by event; parallel and streaming counts take the last
    event of each call id. Calls of executions that no node event has begun are not counted."""
    calls = _counted_calls(prepared)
    p = F.col("p")
    one = calls.groupBy("invocation_id", "execution_id", "call_id").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("state") != "completed").alias("failed"),
        F.count_if(p["reason"] == "retry").alias("retries"),
        F.count_if(p["reason"] == "fallback").alias("fallbacks"),
        F.count_if(p["error"]["code"] == "OPERATOR_TIMEOUT").alias("timeouts"),
        F.max("sequence").alias("at"),
        F.max_by(F.struct(F.coalesce(p["kind"], F.lit("direct")).alias("kind"), p["summary"].alias("summary"), p["streaming"].alias("streaming"), p["stream_chunk_count"].alias("chunks")), "sequence").alias("last"),
    )
    parallel = F.col("last.kind").isin("map", "replication")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return one.groupBy("invocation_id", "execution_id").agg(
        F.sum("calls").alias("operator_call_count"),
        F.sum("failed").alias("failed_operator_call_count"),
        F.sum("retries").alias("retry_count"),
        F.sum("fallbacks").alias("fallback_count"),
        F.sum("timeouts").alias("timeout_count"),
        F.sum(F.when(parallel, zero(F.col("last.summary.call_count"))).otherwise(0)).cast("long").alias("parallel_call_count"),
        F.sum(F.when(parallel, zero(F.col("last.summary.streaming_call_count"))).otherwise(zero(F.col("last.streaming").cast("long")))).cast("long").alias("streaming_call_count"),
        F.sum(F.when(parallel, zero(F.col("last.summary.stream_chunk_count"))).otherwise(zero(F.col("last.chunks")))).cast("long").alias("stream_chunk_count"),
        F.max_by("last.kind", "at").alias("latest_operator_kind"),
        F.max("at").alias("last_call_sequence"),
    )


def operator_states(prepared: DataFrame) -> DataFrame:
    """The last state of each call id, of known executions or not."""
    return prepared.filter("branch = 'call'").groupBy("invocation_id", "call_id").agg(F.max_by("state", "sequence").alias("state"))


def operator_calls(prepared: DataFrame) -> DataFrame:
    """The last event of each counted call, with its display name (first of id, joined ids, kind, `operator`)."""
    p = F.col("p")
    name = F.coalesce(p["operator_id"], F.nullif(F.array_join(p["operator_ids"], ", "), F.lit("")), p["kind"], F.lit("operator"))
    last = _counted_calls(prepared).groupBy("invocation_id", "execution_id", "call_id").agg(_latest("sequence", name.alias("operator_id"), F.coalesce(p["kind"], F.lit("direct")).alias("kind"), p["reason"].alias("reason"), "state", "occurred_at_ms", "elapsed_ns"))
    return last.select("invocation_id", "execution_id", "call_id", "last.*")


def project_nodes(prepared: DataFrame) -> DataFrame:
    """A row for each node: the latest execution, the latest occurrence, counts, and the call summary of the
    execution that was touched last."""
    executions = project_node_executions(prepared)
    rollup = operator_rollup(prepared)
    top = executions.groupBy("invocation_id", "node_id").agg(
        F.count("*").alias("execution_count"),
        F.max_by(F.struct("execution_id", "state", "error", "elapsed_ns", "timing_json"), F.struct("ordinal", "execution_id")).alias("x"),
    )
    seen = prepared.filter("branch = 'node'").groupBy("invocation_id", "node_id").agg(
        F.count_if(F.col("event_name") == "node.skipped").alias("skipped_count"),
        F.max_by(F.when(F.col("event_name") == "node.skipped", F.struct(F.col("p.node_instance_key").alias("key"))), F.when(F.col("event_name") == "node.skipped", F.col("sequence"))).alias("skip"),
        F.max("sequence").alias("latest_occurrence_sequence"),
        _latest("state", F.to_json("p.error").alias("error"), "elapsed_ns", "timing_json"),
    )
    called = rollup.join(executions.select("invocation_id", "execution_id", "node_id"), ["invocation_id", "execution_id"])
    touched = called.groupBy("invocation_id", "node_id").agg(F.max_by(F.struct(*COUNTERS, "latest_operator_kind", "last_call_sequence"), "last_call_sequence").alias("t"))
    own = called.select("invocation_id", F.col("execution_id").alias("latest_id"), F.struct(*COUNTERS, "latest_operator_kind", "last_call_sequence").alias("own"))
    rows = seen.join(top, ["invocation_id", "node_id"], "left").join(touched, ["invocation_id", "node_id"], "left").withColumn("latest_id", F.col("x.execution_id")).join(own, ["invocation_id", "latest_id"], "left")
    counted = F.when(F.col("t.last_call_sequence") > F.col("latest_occurrence_sequence"), F.col("t")).otherwise(F.col("own"))
    rows = rows.withColumn("calls", counted)
    real = F.col("x").isNotNull()
    pick = lambda f: F.when(real, F.col(f"x.{f}")).otherwise(F.col(f"last.{f}"))
    return rows.select(
        "invocation_id", "node_id", pick("state").alias("state"), F.col("last.state").alias("latest_occurrence_state"), "latest_occurrence_sequence",
        F.col("skip.key").alias("latest_skipped_instance_key"), F.col("latest_id").alias("latest_execution_id"), F.coalesce("execution_count", F.lit(0)).cast("long").alias("execution_count"), "skipped_count",
        pick("error").alias("latest_error"), pick("elapsed_ns").alias("latest_elapsed_ns"), pick("timing_json").alias("latest_timing"),
        *[F.coalesce(f"calls.{c}", F.lit(0)).cast("long").alias(c) for c in COUNTERS], F.col("calls.latest_operator_kind").alias("latest_operator_kind"),
    )


def project_edges(prepared: DataFrame) -> DataFrame:
    """D3: lifetime counters and the last decision of each edge. A decision without `selected` isn't one."""
    p, edge = F.col("p"), F.coalesce(F.col("p.edge_id"), "subject_id")
    state = F.coalesce(p["state"], "status", F.lit("evaluated"))
    selected = F.coalesce(p["selected"], F.lit(False))
    rows = prepared.filter("branch = 'edge'").select("invocation_id", "sequence", edge.alias("edge_id"), state.alias("s"), selected.alias("yes"), p["source_execution_id"].alias("source_execution_id"), p["target_node_id"].alias("target_node_id"), p["reason"].alias("reason"), "elapsed_ns")
    out = rows.groupBy("invocation_id", "edge_id").agg(
        F.count("*").alias("evaluation_count"), F.count_if("yes").alias("selected_count"), F.count_if(F.col("s") == "skipped").alias("skipped_count"), F.count_if(F.col("s") == "failed").alias("failed_count"),
        F.max("sequence").alias("latest_evaluation_sequence"), _latest("s", "yes", "source_execution_id", "target_node_id", "reason", "elapsed_ns"),
    )
    whole = F.when(F.col("failed_count") > 0, "failed").when(F.col("selected_count") > 0, "selected").otherwise(F.col("last.s"))
    return out.select("invocation_id", "edge_id", whole.alias("state"), F.col("last.s").alias("latest_state"), "latest_evaluation_sequence", (F.col("selected_count") > 0).alias("selected"), F.col("last.yes").alias("latest_selected"), "evaluation_count", "selected_count", "skipped_count", "failed_count", "last.source_execution_id", "last.target_node_id", "last.reason", "last.elapsed_ns")


def active_waits(prepared: DataFrame) -> DataFrame:
    """Waits created and not resumed since. `waits` of the payload, or else its `wait_keys`."""
    p = F.col("p")
    bare = F.transform(p["wait_keys"], lambda k: F.struct(k.alias("wait_key"), F.lit(None).cast("string").alias("node_execution_id"), F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("wait_type"), F.lit(None).cast("string").alias("payload")))
    made = prepared.filter("branch = 'wait_created'").select("invocation_id", "sequence", "occurred_at_ms", F.explode(F.when(F.size(p["waits"]) > 0, p["waits"]).otherwise(bare)).alias("w")).select("invocation_id", "sequence", F.col("occurred_at_ms").alias("created_at_ms"), "w.wait_key", "w.wait_type", "w.node_id", F.lit(True).alias("open"))
    ended = prepared.filter((F.col("branch") == "wait_resumed") & p["wait_key"].isNotNull()).select("invocation_id", "sequence", F.col("occurred_at_ms").alias("created_at_ms"), p["wait_key"].alias("wait_key"), F.lit(None).cast("string").alias("wait_type"), F.lit(None).cast("string").alias("node_id"), F.lit(False).alias("open"))
    last = made.union(ended).groupBy("invocation_id", "wait_key").agg(_latest("open", "created_at_ms", "wait_type", "node_id"))
    return last.filter("last.open").select("invocation_id", "wait_key", "last.created_at_ms", "last.wait_type", "last.node_id")


def invocation_states(prepared: DataFrame) -> DataFrame:
    """The last of invocation events, created waits and interrupting recoveries; `created` if there is none."""
    told = F.when(F.col("branch") == "invocation", F.col("state")).when(F.col("branch") == "wait_created", "waiting").when((F.col("branch") == "other") & (F.col("event_type") == "recovery") & F.col("event_name").endswith("interrupted"), "interrupted")
    out = prepared.withColumn("told", told).groupBy("invocation_id").agg(F.max_by("told", F.when(F.col("told").isNotNull(), F.col("sequence"))).alias("state"), F.max("sequence").alias("through_sequence"))
    return out.select("invocation_id", F.coalesce("state", F.lit("created")).alias("state"), "through_sequence")


def latest_phase(prepared: DataFrame) -> DataFrame:
    """The last phase event that no other rule has taken."""
    rows = prepared.filter((F.col("branch") == "other") & (F.col("event_type") == "phase"))
    return rows.groupBy("invocation_id").agg(_latest("event_name", "subject_id", "status", "occurred_at_ms", "elapsed_ns")).select("invocation_id", "last.*")


def latest_sequences(invocations: DataFrame, events: DataFrame, user_events: DataFrame) -> DataFrame:
    """The largest sequence of each invocation in both journals, 0 where it has none."""
    top = lambda df, name: df.groupBy(F.col("invocation_id").alias("id")).agg(F.max("sequence").alias(name))
    out = invocations.select("id").join(top(events, "runtime"), "id", "left").join(top(user_events, "user"), "id", "left")
    return out.select(F.col("id").alias("invocation_id"), F.coalesce("runtime", F.lit(0)).alias("latest_sequence"), F.coalesce("user", F.lit(0)).alias("latest_user_sequence"))


def journal_gaps(events: DataFrame, start: int = 0) -> DataFrame:
    """The first event of each invocation after `start` whose sequence doesn't follow the one before."""
    w = W.partitionBy("invocation_id").orderBy("sequence")
    rows = events.filter(F.col("sequence") > start).select("invocation_id", "sequence")
    rows = rows.withColumn("expected", F.coalesce(F.lag("sequence").over(w), F.lit(start)) + 1).filter("sequence <> expected")
    return rows.groupBy("invocation_id").agg(F.min_by("expected", "sequence").alias("expected"), F.min("sequence").alias("got"))


def invocation_results(executions: DataFrame, exits: DataFrame, outputs: DataFrame) -> DataFrame:
    """The output of the latest execution of each exit node, if it is completed: {"output": v}, or {"outputs": {node: v}}
    for several. executions of D1; exits (node_id); outputs (execution_id, output_json)."""
    last = executions.join(exits, "node_id", "left_semi").groupBy("invocation_id", "node_id").agg(F.max_by(F.struct("execution_id", "state"), F.struct("ordinal", "execution_id")).alias("x")).filter("x.state = 'completed'")
    rows = last.select("invocation_id", "node_id", "x.execution_id").join(outputs, ["invocation_id", "execution_id"], "left")
    quoted = F.regexp_extract(F.to_json(F.array("node_id")), r"(?s)^\[(.*)\]$", 1)
    pair = F.concat(quoted, F.lit(":"), F.coalesce("output_json", F.lit("null")))
    out = rows.groupBy("invocation_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(pair)).alias("pairs"), F.first(F.coalesce("output_json", F.lit("null"))).alias("only"))
    return out.select("invocation_id", F.when(F.col("n") == 1, F.concat(F.lit('{"output":'), F.col("only"), F.lit("}"))).otherwise(F.concat(F.lit('{"outputs":{'), F.array_join("pairs", ","), F.lit("}}"))).alias("result_json"))


def timeline_spans(executions: DataFrame, invocations: DataFrame) -> DataFrame:
    """A span for each execution; it starts with the invocation where no start is known. Milliseconds as double."""
    out = executions.join(invocations.select(F.col("id").alias("invocation_id"), "created_at_ms"), "invocation_id")
    return out.select("invocation_id", "execution_id", "node_id", "state", F.coalesce("started_at_ms", "created_at_ms").alias("start_ms"), F.col("ended_at_ms").alias("end_ms"), (F.col("elapsed_ns") / 1e6).alias("duration_ms"), F.col("first_event_sequence").alias("span_order"))


def operator_spans(calls: DataFrame) -> DataFrame:
    """Calls end when they are told and start their elapsed time before; numbered in each execution."""
    w = W.partitionBy("invocation_id", "execution_id").orderBy("sequence")
    return calls.select("invocation_id", "execution_id", "call_id", (F.col("occurred_at_ms") - F.coalesce("elapsed_ns", F.lit(0)) / 1e6).alias("start_ms"), F.col("occurred_at_ms").alias("end_ms"), F.row_number().over(w).cast("long").alias("call_number"))


def timeline_range(spans: DataFrame, events: DataFrame, invocations: DataFrame) -> DataFrame:
    """From the invocation's creation to its last event or span's end, at least 1 ms later."""
    last = events.groupBy("invocation_id").agg(F.max("occurred_at_ms").alias("e"))
    ends = spans.groupBy("invocation_id").agg(F.max(F.coalesce("end_ms", "start_ms")).alias("s"))
    out = invocations.select(F.col("id").alias("invocation_id"), F.col("created_at_ms").alias("start_ms")).join(last, "invocation_id", "left").join(ends, "invocation_id", "left")
    return out.select("invocation_id", "start_ms", F.greatest(F.col("start_ms") + 1, "e", "s").alias("end_ms"))


def timing_breakdown(events: DataFrame) -> DataFrame:
    """The finite entries of each event's timing, largest first, with their share of the largest of the elapsed time,
    the entries and 1."""
    rows = events.select("invocation_id", "sequence", "elapsed_ns", F.explode(F.from_json("timing_json", "map<string,double>")).alias("name", "ns"))
    rows = rows.filter(F.col("ns").isNotNull() & ~F.isnan("ns") & (F.abs("ns") < float("inf")))
    w = W.partitionBy("invocation_id", "sequence")
    most = F.greatest(F.coalesce("elapsed_ns", F.lit(0)).cast("double"), F.max("ns").over(w), F.lit(1.0))
    return rows.select("invocation_id", "sequence", "name", "ns", (F.col("ns") / most).alias("share"), F.row_number().over(w.orderBy(F.desc("ns"), "name")).cast("long").alias("rank"))
