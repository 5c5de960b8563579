"""Audits of recorded runs (inventory C6, C7, C9, D10-D14, D17, D20, E4, E7-E10, J10-J13, L10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: The counters of a resource usage, in nanoseconds.
USAGE = ("duration_ns", "execution_ns", "concurrency_wait_ns", "thread_pool_queue_ns", "retry_backoff_ns", "stream_consumption_ns", "stream_reduction_ns")


def snapshot_asof(genesis: DataFrame, recovery: DataFrame, targets: DataFrame) -> DataFrame:
    """The newest snapshot (invocation_id, event_sequence, state_json) at or before each target (invocation_id,
    target_sequence); the genesis state counts as sequence 0. A target without a snapshot has nulls. Snapshots and targets
    are read once in order, so no target meets all snapshots."""
    snap = lambda df, at: df.select("invocation_id", at.alias("at"), F.lit(0).alias("kind"), F.struct(at.alias("event_sequence"), "state_json").alias("s"))
    both = snap(genesis, F.lit(0).cast("long")).union(snap(recovery, F.col("event_sequence").cast("long")))
    t = targets.select("invocation_id", F.col("target_sequence").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(both.schema["s"].dataType).alias("s")).distinct()
    newest = F.last("s", ignorenulls=True).over(W.partitionBy("invocation_id").orderBy("at", "kind", "s").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = both.union(t).withColumn("s", newest).filter("kind = 1")
    return rows.select("invocation_id", F.col("at").alias("target_sequence"), F.col("s.event_sequence").alias("snapshot_sequence"), "s.state_json")


def incoming_outputs(activations: DataFrame, executions: DataFrame) -> DataFrame:
    """Each selected activation (execution_id, position, edge_id, source_execution_id) with the output of its source; an
    unknown source is an error."""
    src = executions.select(F.col("execution_id").alias("source_execution_id"), F.col("output_json").alias("value"), F.lit(True).alias("_known"))
    rows = activations.join(src, "source_execution_id", "left")
    return rows.select("execution_id", "position", "edge_id", "source_execution_id", "value", F.when(F.col("_known").isNull(), "unknown_source").alias("error"))


def context_conflicts(writes: DataFrame) -> DataFrame:
    """Writes (context_id, write_id, base_revision, revision, path) that overlap an earlier one of a later revision than
    their base: equal paths, or one above the other. (context_id, write_id, path, other_id).

    Each path is expanded to itself and all above it, so both cases are equi-joins and no pair of a context meets that
    doesn't share a path.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    w = writes.select("context_id", "write_id", "base_revision", "revision", "path")
    up = w.select("*", F.explode(ups).alias("at"))
    other = w.select("context_id", F.col("write_id").alias("other_id"), F.col("revision").alias("other_revision"), F.col("path").alias("at"))
    other_up = up.select("context_id", F.col("write_id").alias("other_id"), F.col("revision").alias("other_revision"), "at")
    below = up.join(other, ["context_id", "at"])  # the other path is this one, or above it
    above = w.withColumn("at", F.col("path")).join(other_up, ["context_id", "at"])  # the other path is this one, or below it
    both = below.select("context_id", "write_id", "path", "base_revision", "revision", "other_id", "other_revision").union(above.select("context_id", "write_id", "path", "base_revision", "revision", "other_id", "other_revision"))
    return both.filter("other_id <> write_id AND other_revision > base_revision AND other_revision < revision").select("context_id", "write_id", "path", "other_id").distinct()


def newest_conflicts(writes: DataFrame) -> DataFrame:
    """C9 without pairs: (context_id, write_id, path, other_id, other_revision) of each write that conflicts, with the newest
    other that it conflicts with: the greatest revision below its own, of overlapping paths, if that is above its base.

    Each write is a row at its path and at all above it. In the order of revisions a running maximum at a path knows the
    newest write of it and the newest of it or below; a write asks for the first at what is above it, and for the second
    at its own path. So a path with a million writes is sorted once, and nothing meets. Writes of one revision don't see
    each other; of several newest ones the greatest write_id is told."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = writes.select("context_id", "write_id", "base_revision", "revision", "path", F.explode(ups).alias("at")).withColumn("own", F.col("at") == F.col("path"))
    before = W.partitionBy("context_id", "at").orderBy("revision").rangeBetween(W.unboundedPreceding, -1)
    one = F.struct(F.col("revision").alias("r"), F.col("write_id").alias("id"))
    newest = F.when(F.col("own"), F.max(one).over(before)).otherwise(F.max(F.when(F.col("own"), one)).over(before))
    out = rows.withColumn("newest", newest).groupBy("context_id", "write_id", "path", "base_revision").agg(F.max("newest").alias("n"))
    return out.filter("n.r > base_revision").select("context_id", "write_id", "path", F.col("n.id").alias("other_id"), F.col("n.r").alias("other_revision"))


def parallel_summary(attempts: DataFrame, units: DataFrame) -> DataFrame:
    """A summary of each execution's parallel calls. attempts (execution_id, seq, operator_id, reason, error_code,
    duration_ns, streaming, chunks, started_at_ms, ended_at_ms); units (execution_id, unit_id, state)."""
    u = units.groupBy("execution_id").agg(F.count("*").alias("call_count"), F.count_if(F.col("state") == "completed").alias("success_count"), F.count_if(F.col("state") == "failed").alias("failure_count"))
    one = attempts.groupBy("execution_id", "operator_id").agg(
        F.count("*").alias("attempt_count"), F.count_if(F.col("reason") == "retry").alias("retry_count"), F.count_if(F.col("reason") == "fallback").alias("fallback_count"),
        F.sum("duration_ns").alias("total_duration_ns"), F.min("duration_ns").alias("min_duration_ns"), F.max("duration_ns").alias("max_duration_ns"),
        F.count_if("streaming").alias("streaming_call_count"), F.sum("chunks").alias("stream_chunk_count"),
        F.min("started_at_ms").alias("started_at_ms"), F.max(F.coalesce("ended_at_ms", "started_at_ms")).alias("ended_at_ms"), F.min("seq").alias("s"),
    )
    of = {"min": F.min, "max": F.max, "sta": F.min, "end": F.max}
    a = one.groupBy("execution_id").agg(*[of.get(c[:3], F.sum)(c).alias(c) for c in one.columns[2:-1]], F.transform(F.array_sort(F.collect_list(F.struct("s", "operator_id"))), lambda x: x["operator_id"]).alias("operator_ids"))
    n = F.row_number().over(W.partitionBy("execution_id").orderBy("seq", "error_code", "operator_id"))
    eight = attempts.filter("error_code IS NOT NULL").select("execution_id", "seq", "error_code", "operator_id").withColumn("n", n).filter("n <= 8")
    first = eight.groupBy("execution_id").agg(F.array_sort(F.collect_list(F.struct("seq", "error_code", "operator_id"))).alias("failure_samples"))
    none = F.array().cast(first.schema["failure_samples"].dataType)
    rows = u.join(a.join(first, "execution_id", "left").withColumn("failure_samples", F.coalesce("failure_samples", none)), "execution_id", "full")
    zero = {c: 0 for c in ("call_count", "success_count", "failure_count", "attempt_count", "retry_count", "fallback_count", "streaming_call_count", "stream_chunk_count", "total_duration_ns")}
    return rows.fillna(zero).withColumn("cancelled_count", F.greatest(F.lit(0), F.col("call_count") - F.col("success_count") - F.col("failure_count")))


def resource_usage(attempts: DataFrame) -> DataFrame:
    """Sums of the seven usage counters (USAGE) of each execution, nulls being 0, and whole milliseconds of its duration.
    A counter that the attempts lack is an error."""
    out = attempts.groupBy("execution_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in USAGE])
    return out.withColumn("duration_ms", F.expr("duration_ns div 1000000"))


def resource_violations(executions: DataFrame, attempts: DataFrame, policies: DataFrame) -> DataFrame:
    """The first breach of each limit of a node (invocation_id, node_id): the execution or attempt that would exceed
    the count (reported with the count it would make), or the execution that ends with more runtime than allowed.

    executions (invocation_id, node_id, execution_id, sequence, duration_ms, started_at_ms, ended_at_ms); attempts
    (invocation_id, node_id, execution_id, seq); policies (node_id, max_executions, max_attempts, max_runtime_ms).
    """
    own = W.partitionBy("invocation_id", "node_id")
    p = policies
    e = executions.join(p, "node_id").withColumn("n", F.row_number().over(own.orderBy("sequence")).cast("long"))
    usage = F.when(F.coalesce("duration_ms", F.lit(0)) != 0, F.col("duration_ms")).otherwise(F.greatest(F.lit(0), F.coalesce(F.col("ended_at_ms") - F.col("started_at_ms"), F.lit(0))))
    e = e.withColumn("total", F.sum(usage).over(own.orderBy("sequence").rowsBetween(W.unboundedPreceding, W.currentRow)))
    a = attempts.join(p, "node_id").withColumn("n", F.row_number().over(own.orderBy("seq")).cast("long"))

    def first(rows: DataFrame, limit: str, actual: str, order: str, label: str) -> DataFrame:
        over = rows.filter(F.col(actual) > F.col(limit))
        return over.groupBy("invocation_id", "node_id").agg(F.min_by(F.struct(F.col(actual).cast("long").alias("actual"), F.col(limit).cast("long").alias("limit"), "execution_id"), order).alias("v")).select("invocation_id", "node_id", F.lit(label).alias("kind"), "v.actual", "v.limit", "v.execution_id")

    return first(e, "max_executions", "n", "sequence", "executions").union(first(a, "max_attempts", "n", "seq", "attempts")).union(first(e, "max_runtime_ms", "total", "sequence", "runtime_ms"))


def journal_size(events: DataFrame, columns: tuple[str, ...] = ("timing_json", "payload_json", "input_json", "output_json", "operations_json")) -> DataFrame:
    """Rows and characters of JSON by event type, and in total (event_type null)."""
    size = sum((F.length(F.coalesce(c, F.lit(""))) for c in columns), F.lit(0)).cast("long")
    return events.withColumn("_size", size).rollup("event_type").agg(F.count("*").alias("rows"), F.sum("_size").alias("json_chars"))


#: By part of a journal: its table and the columns that are its size.
SIZED = {
    "runtime_events": ("runtime_events", ("timing_json", "payload_json", "input_json", "output_json", "operations_json")),
    "user_events": ("user_events", ("data_json", "workflow_path_json")),
    "invocations": ("invocations", ("input_json", "result_json", "error_json", "genesis_state_json")),
    "genesis": ("invocations", ("genesis_state_json",)),
    "context": ("sessions", ("context_json",)),
    "recovery": ("runtime_recovery_states", ("state_json",)),
    "artifacts": ("artifacts", ("payload_blob",)),
}


def journal_sizes(journal: dict[str, DataFrame]) -> DataFrame:
    """D13 over all tables: (part, rows, size) for each part of SIZED whose table the journal has: its rows, and the characters
    of its JSON columns or the bytes of its payloads. Each part is one aggregate with map-side sums."""
    out = None
    for part, (table, columns) in SIZED.items():
        if table in journal:
            size = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")
            one = journal[table].agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).select(F.lit(part).alias("part"), "rows", "size")
            out = one if out is None else out.union(one)
    return out


#: Blocks that the range of a group's values is cut into.
VALUE_BLOCKS = 4096


def latency_stats(runs: DataFrame, group: str, value: str, p: float = 0.95) -> DataFrame:
    """Count, median, lower-index percentile (element int((n-1)*p) in order) and runs per second of each group.

    Exact, without ordering a group: equal values are counted, the counts are summed by blocks of the group's range, and
    only the blocks that hold a wanted element are ordered. Rows without a value are left out.
    """
    counts = cut(runs.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c")))
    sums = cut(counts.groupBy("g").agg(F.sum("c").alias("runs"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("v") * F.col("c")).alias("total")))
    same = lambda a, b: F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))
    block = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * VALUE_BLOCKS)).otherwise(0)
    blocked = counts.alias("c").join(sums.alias("s"), same("c", "s")).select("c.g", "v", "c", block.alias("b"))
    ends = F.sum("n").over(W.partitionBy("g").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow))
    by_block = blocked.groupBy("g", "b").agg(F.sum("c").alias("n")).withColumn("end", ends)
    last = F.col("runs") - 1
    wanted = sums.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), at.cast("long").alias("at")) for k, at in enumerate((F.floor(last * p), F.floor(last / 2), F.ceil(last / 2)))])).alias("w")).select("g", "w.k", "w.at")
    hit = wanted.alias("w").join(by_block.alias("b"), same("w", "b") & (F.col("at") < F.col("end")) & (F.col("at") >= F.col("end") - F.col("n"))).select("w.g", "k", "at", "b", (F.col("end") - F.col("n")).alias("before"))
    upto = F.col("before") + F.sum("c").over(W.partitionBy("h.g", "k").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = hit.alias("h").join(blocked.alias("c"), same("h", "c") & (F.col("h.b") == F.col("c.b"))).select("h.g", "k", "at", "v", upto.alias("upto")).filter("upto > at")
    found = inside.groupBy("g").agg(*[F.min(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(3)])
    out = sums.alias("s").join(found.alias("f"), same("s", "f"))
    return out.select(F.col("s.g").alias(group), "runs", ((F.col("v1") + F.col("v2")) / 2).alias("median"), F.col("v0").alias("p95"), F.when(F.col("total") > 0, F.col("runs") * 1000 / F.col("total")).alias("runs_per_s"))


def latency_change(stats: DataFrame, baseline: DataFrame, group: str) -> DataFrame:
    """D14 against a baseline: stats (of latency_stats) with the change of the median and of the throughput in percent against
    `baseline`, one row of the same columns; null where that is zero or not there."""
    base = baseline.select(F.col("median").alias("_median"), F.col("runs_per_s").alias("_rate")).limit(1)
    rows = stats.withColumn("_one", F.lit(1)).join(F.broadcast(base.withColumn("_one", F.lit(1))), "_one", "left")
    change = lambda now, old: (F.try_divide(F.col(now), F.col(old)) - 1) * 100
    return rows.withColumns({"latency_change_percent": change("median", "_median"), "throughput_change_percent": change("runs_per_s", "_rate")}).drop("_one", "_median", "_rate")


def diagnostic_summary(diagnostics: DataFrame, group: str) -> DataFrame:
    """Counts by severity, and whether there is no error."""
    out = diagnostics.groupBy(group).pivot("severity", ["error", "warning", "info"]).count().fillna(0, ["error", "warning", "info"])
    return out.select(group, (F.col("error") == 0).alias("ok"), F.col("error").alias("errors"), F.col("warning").alias("warnings"), F.col("info").alias("infos"))


def output_view(executions: DataFrame, viewers: DataFrame) -> DataFrame:
    """For each viewer (invocation_id, viewer_sequence) and node the completed outputs it sees: the latest value, and
    how many there are. executions (invocation_id, node_id, sequence, state, output_json).

    One ordered pass over executions and viewers together: running aggregates carry each node's outputs forward.
    """
    done = executions.filter("state = 'completed'").select("invocation_id", "node_id", "sequence", "output_json", F.lit(0).alias("_viewer"))
    nodes = done.select("invocation_id", "node_id").distinct()
    asks = viewers.select("invocation_id", F.col("viewer_sequence").alias("sequence")).distinct().join(nodes, "invocation_id").select("invocation_id", "node_id", "sequence", F.lit(None).cast("string").alias("output_json"), F.lit(1).alias("_viewer"))
    w = W.partitionBy("invocation_id", "node_id").orderBy("sequence", "_viewer").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = done.unionByName(asks).withColumn("latest", F.last(F.when(F.col("_viewer") == 0, F.struct("sequence", "output_json")), ignorenulls=True).over(w)).withColumn("visible", F.sum(1 - F.col("_viewer")).over(w))
    return rows.filter("_viewer = 1 AND visible > 0").select("invocation_id", F.col("sequence").alias("viewer_sequence"), "node_id", F.col("latest.output_json").alias("latest"), F.col("latest.sequence").alias("latest_sequence"), F.col("visible").alias("all_count"))


def output_lists(executions: DataFrame, viewers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E4 as lists: (outputs, views). outputs has the completed outputs of each invocation once, in order: `place` in its
    timeline and `node_place` among its node's. views (invocation_id, viewer_sequence, seen) tells how many of the timeline a
    viewer sees; so a viewer's lists are the places up to `seen`, and viewers times outputs is never built."""
    own = W.partitionBy("invocation_id").orderBy("sequence")
    done = executions.filter("state = 'completed'")
    outputs = done.select("invocation_id", "node_id", "sequence", "output_json", F.row_number().over(own).cast("long").alias("place"), F.row_number().over(W.partitionBy("invocation_id", "node_id").orderBy("sequence")).cast("long").alias("node_place"))
    one = lambda df, at, viewer: df.select("invocation_id", at.alias("sequence"), F.lit(viewer).alias("_viewer"))
    both = one(done, F.col("sequence"), 0).union(one(viewers, F.col("viewer_sequence"), 1).distinct())
    seen = F.sum(1 - F.col("_viewer")).over(W.partitionBy("invocation_id").orderBy("sequence", "_viewer").rowsBetween(W.unboundedPreceding, W.currentRow))
    return outputs, both.withColumn("seen", seen).filter("_viewer = 1").select("invocation_id", F.col("sequence").alias("viewer_sequence"), "seen")


def read_outputs(outputs: DataFrame, views: DataFrame, asks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """E4, `all` and `timeline`: the outputs that each asked viewer sees, in order by `place`. asks (invocation_id,
    viewer_sequence, node): a node id or an alias (aliases: alias, node_id) for `all`, null for the whole timeline. Only what
    is asked for is listed; a node that isn't known has no rows."""
    rows = asks.join(views, ["invocation_id", "viewer_sequence"])
    if aliases is not None:
        rows = rows.join(aliases.select(F.col("alias").alias("node"), F.col("node_id").alias("_real")), "node", "left").withColumn("_node", F.coalesce("_real", "node")).drop("_real")
    else:
        rows = rows.withColumn("_node", F.col("node"))
    joined = rows.join(outputs, "invocation_id").filter((F.col("place") <= F.col("seen")) & (F.col("_node").isNull() | (F.col("_node") == F.col("node_id"))))
    return joined.select("invocation_id", "viewer_sequence", "node", "node_id", "place", "sequence", "output_json")


def rank_candidates(operators: DataFrame, policies: DataFrame) -> DataFrame:
    """Candidates of each capability in the order they are tried. operators (capability_id, operator_id, priority,
    enabled, is_default); policies (capability_id, mode, preferred array, excluded array, allow_fallback). A capability
    with no candidate left has one row with a null operator and an error. A capability has one policy; its lists are joined as
    rows, so that no candidate carries or scans them."""
    key = ["capability_id", "operator_id"]
    rows = policies.drop("preferred", "excluded").join(operators.filter("enabled AND operator_id IS NOT NULL"), "capability_id")
    places = policies.select("capability_id", F.posexplode("preferred").alias("_at", "operator_id")).groupBy(*key).agg(F.min("_at").alias("_at"))
    kept = rows.join(policies.select("capability_id", F.explode("excluded").alias("operator_id")), key, "left_anti").join(places, key, "left")
    at = F.coalesce(F.col("_at") + 1, F.lit(0))
    preferred = F.when(at > 0, at).otherwise(1 << 30)
    default = F.when(F.col("mode") == "default", F.when(F.col("is_default"), 0).otherwise(1)).otherwise(0)
    priority = F.when(F.col("mode") == "first_available", 0).otherwise(-F.col("priority"))
    w = W.partitionBy("capability_id").orderBy(preferred, default, priority, "operator_id")
    ranked = kept.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("allow_fallback") | (F.col("rank") == 1)).select("capability_id", "operator_id", "rank", F.lit(None).cast("string").alias("error"))
    none = policies.join(kept.select("capability_id").distinct(), "capability_id", "left_anti").select("capability_id", F.lit(None).cast("string").alias("operator_id"), F.lit(None).cast("long").alias("rank"), F.lit("CAPABILITY_UNAVAILABLE").alias("error"))
    return ranked.union(none)


def burst_clusters(events: DataFrame, gap_ms: int) -> DataFrame:
    """Events with the number of their cluster in the invocation; one begins where the last event is `gap_ms` or more ago."""
    w = W.partitionBy("invocation_id").orderBy("occurred_at_ms", "sequence")
    new = F.coalesce((F.col("occurred_at_ms") - F.lag("occurred_at_ms").over(w) >= gap_ms).cast("long"), F.lit(1))
    return events.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def recovery_requeue(executions: DataFrame, policies: DataFrame, modes: DataFrame) -> DataFrame:
    """What recovery does with each active execution. executions (invocation_id, execution_id, node_id, sequence, state,
    recovery_attempt, idempotency_key); policies (node_id, mode, max_attempts); modes (invocation_id, failure_mode). Under
    fail_fast the first rejection interrupts the invocation: what comes after it is not handled."""
    rows = executions.filter(F.col("state").isin("created", "ready", "running")).join(policies.withColumn("_p", F.lit(True)), "node_id", "left").join(modes, "invocation_id", "left")
    rejected = F.when(F.col("_p").isNull(), "absent_node").when(F.col("mode").isNull() | (F.col("mode") == "never"), "not_permitted").when(F.col("recovery_attempt") >= F.col("max_attempts"), "attempts_exhausted")
    rows = rows.withColumn("rejection", rejected)
    before = W.partitionBy("invocation_id").orderBy("sequence", "execution_id").rowsBetween(W.unboundedPreceding, -1)
    stopped = (F.col("failure_mode") == "fail_fast") & F.coalesce(F.max(F.col("rejection").isNotNull().cast("int")).over(before), F.lit(0)).cast("boolean")
    rows = rows.withColumn("_stopped", F.coalesce(stopped, F.lit(False)))
    action = F.when(F.col("_stopped"), "not_handled").when(F.col("rejection").isNull(), "requeue").when(F.col("failure_mode") == "fail_fast", "interrupt_invocation").otherwise("reject")
    go = ~F.col("_stopped") & F.col("rejection").isNull()
    return rows.select("invocation_id", "execution_id", "node_id", action.alias("action"), "rejection", F.when(go, F.col("recovery_attempt") + 1).alias("next_attempt"), F.when(go, F.coalesce("idempotency_key", "execution_id")).alias("idempotency_key"))


def peak_parallelism(intervals: DataFrame) -> DataFrame:
    """The most attempts of an execution at one time; an end at some time frees before a start at that time."""
    steps = intervals.select("execution_id", F.explode(F.array(F.struct(F.col("started_at_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("ended_at_ms").alias("t"), F.lit(-1).alias("d")))).alias("s")).select("execution_id", "s.t", "s.d")
    steps = steps.groupBy("execution_id", "t", "d").agg(F.sum("d").alias("n"))
    w = W.partitionBy("execution_id").orderBy("t", "d").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn("live", F.sum("n").over(w)).groupBy("execution_id").agg(F.max("live").alias("peak"))


def fan_in_status(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Of each node instance (scope_key, node): pending while an incoming edge is undecided, else ready if one is
    selected, else skipped. edges (edge_id, to); decisions (scope_key, edge_id, selected). A scope asks for all nodes one of
    whose edges it has decided."""
    touched = decisions.join(edges, "edge_id").select("scope_key", "to").distinct()
    rows = touched.join(edges, "to").join(decisions, ["scope_key", "edge_id"], "left")
    out = rows.groupBy("scope_key", "to").agg(F.count("*").alias("incoming"), F.count("selected").alias("decided"), F.coalesce(F.bool_or("selected"), F.lit(False)).alias("any"))
    return out.select("scope_key", F.col("to").alias("node_id"), "incoming", "decided", F.when(F.col("decided") < F.col("incoming"), "pending").when(F.col("any"), "ready").otherwise("skipped").alias("status"))


def fan_in_loops(edges: DataFrame, decisions: DataFrame, headers: DataFrame) -> DataFrame:
    """J10 with loops: the status of each node instance (invocation_id, scope, node_id), as fan_in_status tells it, where
    loops are entered and repeated.

    edges (edge_id, to); decisions (invocation_id, scope, edge_id, selected), by the scope of the edge's target: an array of
    struct<loop_id, iteration>, the outermost loop first. headers (node_id, loop_id, edge_id, role): the entry and back
    edges of each loop's header, as natural_loops gives them. In iteration 0 a header waits for its loop's entry edges
    alone, later for its back edges alone; any other node waits for all its edges. A header that nothing has selected in
    iteration 0 is `loop_skipped`: the loop as a whole is (propagate_skips takes it from there).

    Each instance meets its own node's edges only; what is decided is joined to them by (scope, edge).
    """
    told = decisions.groupBy("invocation_id", "scope", "edge_id").agg(F.bool_or("selected").alias("selected"))
    touched = told.join(edges, "edge_id").select("invocation_id", "scope", F.col("to").alias("node_id")).distinct()
    own = headers.groupBy("node_id").agg(F.first("loop_id").alias("loop_id"))
    rows = touched.join(own, "node_id", "left")
    frame = F.element_at(F.filter("scope", lambda f: f["loop_id"] == F.col("loop_id")), -1)
    rows = rows.withColumn("role", F.when(F.col("loop_id").isNotNull(), F.when(F.coalesce(frame["iteration"], F.lit(0)) == 0, "entry").otherwise("back")))
    plain = rows.filter("role IS NULL").join(edges.select(F.col("to").alias("node_id"), "edge_id"), "node_id")
    headed = rows.filter("role IS NOT NULL").join(headers.select("node_id", "role", "edge_id"), ["node_id", "role"])
    columns = ["invocation_id", "scope", "node_id", "role", "edge_id"]
    asked = plain.select(columns).union(headed.select(columns)).join(told, ["invocation_id", "scope", "edge_id"], "left")
    out = asked.groupBy("invocation_id", "scope", "node_id", "role").agg(F.count("*").alias("incoming"), F.count("selected").alias("decided"), F.coalesce(F.bool_or("selected"), F.lit(False)).alias("any"))
    none = F.when(F.col("role") == "entry", "loop_skipped").otherwise("skipped")
    return out.select("invocation_id", "scope", "node_id", "incoming", "decided", F.when(F.col("decided") < F.col("incoming"), "pending").when(F.col("any"), "ready").otherwise(none).alias("status"))


def loop_outcomes(loop_edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Of each loop iteration: incomplete while an edge is undecided, else continue, exit, conflict or dead_end.
    loop_edges (loop_id, edge_id, role back|exit); decisions (scope_key, edge_id, selected)."""
    asked = decisions.join(loop_edges, "edge_id").select("loop_id", "scope_key").distinct()
    rows = asked.join(loop_edges, "loop_id").join(decisions, ["scope_key", "edge_id"], "left")
    yes = lambda role: F.coalesce(F.bool_or((F.col("role") == role) & F.col("selected")), F.lit(False))
    out = rows.groupBy("loop_id", "scope_key").agg((F.count("*") > F.count("selected")).alias("open"), yes("back").alias("back"), yes("exit").alias("exit"))
    verdict = F.when(F.col("open"), "incomplete").when(F.col("back") & F.col("exit"), "conflict").when(F.col("back"), "continue").when(F.col("exit"), "exit").otherwise("dead_end")
    return out.select("loop_id", "scope_key", verdict.alias("outcome"))


def path_trace(edge_events: DataFrame) -> DataFrame:
    """The selected edges of each invocation in order, with how often each has been taken so far. edge_events
    (invocation_id, sequence, edge_id, source_execution_id, selected)."""
    rows = edge_events.filter("selected")
    w = W.partitionBy("invocation_id").orderBy("sequence")
    v = W.partitionBy("invocation_id", "edge_id").orderBy("sequence")
    return rows.select("invocation_id", F.row_number().over(w).cast("long").alias("step"), "edge_id", "source_execution_id", F.row_number().over(v).cast("long").alias("iteration"))


def usage_rollup(responses: DataFrame) -> DataFrame:
    """Token usage by model and finish reason; nulls are counted apart and not as 0."""
    return responses.groupBy("model", "finish_reason").agg(F.count("*").alias("responses"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("input_tokens").isNull() | F.col("output_tokens").isNull()).alias("without_usage"))


def apply_failure_policy(executions: DataFrame, modes: DataFrame) -> DataFrame:
    """(invocation_id, execution_id, final_state, invocation_error). executions (invocation_id, execution_id, sequence,
    state, error_code); modes (invocation_id, failure_mode). fail_fast: active executions are cancelled and later ones
    never start once one has failed; continue: the others finish, and the first failure is the invocation's."""
    own = W.partitionBy("invocation_id")
    rows = executions.join(modes, "invocation_id")
    at = F.min(F.when(F.col("state") == "failed", F.struct("sequence", "error_code"))).over(own)
    rows = rows.withColumn("_f", at)
    fast = (F.col("failure_mode") == "fail_fast") & F.col("_f").isNotNull()
    final = F.when(fast & F.col("state").isin("created", "ready", "running", "waiting"), "cancelled").when(fast & (F.col("sequence") > F.col("_f.sequence")) & (F.col("state") == "pending"), "not_started").otherwise(F.col("state"))
    return rows.select("invocation_id", "execution_id", final.alias("final_state"), F.col("_f.error_code").alias("invocation_error"))
