"""Pages, directories and set operations over journals (inventory B1-B3, B7-B9, C1-C5, E3, E5, E6, F1-F3, G1-G3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import ACTIVE_INVOCATION, TERMINAL_INVOCATION


def event_page(events: DataFrame, invocations: DataFrame, after: int = 0, before: int | None = None, limit: int = 200) -> DataFrame:
    """B1: a page of each invocation's events in ascending order: the first `limit` after `after`, or with `before` the
    last `limit` below it. Adds the page's first and last sequence and whether there are earlier and later events."""
    own = W.partitionBy("invocation_id")
    rows = events.filter(F.col("sequence") > after)
    if before is not None:
        rows = rows.filter(F.col("sequence") < before)
    order = F.desc("sequence") if before is not None else F.asc("sequence")
    rows = rows.withColumn("_n", F.row_number().over(own.orderBy(order))).filter(F.col("_n") <= limit).drop("_n")
    rows = rows.withColumn("first_sequence", F.min("sequence").over(own)).withColumn("last_sequence", F.max("sequence").over(own))
    live = invocations.select(F.col("id").alias("invocation_id"), F.col("durable_sequence").alias("live_sequence"))
    rows = rows.join(live, "invocation_id")
    return rows.withColumn("has_earlier", F.col("first_sequence") > 1).withColumn("has_later", F.col("last_sequence") < F.col("live_sequence"))


def event_detail(events: DataFrame, keys: DataFrame) -> DataFrame:
    """B2: the events with exactly these (invocation_id, sequence); `found` is false where there is none."""
    return keys.join(events.withColumn("_found", F.lit(True)), ["invocation_id", "sequence"], "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def user_event_page(user_events: DataFrame, after: int, limit: int) -> DataFrame:
    """The first `limit` user events after `after`; has_later compares with the last there is (an empty page has no rows, so no flag)."""
    own = W.partitionBy("invocation_id")
    rows = user_events.withColumn("_last", F.max("sequence").over(own)).filter(F.col("sequence") > after)
    rows = rows.withColumn("_n", F.row_number().over(own.orderBy("sequence"))).filter(F.col("_n") <= limit)
    return rows.withColumn("has_later", F.max("sequence").over(own) < F.col("_last")).drop("_n", "_last")


def event_view(events: DataFrame, include_values: bool) -> DataFrame:
    """List view of events: flags instead of values, unless values are asked for."""
    values = ("input_json", "output_json", "operations_json")
    flags = [F.col(v).isNotNull().alias(f"has_{v.removesuffix('_json')}") for v in values]
    kept = [F.col(v) if include_values else F.lit(None).cast("string").alias(v) for v in values]
    return events.select(*[c for c in events.columns if c not in values], *kept, *flags)


def scope_executions(executions: DataFrame, nodes: DataFrame, path: list[str]) -> DataFrame:
    """The executions of the nodes in a nested group: those whose workflow path begins with `path`."""
    inside = nodes.filter(F.slice("workflow_path", 1, max(1, len(path))) == F.array(*map(F.lit, path))) if path else nodes
    return executions.join(inside.select("revision_id", "node_id").distinct(), ["revision_id", "node_id"], "left_semi")


def scope_edges(edges: DataFrame, nodes: DataFrame, path: list[str]) -> DataFrame:
    """The edges of a nested group: its path is a prefix of the edge's, or both endpoints are inside."""
    prefix = F.array(*map(F.lit, path)).cast("array<string>")
    inside = nodes.filter(F.slice("workflow_path", 1, max(1, len(path))) == prefix).select("revision_id", "node_id") if path else nodes.select("revision_id", "node_id")
    a = inside.select("revision_id", F.col("node_id").alias("from"), F.lit(True).alias("_a"))
    b = inside.select("revision_id", F.col("node_id").alias("to"), F.lit(True).alias("_b"))
    rows = edges.join(a, ["revision_id", "from"], "left").join(b, ["revision_id", "to"], "left")
    own = F.slice("workflow_path", 1, max(1, len(path))) == prefix if path else F.lit(True)
    return rows.filter(own | (F.col("_a") & F.col("_b"))).drop("_a", "_b")


def normalize_events(events: DataFrame) -> DataFrame:
    """node_id and edge_id from the payload, or from the subject where it is one."""
    field = lambda name: F.get_json_object("payload_json", f"$.{name}")
    node = F.coalesce(field("node_id"), F.when(F.col("subject_type") == "node", F.col("subject_id")))
    edge = F.coalesce(field("edge_id"), F.when(F.col("subject_type") == "edge", F.col("subject_id")))
    return events.withColumn("node_id", node).withColumn("edge_id", edge)


def recoverable_invocations(sessions: DataFrame, invocations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Current, active, not minimal invocations of these revisions (id); callers order them by (created_at_ms, id)."""
    s = sessions.join(revisions.select(F.col("id").alias("workflow_revision_id")), "workflow_revision_id", "left_semi")
    rows = invocations.join(s.select(F.col("id").alias("session_id"), F.col("current_invocation_id").alias("id"), "workflow_revision_id"), ["session_id", "id"])
    return rows.filter((F.col("event_mode") != "minimal") & F.col("state").isin(*ACTIVE_INVOCATION))


def invocation_records(invocations: DataFrame, versions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Invocations with their version and session; the live sequence is the durable one."""
    v = versions.select(F.col("id").alias("workflow_version_id"), "workflow_id", "definition_hash")
    s = sessions.select(F.col("id").alias("session_id"), "session_key", F.col("current_invocation_id").alias("_current"))
    rows = invocations.join(v, "workflow_version_id").join(s, "session_id")
    return rows.withColumn("live_sequence", F.col("durable_sequence")).withColumn("is_current", F.col("_current").eqNullSafe(F.col("id"))).drop("_current")


def session_directory(sessions: DataFrame, invocations: DataFrame) -> DataFrame:
    """Each session's current state (null without one) and its number of invocations."""
    counts = invocations.groupBy("session_id").agg(F.count("*").alias("n"))
    current = invocations.select(F.col("id").alias("current_invocation_id"), F.col("state").alias("current_state"))
    rows = sessions.join(current, "current_invocation_id", "left").join(counts, sessions["id"] == counts["session_id"], "left")
    return rows.select(sessions["id"], "workflow_id", "session_key", "current_invocation_id", "current_state", F.coalesce("n", F.lit(0)).alias("invocation_count"), "created_at_ms", "updated_at_ms")


def invocation_neighbors(invocations: DataFrame, anchors: DataFrame, direction: str, limit: int) -> DataFrame:
    """C4: the `limit` nearest invocations of the same session before (`older`) or after (`newer`) each anchor by
    (created_at_ms, id); `position` ascends in time; has_more tells of further ones. anchors (session_id, id).

    A session is read once in order, and each row knows the limit + 1 rows beside it: all invocations as anchors cost
    rows times limit. Anchors that aren't in their session have no rows here; anchor_errors() tells them."""
    if direction not in ("older", "newer"):
        raise ValueError("direction must be older or newer")
    order = W.partitionBy("session_id").orderBy("created_at_ms", "id")
    near = order.rowsBetween(-limit - 1, -1) if direction == "older" else order.rowsBetween(1, limit + 1)
    run = F.collect_list(F.struct(*invocations.columns)).over(near)
    rows = invocations.select("session_id", F.col("id").alias("anchor_id"), run.alias("_run"))
    rows = rows.join(anchors.select("session_id", F.col("id").alias("anchor_id")).distinct(), ["session_id", "anchor_id"], "left_semi").withColumn("has_more", F.size("_run") > limit)
    first = F.greatest(F.lit(1), F.size("_run") - limit + 1) if direction == "older" else F.lit(1)
    rows = rows.select("anchor_id", "has_more", F.posexplode(F.slice("_run", first, F.lit(limit))).alias("_p", "_r"))
    return rows.select("_r.*", "anchor_id", "has_more", (F.col("_p") + 1).cast("long").alias("position"))


def anchor_errors(invocations: DataFrame, anchors: DataFrame) -> DataFrame:
    """C4: the anchors (session_id, id) that have no neighbours to tell, with `unknown_anchor` or `other_session`."""
    known = invocations.select("id", F.col("session_id").alias("_own"))
    error = F.when(F.col("_own").isNull(), "unknown_anchor").when(F.col("_own") != F.col("session_id"), "other_session")
    return anchors.join(known, "id", "left").select("session_id", "id", error.alias("error")).filter("error IS NOT NULL")


def overlay(durable: DataFrame, live: DataFrame) -> DataFrame:
    """Live rows replace durable rows of their id. The status (state, updated_at_ms) is that of the newer row; on a
    tie a terminal state isn't replaced by another."""
    d, v = durable.alias("d"), live.alias("l")
    rows = d.join(v, F.col("d.id") == F.col("l.id"), "full")
    done = F.col("d.state").isin(*TERMINAL_INVOCATION) & ~F.col("l.state").isin(*TERMINAL_INVOCATION)
    keep = F.col("d.id").isNotNull() & (F.col("l.id").isNull() | (F.col("d.updated_at_ms") > F.col("l.updated_at_ms")) | ((F.col("d.updated_at_ms") == F.col("l.updated_at_ms")) & done))
    pick = {c: F.when(keep, F.col(f"d.{c}")).otherwise(F.col(f"l.{c}")) if c in ("state", "updated_at_ms") else F.when(F.col("l.id").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"d.{c}")) for c in durable.columns}
    return rows.select(*[x.alias(c) for c, x in pick.items()])


def assign_sequences(batch: DataFrame, stored: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The next sequences of each key for a new batch, after the largest stored one."""
    top = stored.groupBy(key).agg(F.max("sequence").alias("_top"))
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return batch.withColumn("_n", n).join(top, key, "left").withColumn("sequence", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "_top")


def retention(invocations: DataFrame, mode: str, keep: int = 0) -> DataFrame:
    """E5: what may be evicted: terminal invocations whose journals are both durable; of these `none`, `all`, or all but
    the `keep` newest of all (`recent`). Columns: runtime_durable, user_durable (booleans)."""
    ready = F.col("state").isin(*TERMINAL_INVOCATION) & F.col("runtime_durable") & F.col("user_durable")
    rows = invocations.filter(ready)
    if mode == "none":
        return rows.filter(F.lit(False))
    if mode == "all":
        return rows
    kept = rows.orderBy(F.desc("updated_at_ms"), F.desc("id")).limit(keep).select("id")
    return rows.join(kept, "id", "left_anti")


def retain_checkpoints(snapshots: DataFrame, keep: int = 8) -> DataFrame:
    """The snapshot at sequence 0 and the `keep` newest others of each invocation."""
    zero = F.col("event_sequence") == 0
    n = F.row_number().over(W.partitionBy("invocation_id", zero).orderBy(F.desc("event_sequence")))
    return snapshots.withColumn("_n", n).filter(zero | (F.col("_n") <= keep)).drop("_n")


def keyset_page(df: DataFrame, ts: str, id_: str, cursor: tuple[int, str] | None, limit: int, within: str | None = None) -> DataFrame:
    """rows below the cursor in descending order of (ts, id), `limit` of them, with `next_cursor` on the last one if
    there are more. A global page sorts limit + 1 rows only; with `within` each group has its page."""
    rows = df if cursor is None else df.filter(F.struct(F.col(ts), F.col(id_)) < F.struct(F.lit(cursor[0]).cast("long"), F.lit(cursor[1])))
    order = [F.desc(ts), F.desc(id_)]
    if within is None:
        rows, w = rows.orderBy(*order).limit(limit + 1), W.partitionBy(F.lit(0))
    else:
        w = W.partitionBy(within)
    rows = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).filter(F.col("_n") <= limit + 1)
    more = (F.max("_n").over(w) > limit) & (F.col("_n") == limit)
    return rows.withColumn("next_cursor", F.when(more, encode_cursor(F.col(ts), F.col(id_)))).filter(F.col("_n") <= limit).withColumn("position", F.col("_n").cast("long")).drop("_n")


def encode_cursor(ts: Column, id_: Column) -> Column:
    """URL-safe base64 of compact JSON, without padding."""
    raw = F.to_json(F.struct(ts.cast("long").alias("timestamp"), id_.cast("string").alias("id")))
    return F.rtrim(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """struct(timestamp, id), or null for what isn't a cursor: junk, a negative time, an empty id."""
    text = F.translate(cursor, "-_", "+/")
    padded = F.concat(text, F.repeat(F.lit("="), (4 - F.length(text) % 4) % 4))
    raw = F.when(text.rlike(r"^[A-Za-z0-9+/]+$"), F.try_to_binary(padded, F.lit("base64")))
    v = F.from_json(raw.cast("string"), "timestamp long, id string")
    return F.when((v["timestamp"] >= 0) & (F.length(v["id"]) > 0), v)


def order_spans(spans: DataFrame, within: str) -> DataFrame:
    """rank of spans by sequence, start, id."""
    return spans.withColumn("rank", F.row_number().over(W.partitionBy(within).orderBy("span_order", "start_ms", "execution_id")).cast("long"))


def order_diagnostics(d: DataFrame, within: str) -> DataFrame:
    """rank of diagnostics by severity, source index (null last), object, id, field, code, message."""
    severity = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    order = [severity, F.asc_nulls_last("source_index"), "object_type", "object_id", "field", "code", "message"]
    return d.withColumn("rank", F.row_number().over(W.partitionBy(within).orderBy(*order)).cast("long"))


def version_directory(durable: DataFrame, registered: DataFrame, live: DataFrame) -> DataFrame:
    """G1: versions by (workflow_id, definition_hash): durable before live; `registered` marks those in the registry."""
    key = ["workflow_id", "definition_hash"]
    both = durable.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    first = both.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("_p", "id"))).filter("_n = 1").drop("_n", "_p")
    return first.join(registered.select(*key).distinct().withColumn("_r", F.lit(True)), key, "left").withColumn("registered", F.coalesce("_r", F.lit(False))).drop("_r")


def new_skips(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Instance keys that are skipped now and weren't before."""
    return current.select("invocation_id", "instance_key").subtract(previous.select("invocation_id", "instance_key"))


def merge_user_event_pages(durable: DataFrame, live: DataFrame, after: int, limit: int) -> DataFrame:
    """Durable events, then live ones above the last durable sequence, cut to `limit` after `after`."""
    last = durable.groupBy("invocation_id").agg(F.max("sequence").alias("_last"))
    fresh = live.join(last, "invocation_id", "left").filter(F.col("_last").isNull() | (F.col("sequence") > F.col("_last"))).drop("_last")
    rows = durable.withColumn("source", F.lit("durable")).unionByName(fresh.withColumn("source", F.lit("live"))).filter(F.col("sequence") > after)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("invocation_id").orderBy("sequence"))).filter(F.col("_n") <= limit).drop("_n")
