"""Live projection of event journals (inventory M2 with D1-D8): keyed state with a map of rows.

Each invocation has rows (part, key) -> row, and events whose predecessors are missing. While either are short they are kept
in one value, read and written with one call a trigger; beyond a fixed size the rows go to a map, as do events that don't fit,
and a trigger then reads and writes only the rows that its events touch: its cost follows the events and not what an
invocation has gathered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.projection import COUNTERS, derive
from ..schemas import TERMINAL_INVOCATION, TERMINAL_NODE

KEEP_MS = 3_600_000
#: Milliseconds for which the last sequence of an ended invocation is kept, so that repeats are known as such.
MARK_MS = 30 * 24 * 3_600_000
#: Characters of an invocation's rows, and of its events that wait, up to which they are kept in one value.
TOGETHER = 1 << 15
TOLD = "invocation_id string, part string, key string, through_sequence bigint, body string"
_COUNTS = ", ".join(f"{c} bigint" for c in COUNTERS)
TOLD_ROW = Row("invocation_id", "part", "key", "through_sequence", "body")
#: The columns of each part's rows, named like those of the batch operators.
PARTS = {
    "invocation": "state string",
    "execution": f"execution_id string, node_id string, first_event_sequence bigint, last_event_sequence bigint, state string, error string, started_at_ms bigint, ended_at_ms bigint, elapsed_ns bigint, timing_json string, ordinal bigint",
    "rollup": f"execution_id string, {_COUNTS}, latest_operator_kind string, last_call_sequence bigint",
    "node": f"node_id string, state string, latest_occurrence_state string, latest_occurrence_sequence bigint, latest_skipped_instance_key string, latest_execution_id string, execution_count bigint, skipped_count bigint, latest_error string, latest_elapsed_ns bigint, latest_timing string, {_COUNTS}, latest_operator_kind string",
    "edge": "edge_id string, state string, latest_state string, latest_evaluation_sequence bigint, selected boolean, latest_selected boolean, evaluation_count bigint, selected_count bigint, skipped_count bigint, failed_count bigint, source_execution_id string, target_node_id string, reason string, elapsed_ns bigint",
    "call_state": "call_id string, state string",
    "call": "execution_id string, call_id string, sequence bigint, operator_id string, kind string, reason string, state string, occurred_at_ms bigint, elapsed_ns bigint",
    "wait": "wait_key string, created_at_ms bigint, wait_type string, node_id string, is_open boolean",
    "phase": "event_name string, subject_id string, status string, occurred_at_ms bigint, elapsed_ns bigint",
}


def _flat(events: DataFrame) -> DataFrame:
    """One JSON text an event, with the fields that the rules look at."""
    p, e = F.col("p"), derive(events)
    call = F.col("branch") == "call"
    edge = F.col("branch") == "edge"
    waits = F.coalesce(F.when(F.size(p["waits"]) > 0, F.transform(p["waits"], lambda w: F.struct(w["wait_key"].alias("wait_key"), w["wait_type"].alias("wait_type"), w["node_id"].alias("node_id")))),
                       F.transform(p["wait_keys"], lambda k: F.struct(k.alias("wait_key"), F.lit(None).cast("string").alias("wait_type"), F.lit(None).cast("string").alias("node_id"))))
    operator = F.coalesce(p["operator_id"], F.nullif(F.array_join(p["operator_ids"], ", "), F.lit("")), p["kind"], F.lit("operator"))
    fields: list[Column] = [
        F.col("branch"), F.col("state"), F.col("event_type"), F.col("event_name"), F.col("execution_id"), F.col("node_id"), F.col("subject_id"), F.col("status"), F.col("occurred_at_ms"), F.col("elapsed_ns"),
        F.when(F.col("branch") == "node", F.col("timing_json")).alias("timing_json"), F.when(F.col("branch") == "node", F.to_json(p["error"])).alias("error"), p["node_instance_key"].alias("instance_key"),
        F.when(edge, F.coalesce(p["edge_id"], "subject_id")).alias("edge_id"), F.when(edge, F.coalesce(p["state"], "status", F.lit("evaluated"))).alias("edge_state"), F.when(edge, F.coalesce(p["selected"], F.lit(False))).alias("selected"),
        p["source_execution_id"].alias("source_execution_id"), p["target_node_id"].alias("target_node_id"), p["reason"].alias("reason"),
        F.col("call_id"), F.when(call, operator).alias("operator_id"), F.when(call, F.coalesce(p["kind"], F.lit("direct"))).alias("kind"), (call & (p["error"]["code"] == "OPERATOR_TIMEOUT")).alias("timed_out"),
        p["streaming"].alias("streaming"), p["stream_chunk_count"].alias("chunks"), p["summary"]["call_count"].alias("sum_calls"), p["summary"]["streaming_call_count"].alias("sum_streaming"), p["summary"]["stream_chunk_count"].alias("sum_chunks"),
        F.when(F.col("branch") == "wait_created", waits).alias("waits"), p["wait_key"].alias("wait_key"),
    ]
    return e.select("invocation_id", "sequence", F.to_json(F.struct(*fields)).alias("event"))


class _Rows:
    """Rows of one invocation in this trigger: read from the state when first asked for, written once at the end."""

    def __init__(self, state, known: dict | None, mapped: bool, together: int) -> None:
        """known: the rows that are kept together; mapped: whether the map has others."""
        self.state, self.known, self.changed, self.mapped = state, dict(known or {}), {}, mapped
        self.together = together

    def get(self, part: str, key: str) -> dict | None:
        at = (part, key)
        if at not in self.known:
            found = self.state.getValue(at) if self.mapped else None
            self.known[at] = None if found is None else json.loads(found[0])
        return self.known[at]

    def put(self, part: str, key: str, row: dict) -> None:
        self.known[part, key] = self.changed[part, key] = row

    def write(self) -> str | None:
        """The rows as one text while they are few; else they go to the map, each by itself, and stay there."""
        if not self.mapped:
            text = json.dumps([[*at, row] for at, row in self.known.items() if row is not None])
            if len(text) <= self.together:
                return text
        rows = self.changed if self.mapped else {at: row for at, row in self.known.items() if row is not None}
        for at, row in rows.items():
            self.state.updateValue(at, (json.dumps(row),))
        self.mapped = True
        return None


def _node_row(rows: _Rows, node_id: str) -> dict:
    return rows.get("node", node_id) or {"node_id": node_id, "execution_count": 0, "skipped_count": 0, **dict.fromkeys(COUNTERS, 0)}


def _count_from(node: dict, rollup: dict | None) -> None:
    """The node's call summary is that of an execution."""
    for c in COUNTERS:
        node[c] = rollup[c] if rollup else 0
    node["latest_operator_kind"] = rollup["latest_operator_kind"] if rollup else None


def _on_node(rows: _Rows, n: int, e: dict) -> None:
    node = _node_row(rows, e["node_id"])
    own = {"state": e.get("state"), "error": e.get("error"), "elapsed_ns": e.get("elapsed_ns"), "timing_json": e.get("timing_json")}
    if (execution_id := e.get("execution_id")) is not None:
        x = rows.get("execution", execution_id)
        if x is None:
            node["execution_count"] += 1
            node["latest_execution_id"] = execution_id
            x = {"execution_id": execution_id, "first_event_sequence": n, "started_at_ms": None, "ordinal": node["execution_count"]}
        if own["state"] == "running":
            x["started_at_ms"] = e["occurred_at_ms"]
        x |= own | {"node_id": e["node_id"], "last_event_sequence": n, "ended_at_ms": e["occurred_at_ms"] if own["state"] in TERMINAL_NODE else None}
        rows.put("execution", execution_id, x)
    if e["event_name"] == "node.skipped":
        node["skipped_count"] += 1
        node["latest_skipped_instance_key"] = e.get("instance_key")
    latest = rows.get("execution", node["latest_execution_id"]) if node.get("latest_execution_id") is not None else own
    node |= {"latest_occurrence_state": own["state"], "latest_occurrence_sequence": n, "state": latest["state"], "latest_error": latest["error"], "latest_elapsed_ns": latest["elapsed_ns"], "latest_timing": latest["timing_json"]}
    _count_from(node, rows.get("rollup", node["latest_execution_id"]) if node.get("latest_execution_id") is not None else None)
    rows.put("node", e["node_id"], node)


def _on_call(rows: _Rows, n: int, e: dict) -> None:
    rows.put("call_state", e["call_id"], {"call_id": e["call_id"], "state": e.get("state")})
    execution_id = e.get("execution_id")
    x = rows.get("execution", execution_id) if execution_id is not None else None
    if x is None:
        return
    key = json.dumps([execution_id, e["call_id"]])
    before = rows.get("call", key) or {"adds": [0, 0, 0]}
    whole = e["kind"] in ("map", "replication")
    adds = [e.get("sum_calls") or 0, e.get("sum_streaming") or 0, e.get("sum_chunks") or 0] if whole else [0, int(e.get("streaming") or 0), e.get("chunks") or 0]
    r = rows.get("rollup", execution_id) or {"execution_id": execution_id, **dict.fromkeys(COUNTERS, 0)}
    one = (1, e.get("state") != "completed", e.get("reason") == "retry", e.get("reason") == "fallback", bool(e.get("timed_out")), *[a - b for a, b in zip(adds, before["adds"], strict=True)])
    for c, k in zip(COUNTERS, one, strict=True):
        r[c] += int(k)
    r |= {"latest_operator_kind": e["kind"], "last_call_sequence": n}
    rows.put("rollup", execution_id, r)
    rows.put("call", key, {"execution_id": execution_id, "call_id": e["call_id"], "sequence": n, "adds": adds} | {c: e.get(c) for c in ("operator_id", "kind", "reason", "state", "occurred_at_ms", "elapsed_ns")})
    node = _node_row(rows, x["node_id"])
    _count_from(node, r)  # a call is newer than the node's last event
    rows.put("node", x["node_id"], node)


def _on_edge(rows: _Rows, n: int, e: dict) -> None:
    counts = ("evaluation_count", "selected_count", "skipped_count", "failed_count")
    r = rows.get("edge", e["edge_id"]) or {"edge_id": e["edge_id"], **dict.fromkeys(counts, 0)}
    for c, k in zip(counts, (True, e["selected"], e["edge_state"] == "skipped", e["edge_state"] == "failed"), strict=True):
        r[c] += int(k)
    r |= {"latest_state": e["edge_state"], "latest_evaluation_sequence": n, "latest_selected": e["selected"], "selected": r["selected_count"] > 0} | {c: e.get(c) for c in ("source_execution_id", "target_node_id", "reason", "elapsed_ns")}
    r["state"] = "failed" if r["failed_count"] else "selected" if r["selected_count"] else e["edge_state"]
    rows.put("edge", e["edge_id"], r)


def _on_wait(rows: _Rows, n: int, e: dict) -> None:
    if e["branch"] == "wait_created":
        for w in e.get("waits") or []:
            if w.get("wait_key") is not None:
                rows.put("wait", w["wait_key"], {"wait_key": w["wait_key"], "created_at_ms": e["occurred_at_ms"], "wait_type": w.get("wait_type"), "node_id": w.get("node_id"), "is_open": True})
    elif (key := e.get("wait_key")) is not None:
        rows.put("wait", key, {"wait_key": key, "created_at_ms": e["occurred_at_ms"], "wait_type": None, "node_id": None, "is_open": False})


def _on_other(rows: _Rows, n: int, e: dict) -> None:
    if e["branch"] == "other" and e["event_type"] == "phase":
        rows.put("phase", "", {c: e.get(c) for c in ("event_name", "subject_id", "status", "occurred_at_ms", "elapsed_ns")})


RULES = {"node": _on_node, "call": _on_call, "edge": _on_edge, "wait_created": _on_wait, "wait_resumed": _on_wait}


def _told(e: dict) -> str | None:
    if e["branch"] == "invocation":
        return e.get("state")
    if e["branch"] == "wait_created":
        return "waiting"
    return "interrupted" if e["branch"] == "other" and e["event_type"] == "recovery" and e["event_name"].endswith("interrupted") else None


class LiveProjection(StatefulProcessor):
    """M2. See live_projection()."""

    def __init__(self, parts: tuple[str, ...], keep_ms: int, mark_ms: int, timers: bool, seeded: bool, together: int = TOGETHER) -> None:
        self.parts, self.keep_ms, self.mark_ms, self.timers, self.seeded = parts, keep_ms, mark_ms, timers, seeded
        self.together = together

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "applied bigint, state string, timer bigint, waiting bigint, rows string, mapped boolean, held string")
        self.rows = handle.getMapState("rows", "part string, key string", "body string")
        self.held = handle.getMapState("held", "sequence bigint", "event string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        part, name, body = initialState["part"], initialState["key"], initialState["body"]
        if part is None or part == "invocation":
            # A cursor alone, or the invocation's own row.
            state = json.loads(body)["state"] if body is not None else "created"
            self.head.update((initialState["through_sequence"], state, None, 0, None, True, None))
        else:
            self.rows.updateValue((part, name), (body,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        applied, state, timer, waiting, packed, mapped, kept = self.head.get() or (0, "created", None, 0, None, None, None)
        if mapped is None:  # a new key; rows of a former run without its invocation's own row are in the map
            mapped = self.seeded and self.rows.exists()
        before, now = (applied, waiting), timerValues.getCurrentProcessingTimeInMs() if self.timers else 0
        arrived: dict[int, str] = {}
        for r in rows:
            if r["sequence"] > applied:
                arrived.setdefault(r["sequence"], r["event"])
        own = _Rows(self.rows, {(p, k): row for p, k, row in json.loads(packed)} if packed is not None else None, mapped, self.together)
        held = {n: text for n, text in json.loads(kept)} if kept is not None else {}
        apart = waiting > len(held)  # events wait in the map
        while True:
            text, at = arrived.pop(applied + 1, None), (applied + 1,)
            if applied + 1 in held:
                text, waiting = held.pop(applied + 1), waiting - 1
            elif apart and (found := self.held.getValue(at)) is not None:
                text, waiting = found[0], waiting - 1
                self.held.removeKey(at)
            if text is None:
                break
            applied += 1
            e = json.loads(text)
            RULES.get(e["branch"], _on_other)(own, applied, e)
            state = _told(e) or state
        size = sum(map(len, held.values()))
        for n, text in arrived.items():
            if n in held or (apart and self.held.containsKey((n,))):
                continue
            waiting, size = waiting + 1, size + len(text)
            if size <= self.together:
                held[n] = text
            else:
                self.held.updateValue((n,), (text,))
        packed = own.write() if own.changed else packed
        kept = json.dumps(list(held.items())) if held else None
        if self.timers and state in TERMINAL_INVOCATION:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = now + self.keep_ms
            self.handle.registerTimer(timer)
        if (applied, waiting) != before or timer is not None:
            self.head.update((applied, state, timer, waiting, None if own.mapped else packed, own.mapped, kept))
        if applied == before[0]:
            return
        if "invocation" in self.parts:
            yield TOLD_ROW(key[0], "invocation", "", applied, json.dumps({"state": state}))
        for (part, name), row in own.changed.items():
            if part in self.parts:
                yield TOLD_ROW(key[0], part, name, applied, json.dumps(row))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """First the rows go and the last sequence stays; then that goes too."""
        if self.head.exists() and self.head.get()[2] == expiredTimerInfo.getExpiryTimeInMs():
            applied, state, _, waiting, packed, mapped, _ = self.head.get()
            if mapped or packed is not None or waiting:
                self.rows.clear()
                self.held.clear()
                timer = timerValues.getCurrentProcessingTimeInMs() + self.mark_ms
                self.handle.registerTimer(timer)
                self.head.update((applied, state, timer, 0, None, False, None))
            else:
                self.head.clear()
        return iter(())


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that map state needs, where the session has another."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(conf, "") or ""):
        spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_projection(events: DataFrame, initial: DataFrame | None = None, parts: tuple[str, ...] = tuple(PARTS), keep_ms: int = KEEP_MS, mark_ms: int = MARK_MS, timers: bool = True) -> DataFrame:
    """M2: the rows of D1-D8 that a trigger's events change (update mode): invocation_id, part, key, through_sequence, body.
    `view` makes a part's columns of them. After the last trigger they equal the batch operators on the same journal.

    Events are applied in the order of their sequences, whatever order they come in; repeats are dropped. An execution
    belongs to one node.

    initial: rows of a former run, its last of each key, from whose sequences the projection goes on; or cursors
    (invocation_id, through_sequence; the other columns null) past which events are counted from nothing.

    keep_ms after an invocation has ended its rows leave the state, and its last sequence stays for mark_ms, so that late
    repeats change nothing. Timers keep a query going for ever: without them a query of availableNow ends.

    The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass); it is set where the session has none.
    """
    use_rocksdb(events.sparkSession)
    seed = None if initial is None else initial.select(*[c.split()[0] for c in TOLD.split(", ")]).groupBy("invocation_id")
    return _flat(events).groupBy("invocation_id").transformWithState(LiveProjection(parts, keep_ms, mark_ms, timers, seed is not None), TOLD, "update", "processingTime" if timers else "none", seed)


def latest(told: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The last row of each key, of rows written with the number of their trigger."""
    return told.groupBy("invocation_id", "part", "key").agg(F.max_by(F.struct("through_sequence", "body"), batch).alias("l")).select("invocation_id", "part", "key", "l.through_sequence", "l.body")


def view(rows: DataFrame, part: str) -> DataFrame:
    """One part's rows as columns, like the batch operator's; of waits the open ones."""
    out = rows.filter(F.col("part") == part).select("invocation_id", "through_sequence", F.from_json("body", PARTS[part]).alias("b"))
    out = out.filter("b.is_open") if part == "wait" else out
    out = out.select("invocation_id", *(["through_sequence"] if part == "invocation" else []), "b.*")
    return out.drop("is_open")
