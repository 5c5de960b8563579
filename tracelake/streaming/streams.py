"""Journals as streams (inventory M1-M8).

Journals are folders of Parquet files that grow. Spark deals a stream's rows out in no order, so keyed state holds events
until their sequence follows what has been applied: late ones wait, repeats are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import agent, ingest
from ..schemas import TABLES, TERMINAL_INVOCATION
from ..sources.journal import load_events, write_events
from .live import TOGETHER, use_rocksdb

KEY = "invocation_id"
#: Milliseconds for which the state of an ended invocation still drops repeats.
KEEP_MS = 3_600_000
#: Milliseconds for which its last sequence is kept after that.
MARK_MS = 30 * 24 * 3_600_000
#: Bundles of invocations whose states are kept together by queries without timers: best for up to thirty times as many.
BUNDLES = 4096


def tail_events(spark: SparkSession, path: str, cursors: DataFrame | None = None, files_per_trigger: int = 64, table: str = "runtime_events") -> DataFrame:
    """M1: the journal's events as a stream, past each invocation's cursor (invocation_id, cursor); the query's checkpoint
    resumes it. Cursors are joined as a static table. `table` is runtime_events or user_events: the two journals are
    tailed apart, and a user journal may have gaps."""
    schema = TABLES[table]
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).select(*[c.split()[0] for c in schema.split(", ")])
    if cursors is None:
        return events
    at = cursors.select(KEY, F.col("cursor").alias("_cursor"))
    return events.join(at, KEY, "left").filter(F.col("sequence") > F.coalesce("_cursor", F.lit(0))).drop("_cursor")


def live_unread(user_events: DataFrame, read_through: DataFrame) -> DataFrame:
    """M1 with D18: unread counts of invocations as their user events arrive; in update mode each trigger tells the changed
    ones. State is the set of an invocation's logical keys."""
    return agent.unread_keys(user_events, read_through).groupBy(KEY).agg(F.size(F.collect_set("key")).cast("long").alias("unread"))


def dedupe_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """M7: without repeats of (invocation_id, sequence) that arrive within the delay of each other."""
    stamped = events.withColumn("event_time", F.timestamp_millis("occurred_at_ms")).withWatermark("event_time", delay)
    return stamped.dropDuplicatesWithinWatermark([KEY, "sequence"]).drop("event_time")


def stream_append(events: DataFrame, journal_path: str, conflicts_path: str, checkpoint: str, days: int = 7):
    """M3: a writer that appends each micro-batch to the journal once: known keys are left out, so a replayed batch adds
    nothing; events that contradict stored ones go to the batch's own folder of conflicts, which a replay overwrites.

    The journal lies in folders of days (see write_events). An invocation's events lie within `days` of each other, so a
    batch is compared with the days around its own only, and its cost doesn't grow with the journal.
    """
    spark = events.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            span = batch.agg(*[f(F.to_date(F.timestamp_millis("occurred_at_ms"))) for f in (F.min, F.max)]).first()
            if span[0] is None:
                return
            write_events(spark.createDataFrame([], TABLES["runtime_events"]), journal_path)
            journal = load_events(spark, journal_path, str(span[0] - timedelta(days)), str(span[1] + timedelta(days)))
            new, _, conflicts = ingest.append(journal, batch)
            conflicts.write.mode("overwrite").parquet(f"{conflicts_path}/batch_id={batch_id}")
            write_events(new.select(*journal.columns), journal_path)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def session_activity(events: DataFrame, invocations: DataFrame) -> DataFrame:
    """M6: sessions with their number of events and last change so far; in update mode each trigger tells the changed ones."""
    owner = invocations.select(F.col("id").alias(KEY), "session_id")
    return events.join(owner, KEY).groupBy("session_id").agg(F.count("*").alias("events"), F.max("occurred_at_ms").alias("last_at_ms"), F.approx_count_distinct(KEY).alias("invocations"))


def session_changes(events: DataFrame, invocations: DataFrame, path: str, checkpoint: str):
    """M6: a writer that tells each trigger's changed invocations: (session_id, invocation_id, events, through_sequence), a row
    each, in the trigger's own folder batch_id=n. Nothing is kept between triggers, so nothing grows; a batch that runs
    again replaces its folder. Repeats of events count as changes unless dedupe_stream comes before."""
    owner = invocations.select(F.col("id").alias(KEY), "session_id")

    def each(batch: DataFrame, batch_id: int) -> None:
        changed = batch.groupBy(KEY).agg(F.count("*").alias("events"), F.max("sequence").alias("through_sequence")).join(owner, KEY)
        changed.select("session_id", KEY, "events", "through_sequence").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def _in_order(texts: Iterable[str], applied: int, held: dict[int, str]) -> tuple[list[dict], int]:
    """Events that can be applied now, in order; the others stay in `held`, as the texts that they came as."""
    for text in texts:
        n = int(text[: text.index(" ")])
        if n > applied:
            held.setdefault(n, text)
    ready = []
    while applied + 1 in held:
        applied += 1
        ready.append(BLANK | json.loads(held.pop(applied).partition(" ")[2]))
    return ready, applied


def _columns(events: DataFrame) -> DataFrame:
    """An event as one text, `sequence {fields}`: what a group costs follows its number of columns more than its rows."""
    keys = F.concat_ws(",", F.from_json(F.get_json_object("payload_json", "$.wait_keys"), "array<string>"), F.transform(F.from_json(F.get_json_object("payload_json", "$.waits"), "array<struct<wait_key string>>"), lambda w: w["wait_key"]))
    fields = F.struct("event_type", "event_name", "status", "occurred_at_ms", F.get_json_object("payload_json", "$.wait_key").alias("wait_key"), keys.alias("wait_keys"))
    return events.select(KEY, F.concat_ws(" ", F.col("sequence").cast("string"), F.to_json(fields)).alias("event"))


BLANK = dict.fromkeys(("event_type", "event_name", "status", "occurred_at_ms", "wait_key", "wait_keys"))


class Bundles(StatefulProcessor):
    """The steps of queries that end, for bundles of invocations: the states of a bundle are one value, read and written with
    one call a trigger, while they are short. Those that don't fit go to a map, each by itself, and stay there. Calls cost far
    more than the steps of a short invocation, and so do frames, which GroupState makes for each key, state and row.
    An event comes as one text: the trigger's time, the event, its invocation. advance(key, state, texts, now) ->
    (state, rows) takes a state that JSON can hold, None at first."""

    def __init__(self, advance: Callable, out: str, together: int) -> None:
        self.advance, self.together = advance, together
        self.columns = [c.split()[0] for c in out.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "states string, apart boolean")
        self.apart = handle.getMapState("apart", "invocation_id string", "state string")
        self.row = Row(*self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        text, apart = self.kept.get() or (None, False)
        states: dict[str | None, list] = dict(json.loads(text)) if text else {}
        arrived: dict[str | None, list[str]] = {}
        now = 0
        for r in rows:
            time, event, *own = r["event"].split("\n", 2)
            arrived.setdefault(own[0] if own else None, []).append(event)
            now = int(time)
        for k, texts in arrived.items():
            own = states.get(k)
            in_map = own is None and apart and (found := self.apart.getValue((k,))) is not None
            state, told = self.advance(k, json.loads(found[0]) if in_map else own, texts, now)
            if in_map:
                self.apart.updateValue((k,), (json.dumps(state),))
            else:
                states[k] = state
            for row in told:
                yield self.row(*row)
        text = json.dumps(list(states.items()))
        if len(text) > self.together:
            self._spill(states, arrived, len(text) - self.together)
            text, apart = json.dumps(list(states.items())), True
        self.kept.update((text, apart))

    def _spill(self, states: dict[str | None, list], arrived: Iterable[str | None], over: int) -> None:
        """Puts states that have just been changed into the map until the others fit together."""
        for k in arrived:
            if k in states and over > 0:
                one = json.dumps(states.pop(k))
                over -= len(one)
                self.apart.updateValue((k,), (one,))


def by_bundles(events: DataFrame, advance: Callable, out: str, output_mode: str, bundles: int) -> DataFrame:
    """States of queries without timers by bundles of invocations, in RocksDB (see Bundles); events have the columns
    (invocation_id, event), the event as a text of one line."""
    use_rocksdb(events.sparkSession)
    bundle = F.pmod(F.xxhash64(KEY), F.lit(bundles)).alias("bundle")
    text = F.concat(F.unix_millis(F.current_timestamp()).cast("string"), F.lit("\n"), "event", F.coalesce(F.concat(F.lit("\n"), KEY), F.lit("")))
    return events.select(bundle, text.alias("event")).groupBy("bundle").transformWithState(Bundles(advance, out, TOGETHER), out, output_mode, "none")


def _fresh(empty: dict) -> dict:
    return {k: (v.copy() if hasattr(v, "copy") else v) for k, v in empty.items()}


def _lines(text: str | None) -> dict[int, str]:
    return {int(x[: x.index(" ")]): x for x in (text or "").splitlines()}


def _text(held: dict[int, str]) -> str | None:
    return "\n".join(held[k] for k in sorted(held)) or None


def _stateful(events: DataFrame, step: Callable, empty: dict, state: str, out: str, output_mode: str, keep_ms: int, timers: bool, mark_ms: int, bundles: int) -> DataFrame:
    """step(key, fields, ready, held, applied, now) -> (rows, done, wake_ms): changes the state's fields by the events that are
    ready. State is kept as columns: the last applied sequence, the fields, and the held events as one text. Once a step is done, the
    state only drops repeats; after keep_ms without an event it shrinks to the last sequence, which goes mark_ms later, so a
    late repeat changes nothing and raises no alarm. A step that asks for it is woken in wake_ms.
    Timers keep a query going for ever: without them a query of availableNow ends, and ages are looked at in its batches only;
    invocations then are dealt to a number of bundles, which a checkpoint fixes, and states are kept by bundles, in RocksDB
    (see Bundles). A checkpoint is of one kind or the other."""
    if not timers:

        def advance(key, kept: list | None, texts: list[str], now: int) -> tuple[list, list]:
            applied, fields, lines = kept or (0, _fresh(empty), None)
            held = _lines(lines)
            ready, applied = _in_order(texts, applied, held)
            told, _, _ = step(key, fields, ready, held, applied, now)
            return [applied, fields, _text(held)], told

        return by_bundles(_columns(events), advance, out, output_mode, bundles)
    names = [c.split()[0] for c in state.split(", ")]

    def run(key, pdfs: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.exists:
            applied, done, marked, *rest, lines = group.get
            fields, held = dict(zip(names, rest, strict=True)), _lines(lines)
        else:
            applied, done, marked, fields, held = 0, False, False, _fresh(empty), {}
        if done and marked:
            if group.hasTimedOut:
                group.remove()
            else:  # repeats, or events after the end
                group.setTimeoutDuration(max(1, mark_ms))
            return
        if group.hasTimedOut and done and not held:
            group.update((applied, True, True, *[empty[n] for n in names], None))
            group.setTimeoutDuration(max(1, mark_ms))
            return
        ready, applied = _in_order(() if group.hasTimedOut else (x for pdf in pdfs for x in pdf["event"]), int(applied), held)
        rows, done, wake_ms = step(key[0], fields, ready, held, applied, group.getCurrentProcessingTimeMs())
        group.update((applied, done, False, *[fields[n] for n in names], _text(held)))
        if done or wake_ms is not None:
            group.setTimeoutDuration(max(1, keep_ms if wake_ms is None else wake_ms))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return _columns(events).groupBy(KEY).applyInPandasWithState(run, out, f"applied bigint, done boolean, marked boolean, {state}, held string", output_mode, GroupStateTimeout.ProcessingTimeTimeout)


def _told(row: dict) -> str | None:
    name = row["event_name"]
    if name.startswith("invocation."):
        return row["status"] or name.rpartition(".")[2]
    if name == "wait.created":
        return "waiting"
    if row["event_type"] == "recovery" and name.endswith("interrupted"):
        return "interrupted"
    return None


def _follow(fields: dict, ready: list[dict], held: dict) -> bool:
    """Brings the field `state` up to date; whether the invocation has ended and nothing of it is missing."""
    for r in ready:
        fields["state"] = _told(r) or fields["state"]
    return fields["state"] in TERMINAL_INVOCATION and not held


def live_projection(events: DataFrame, keep_ms: int = KEEP_MS, timers: bool = True, mark_ms: int = MARK_MS, bundles: int = BUNDLES) -> DataFrame:
    """M2: each invocation's state, event and node event counts and open waits as of its last contiguous sequence, told again
    whenever it has changed (update mode). Equal to the batch projection once all events are there. The state of an ended
    invocation is removed after keep_ms; later repeats would wait for what they repeat and tell nothing."""

    def step(key, s, ready, held, applied, now):
        open_ = set(s["waits"])
        for r in ready:
            s["node_events"] += r["event_name"].startswith("node.")
            if r["event_name"] == "wait.created":
                open_ |= {w for w in (r["wait_keys"] or "").split(",") if w}
            elif r["event_name"] == "wait.resumed":
                open_.discard(r["wait_key"])
        s["waits"] = sorted(open_)
        done = _follow(s, ready, held)
        return ([(key, s["state"], applied, s["node_events"], ",".join(s["waits"]))] if ready else []), done, None

    return _stateful(events, step, {"state": "created", "node_events": 0, "waits": []}, "state string, node_events bigint, waits array<string>", "invocation_id string, state string, through_sequence bigint, node_events bigint, open_waits string", "update", keep_ms, timers, mark_ms, bundles)


def detect_stream_end(events: DataFrame, keep_ms: int = KEEP_MS, timers: bool = True, mark_ms: int = MARK_MS, bundles: int = BUNDLES) -> DataFrame:
    """M4: one row for each invocation when it is terminal and nothing before is missing. What no event tells of can't be
    missed, so an end is taken back by the next event in the sequence, if that comes within keep_ms: by a row with the later
    end, or one without a final sequence where there is none yet. The last row holds (see stream_ends)."""

    def step(key, s, ready, held, applied, now):
        if not ready:
            return [], s["ended"], None
        was, s["ended"] = s["ended"], _follow(s, ready, held)
        return ([(key, s["state"], applied if s["ended"] else None)] if s["ended"] or was else []), s["ended"], None

    return _stateful(events, step, {"state": "created", "ended": False}, "state string, ended boolean", "invocation_id string, state string, final_sequence bigint", "append", keep_ms, timers, mark_ms, bundles)


def stream_ends(told: DataFrame) -> DataFrame:
    """The ends that hold, of rows of detect_stream_end() that were written with the number of their trigger."""
    last = told.groupBy(KEY).agg(F.max_by(F.struct("state", "final_sequence"), "batch_id").alias("l"))
    return last.select(KEY, "l.*").filter("final_sequence IS NOT NULL")


def detect_gaps(events: DataFrame, timeout_ms: int = 60_000, keep_ms: int = KEEP_MS, timers: bool = True, mark_ms: int = MARK_MS, bundles: int = BUNDLES) -> DataFrame:
    """M5: an invocation is degraded once events have waited for a missing one for the timeout, whatever else arrives
    meanwhile: (invocation_id, expected, got, status), told again when another one is missing. It is healthy again when
    no event is missing."""

    def step(key, s, ready, held, applied, now):
        done = _follow(s, ready, held)
        if not held:
            was, s["degraded"], s["expected"], s["since"] = s["degraded"], False, 0, 0
            return ([(key, applied + 1, None, "healthy")] if was else []), done, None
        if s["expected"] != applied + 1:
            s["expected"], s["since"], s["told"] = applied + 1, now, 0
        left = s["since"] + timeout_ms - now
        if left > 0:
            return [], False, left
        got, told = min(held), s["told"]
        s["degraded"], s["told"] = True, got
        return ([(key, applied + 1, got, "degraded")] if told != got else []), False, None

    return _stateful(events, step, {"state": "created", "degraded": False, "expected": 0, "since": 0, "told": 0}, "state string, degraded boolean, expected bigint, since bigint, told bigint", "invocation_id string, expected bigint, got bigint, status string", "update", keep_ms, timers, mark_ms, bundles)


def waits_open(events: DataFrame, keep_ms: int = KEEP_MS, timers: bool = True, mark_ms: int = MARK_MS, bundles: int = BUNDLES) -> DataFrame:
    """M8: changes of waits in the order of their events: (invocation_id, wait_key, is_open, created_at_ms, waited_ms). The
    state of an ended invocation is removed after keep_ms."""

    def step(key, s, ready, held, applied, now):
        open_ = dict(zip(s["waits"], s["since"], strict=True))
        rows = []
        for r in ready:
            if r["event_name"] == "wait.created":
                for w in filter(None, (r["wait_keys"] or "").split(",")):
                    open_[w] = int(r["occurred_at_ms"])
                    rows.append((key, w, True, open_[w], None))
            elif r["event_name"] == "wait.resumed" and r["wait_key"] in open_:
                since = open_.pop(r["wait_key"])
                rows.append((key, r["wait_key"], False, since, int(r["occurred_at_ms"]) - since))
        s["waits"], s["since"] = list(open_), list(open_.values())
        return rows, _follow(s, ready, held), None

    return _stateful(events, step, {"state": "created", "waits": [], "since": []}, "state string, waits array<string>, since array<bigint>", "invocation_id string, wait_key string, is_open boolean, created_at_ms bigint, waited_ms bigint", "append", keep_ms, timers, mark_ms, bundles)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is now and writes each batch's rows with its batch_id; a repeated batch replaces its folder."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
