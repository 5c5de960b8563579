"""End and health of invocations over both journals and the writer's marks (inventory M4, M5)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import TERMINAL_INVOCATION
from .live import KEEP_MS, MARK_MS, use_rocksdb
from .streams import BUNDLES, by_bundles

#: A persistence status after which nothing more is written, and those that tell of a failure.
SETTLED = ("memory_only", "durable", "degraded", "unserializable")
FAILED = ("degraded", "unserializable")
MARKS = "invocation_id string, journal string, status string, durable_sequence bigint, marked_at_ms bigint"
HEALTH = "invocation_id string, journal string, status string, expected bigint, got bigint, state string, persistence string, told bigint"
_ROW = Row(*[c.split()[0] for c in HEALTH.split(", ")])
_HEAD = "applied bigint, waiting bigint, state string, ended boolean, since bigint, runtime string, user string, timer bigint, told bigint"
_NAMES = [c.split()[0] for c in _HEAD.split(", ")]
_NEW = (0, 0, "created", False, 0, "healthy", "healthy", None, 0)


class _Map(dict):
    """A map that is at hand, with the calls of a map state."""

    getValue, containsKey, updateValue, removeKey = dict.get, dict.__contains__, dict.__setitem__, dict.__delitem__  # noqa: N815


def _arrived(h: dict, held, marks, texts: Iterable[str], now: int, final: bool) -> bool:
    """Brings an invocation's head, waiting events and marks up to date; False if there is nothing new after its end.
    A text is an event's `sequence {told}`, a mark's {fields}, or empty for a user event, whose invocation is looked at."""
    over, arrived, newest = h["ended"] and final, {}, {}
    for text in texts:
        if text.startswith("{"):
            m = json.loads(text)
            journal, mark = m.get("journal"), (m.get("status"), m["sequence"], m.get("marked_at_ms"))
            if journal not in newest or mark[2] > newest[journal][2]:
                newest[journal] = mark
        elif text and not over:
            n, _, told = text.partition(" ")
            if int(n) > h["applied"]:
                arrived.setdefault(int(n), json.loads(told)["told"] if told else None)
    newer = {}
    if not over:
        for journal, mark in newest.items():
            old = marks.getValue((journal,))
            if old is None or mark[2] > old[2]:
                newer[journal] = mark
    if h["ended"] and not arrived and not newer:  # what comes now is a repeat, or too late
        return False
    for journal, mark in newer.items():
        marks.updateValue((journal,), mark)
    before = h["applied"]
    while True:
        at, there = (h["applied"] + 1,), h["applied"] + 1 in arrived
        told = arrived.pop(at[0], None)
        if h["waiting"] and (found := held.getValue(at)) is not None:
            told, there, h["waiting"] = found[0], True, h["waiting"] - 1
            held.removeKey(at)
        if not there:
            break
        h["applied"] += 1
        h["state"] = told or h["state"]
    for n, told in arrived.items():
        if not h["waiting"] or not held.containsKey((n,)):
            held.updateValue((n,), (told,))
            h["waiting"] += 1
    if not h["waiting"]:
        h["since"] = 0
    elif h["applied"] != before or not h["since"]:
        h["since"] = now
    return True


def _told(key: str, h: dict, held, marks, now: int, timeout_ms: int) -> Iterator[Row]:
    """What has changed since the last word on this invocation."""
    runtime, user = marks.getValue(("runtime",)), marks.getValue(("user",))
    gap = h["waiting"] and now - h["since"] >= timeout_ms
    expected, got = (h["applied"] + 1, min(k[0] for k in held.keys())) if gap else (None, None)
    marked = runtime[0] if runtime is not None and runtime[0] in FAILED else "healthy"
    status = marked if marked == "unserializable" else "degraded" if gap else marked
    for journal, new, where in (("runtime", status, (expected, got)), ("user", user[0] if user is not None and user[0] in FAILED else "healthy", (None, None))):
        said = new if where[0] is None else f"{new} {where[0]} {where[1]}"
        if said != h[journal]:
            h[journal], h["told"] = said, h["told"] + 1
            yield _ROW(key, journal, new, *where, None, None, h["told"])
    was, h["ended"] = h["ended"], False
    settled = runtime is not None and runtime[0] in SETTLED and (runtime[0] != "durable" or runtime[1] >= h["applied"])
    if h["state"] in TERMINAL_INVOCATION and not h["waiting"] and settled:
        h["ended"], h["told"] = True, h["told"] + 1
        yield _ROW(key, "runtime", "ended", h["applied"], None, h["state"], runtime[0], h["told"])
    elif was:
        h["told"] += 1
        yield _ROW(key, "runtime", "open", None, None, h["state"], runtime[0] if runtime is not None else None, h["told"])


class JournalHealth(StatefulProcessor):
    """journal_health() with timers: a state for each invocation."""

    def __init__(self, timeout_ms: int, keep_ms: int, mark_ms: int, final: bool) -> None:
        self.timeout_ms, self.keep_ms, self.mark_ms, self.final = timeout_ms, keep_ms, mark_ms, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.held = handle.getMapState("held", "sequence bigint", "told string")
        self.marks = handle.getMapState("marks", "journal string", "status string, durable_sequence bigint, marked_at_ms bigint")

    def _read(self) -> dict:
        return dict(zip(_NAMES, self.head.get() or _NEW, strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        h, now = self._read(), timerValues.getCurrentProcessingTimeInMs()
        if _arrived(h, self.held, self.marks, (r["event"] for r in rows), now, self.final):
            yield from _told(key[0], h, self.held, self.marks, now, self.timeout_ms)
        self._wake(h, now)
        self.head.update(tuple(h.values()))

    def _wake(self, h: dict, now: int) -> None:
        """A timer for the oldest gap, and one that takes an ended invocation's state away."""
        if h["timer"] is not None:
            self.handle.deleteTimer(h["timer"])
            h["timer"] = None
        if h["ended"]:
            h["timer"] = now + self.keep_ms
        elif h["waiting"]:
            left = h["since"] + self.timeout_ms
            h["timer"] = left if left > now else None
        if h["timer"] is not None:
            self.handle.registerTimer(h["timer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        h, now = self._read(), timerValues.getCurrentProcessingTimeInMs()
        if h["timer"] != expiredTimerInfo.getExpiryTimeInMs():
            return
        h["timer"] = None
        if not h["ended"]:
            yield from _told(key[0], h, self.held, self.marks, now, self.timeout_ms)
            self._wake(h, now)
            self.head.update(tuple(h.values()))
        elif self.marks.exists():
            self.marks.clear()
            h["timer"] = now + self.mark_ms
            self.handle.registerTimer(h["timer"])
            self.head.update(tuple(h.values()))
        else:
            self.head.clear()


def _advance(timeout_ms: int, final: bool):
    """The same without timers, on a state that is at hand (see streams.Bundles)."""

    def advance(key: str, kept: list | None, texts: list[str], now: int) -> tuple[list, list[Row]]:
        head, waiting, said = kept or (_NEW, [], [])
        h, held, marks = dict(zip(_NAMES, head, strict=True)), _Map(((n,), (told,)) for n, told in waiting), _Map(((journal,), mark) for journal, mark in said)
        rows = list(_told(key, h, held, marks, now, timeout_ms)) if _arrived(h, held, marks, texts, now, final) else []
        return [list(h.values()), [(n, told) for (n,), (told,) in held.items()], [(journal, mark) for (journal,), mark in marks.items()]], rows

    return advance


def journal_health(runtime_events: DataFrame, user_events: DataFrame, marks: DataFrame, timeout_ms: int = 60_000, keep_ms: int = KEEP_MS, mark_ms: int = MARK_MS, timers: bool = True, final: bool = True, bundles: int = BUNDLES) -> DataFrame:
    """M4 and M5: what changes in an invocation's health (HEALTH, update mode; `told` counts the words on it), from three
    streams: the runtime journal, the user journal, and the writer's marks (MARKS; the one with the greatest marked_at_ms
    counts for its journal, runtime or user).

    runtime: `degraded` with (expected, got) once events have waited for a missing one for timeout_ms, or by such a mark;
    `unserializable` by its mark, whatever is missing; `healthy` again when neither holds. user: only marks degrade it, as
    its sequences have gaps by design. The two don't touch each other. `ended`, once: the invocation is terminal,
    nothing before is missing, and its persistence is settled (memory_only, degraded, unserializable, or durable up to
    the last event); `expected` is then the last sequence.

    An end is final, and what comes later is too late, where events come about in order. Where they come in any order
    (final=False), what no event tells of yet can't be missed: a later event or a newer mark takes an end back, and the
    invocation is told to be `ended` once more, or `open`. The last word holds.

    After an end only its mark stays, first for keep_ms with the rest and then for mark_ms alone: repeats raise no alarm.
    Without timers ages are looked at in the batches only, and a query of availableNow ends; invocations then are dealt to a
    number of bundles, which a checkpoint fixes (see streams.Bundles). State store: see live_projection().
    """
    name = F.col("event_name")
    told = F.when(name.startswith("invocation."), F.coalesce("status", F.substring_index(name, ".", -1))).when(name == "wait.created", "waiting").when((F.col("event_type") == "recovery") & name.endswith("interrupted"), "interrupted")
    event = F.concat(F.col("sequence").cast("string"), F.when(told.isNotNull(), F.concat(F.lit(" "), F.to_json(F.struct(told.alias("told"))))).otherwise(""))
    mark = F.to_json(F.struct("journal", "status", F.coalesce("durable_sequence", F.lit(0)).alias("sequence"), "marked_at_ms"))
    texts = [df.select("invocation_id", text.alias("event")) for df, text in ((runtime_events, event), (user_events, F.lit("")), (marks, mark))]
    rows = texts[0].union(texts[1]).union(texts[2])
    if not timers:
        return by_bundles(rows, _advance(timeout_ms, final), HEALTH, "update", bundles)
    use_rocksdb(runtime_events.sparkSession)
    return rows.groupBy("invocation_id").transformWithState(JournalHealth(timeout_ms, keep_ms, mark_ms, final), HEALTH, "update", "processingTime")


def ends(health: DataFrame) -> DataFrame:
    """M4: (invocation_id, state, final_sequence, persistence) of the ended invocations, of rows that have been kept."""
    rows = health.filter("status IN ('ended', 'open')").groupBy("invocation_id").agg(F.max_by(F.struct("status", "state", F.col("expected").alias("final_sequence"), "persistence"), "told").alias("l"))
    return rows.select("invocation_id", "l.*").filter("status = 'ended'").drop("status")


def last_health(health: DataFrame) -> DataFrame:
    """M5: the last word on each invocation's journals, of rows that have been kept."""
    rows = health.filter("status NOT IN ('ended', 'open')").groupBy("invocation_id", "journal").agg(F.max_by(F.struct("status", "expected", "got"), "told").alias("l"))
    return rows.select("invocation_id", "journal", "l.*")
