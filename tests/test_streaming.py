"""Streams with state: commits of several tables, live projections, health of two journals."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.jobs.stream_queries import ran
from tracelake.operators import ingest
from tracelake.operators import projection as P
from tracelake.schemas import TABLES
from tracelake.sources.adapters import invocations, runtime_events, sessions
from tracelake.sources import store as store_module
from tracelake.sources.store import TableStore
from tracelake.streaming import appends, health, live, streams

DATA = "/root/testdata/sf0.001"
EVENT = TABLES["runtime_events"] + ", " + appends.FOLD


def event(inv, n, name="node.running", at=0, state=None, result=None, error=None, **k):
    row = {"id": f"{inv}{n}", "invocation_id": inv, "sequence": n, "schema_version": 1, "event_type": "state_change", "event_name": name, "subject_type": "node", "subject_id": "n", "occurred_at_ms": at or n, "status": name.rpartition(".")[2], "timing_json": "{}", "payload_json": "{}", "state": state, "result_json": result, "error_json": error}
    return row | k


def events(spark, rows):
    return spark.createDataFrame([tuple((r | {"elapsed_ns": None}).get(c.split()[0]) for c in EVENT.split(", ")) for r in rows], EVENT)


def user_events(spark, rows):
    return spark.createDataFrame([(f"u{i}{n}", "s", i, n, 1, "note", data, "n", "[]", "x", None, n) for i, n, data in rows], TABLES["user_events"])


def admitted(spark, path, ids):
    store = appends.journal_store(spark, str(path))
    inv = spark.createDataFrame([(i, "s", "v", "n", "created", "live", "full", 0, None, None, None, None, 1, 1) for i in ids], TABLES["invocations"])
    appends.admit(store, inv, spark.createDataFrame([("s", "w", "v", "k", None, "{}", 1, 1)], TABLES["sessions"]))
    return store


def tables(store):
    return {t: sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in store.read(t).drop("commit").collect()) for t in appends.SCHEMAS}


def batches(spark):
    day = 86_400_000
    return [
        appends.items(events(spark, [event("a", 1, "invocation.running", state="running"), event("a", 2), event("b", 1, at=300 * day), event("z", 1)]), user_events(spark, [("a", 1, "x"), ("a", 5, "y"), ("y", 1, "x")])),
        appends.items(events(spark, [event("a", 2), event("a", 2, status="other"), event("a", 3, "invocation.failed", state="failed", error='{"code":"E"}', at=50), event("a", 3, "invocation.failed", state="failed", error='{"code":"E"}', at=50)]), user_events(spark, [("a", 5, "z"), ("a", 2, "late")])),
        appends.items(events(spark, [event("b", 1, at=1), event("b", 2, "invocation.completed", state="completed", result="[1]", at=301 * day, execution_mode="test")])),
    ]


def test_commits_of_several_tables(spark, tmp_path):
    store = admitted(spark, tmp_path, "ab")
    for n, batch in enumerate(batches(spark)):
        assert appends.commit_batch(store, batch, n + 1)
        assert not appends.commit_batch(store, batch, n + 1)
    keys = lambda t: sorted((r.invocation_id, r.sequence) for r in store.read(t).collect())
    assert keys("runtime_events") == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert keys("user_events") == [("a", 1), ("a", 2), ("a", 5)]
    conflicts = [(r.journal, r.invocation_id, r.sequence, json.loads(r.row_json).get("status")) for r in store.read("conflicts").orderBy("journal", "invocation_id").collect()]
    assert conflicts == [("runtime_events", "a", 2, "other"), ("runtime_events", "b", 1, "running"), ("user_events", "a", 5, None)]
    assert sorted((r.journal, r.invocation_id) for r in store.read("unknown").collect()) == [("runtime_events", "z"), ("user_events", "y")]
    got = {r.id: (r.state, r.result_json, r.error_json, r.durable_sequence, r.execution_mode) for r in store.read("invocations").collect()}
    assert got == {"a": ("failed", None, '{"code":"E"}', 3, "live"), "b": ("completed", "[1]", None, 2, "test")}
    assert store.read("sessions").first().updated_at_ms == 301 * 86_400_000


@pytest.mark.parametrize("dies_at", ["keys", "invocations", "manifest"])
def test_a_batch_that_dies_between_tables(spark, tmp_path, monkeypatch, dies_at):
    clean, store = admitted(spark, tmp_path / "clean", "ab"), admitted(spark, tmp_path / "store", "ab")
    first, second, _ = batches(spark)
    for s in (clean, store):
        appends.commit_batch(s, first, 1)
    before = tables(store)
    write, publish = TableStore._write, TableStore._publish

    def dying(self, table, rows, folder):
        if table == dies_at:
            raise OSError("gone")
        write(self, table, rows, folder)

    with monkeypatch.context() as m:
        m.setattr(TableStore, "_write", dying)
        m.setattr(TableStore, "_publish", lambda self, x: (_ for _ in ()).throw(OSError("gone")) if dies_at == "manifest" else publish(self, x))
        with pytest.raises(OSError):
            appends.commit_batch(store, second, 2)
    assert tables(store) == before
    appends.commit_batch(store, second, 2)
    appends.commit_batch(clean, second, 2)
    assert tables(store) == tables(clean) != before


def test_levels_stay_few_and_keep_the_newest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FAN", 4)
    store = TableStore(spark, str(tmp_path), {"t": "id bigint, v bigint, commit bigint"}, {"t": (("id",), "commit")})
    for n in range(14):
        store.commit(n, {"t": spark.createDataFrame([(n % 3, n, n), (100 + n, n, n)], "id bigint, v bigint, commit bigint").coalesce(1)})
    assert len(store.manifest()["tables"]["t"]) == 3 + 2
    rows = {r.id: r.v for r in store.read("t").collect()}
    assert {i: rows[i] for i in range(3)} == {0: 12, 1: 13, 2: 11} and len(rows) == 3 + 14
    store.vacuum(1)
    assert {r.id: r.v for r in store.read("t").collect()} == rows
    with pytest.raises(RuntimeError):
        store._publish({"version": store.manifest()["version"], "batch_id": 0, "tables": {}})


def test_stream_of_commits_runs_again(spark, tmp_path):
    e = runtime_events(spark, DATA).withColumn("state", F.when(F.col("event_name").startswith("invocation."), F.col("status")))
    appends.items(e.union(e.filter("sequence % 3 = 0"))).repartition(6, F.xxhash64("id", F.lit(2))).write.parquet(f"{tmp_path}/in")
    store = appends.journal_store(spark, f"{tmp_path}/store")
    appends.admit(store, invocations(spark, DATA).withColumn("durable_sequence", F.lit(0).cast("long")).withColumn("state", F.lit("created")), sessions(spark, DATA))
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    run = lambda ck: appends.stream_commits(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/{ck}").trigger(availableNow=True).start().awaitTermination()
    run("a")
    assert store.read("runtime_events").exceptAll(runtime_events(spark, DATA)).count() == 0 and store.read("runtime_events").count() == e.count()
    want = {r.id: (r.state, r.durable_sequence) for r in ingest.fold_events(invocations(spark, DATA).withColumn("state", F.lit("created")), e).collect()}
    assert {r.id: (r.state, r.durable_sequence) for r in store.read("invocations").collect()} == want
    assert store.read("conflicts").isEmpty()


BATCH = {"execution": P.project_node_executions, "node": P.project_nodes, "edge": P.project_edges, "rollup": P.operator_rollup, "call_state": P.operator_states, "call": P.operator_calls, "wait": P.active_waits, "invocation": P.invocation_states, "phase": P.latest_phase}


def streamed(spark, path, schema=TABLES["runtime_events"], files=2):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def test_live_projection_equals_the_batch_operators(spark, tmp_path):
    """A shuffled stream with repeats, ended half-way and begun anew from what it told."""
    e = runtime_events(spark, DATA)
    first, second = e.filter("sequence <= 4 OR sequence % 2 = 0"), e.filter("sequence > 4").union(e.filter("sequence % 5 = 0"))
    for name, rows in (("a", first), ("b", second)):
        rows.repartition(5, F.xxhash64("id", F.lit(3))).write.parquet(f"{tmp_path}/{name}")
    told = live.latest(ran(live.live_projection(streamed(spark, f"{tmp_path}/a"), timers=False), f"{tmp_path}/x", "update")).persist()
    more = ran(live.live_projection(streamed(spark, f"{tmp_path}/b"), told, timers=False), f"{tmp_path}/y", "update")
    rows = live.latest(more.unionByName(told.withColumn("batch_id", F.lit(-1)))).persist()
    p = P.prepare(e)
    for part, f in BATCH.items():
        want, got = f(p), live.view(rows, part)
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert got.select(columns).exceptAll(want.select(columns)).count() == 0 == want.select(columns).exceptAll(got.select(columns)).count(), part


def test_live_projection_from_a_cursor(spark, tmp_path):
    events(spark, [event("a", 2, "invocation.completed"), event("a", 1), event("b", 8, "invocation.failed"), event("b", 7), event("b", 9), event("b", 5)]).select(*[c.split()[0] for c in TABLES["runtime_events"].split(", ")]).write.parquet(f"{tmp_path}/in")
    cursors = spark.createDataFrame([("b", None, None, 6, None)], live.TOLD)
    rows = live.latest(ran(live.live_projection(streamed(spark, f"{tmp_path}/in", files=1), cursors, ("invocation",), timers=False), f"{tmp_path}/o", "update"))
    assert {r.invocation_id: (r.state, r.through_sequence) for r in live.view(rows, "invocation").collect()} == {"a": ("completed", 2), "b": ("failed", 9)}


class Held:
    """A state variable as a dict; counts the calls."""

    calls = 0

    def __init__(self):
        self.of = {}

    def __getattribute__(self, name):
        if name not in ("of", "calls") and not name.startswith("__"):
            Held.calls += 1
        return object.__getattribute__(self, name)

    def get(self):
        return object.__getattribute__(self, "of").get(())

    getValue, containsKey = lambda self, k: self.of.get(k), lambda self, k: k in self.of
    update, updateValue, removeKey = lambda self, v: self.of.update({(): v}), lambda self, k, v: self.of.update({k: v}), lambda self, k: self.of.pop(k)
    exists = lambda self: bool(self.of)


def test_short_invocations_take_few_calls_of_the_state():
    """A trigger reads and writes them once; long ones tell the same."""
    import random
    from types import SimpleNamespace

    e = [{"branch": "node", "event_name": "node.running", "event_type": "t", "execution_id": f"x{n % 4}", "node_id": f"n{n % 3}", "state": "running", "occurred_at_ms": n} if n % 3 else {"branch": "wait_created", "event_name": "wait.created", "event_type": "wait", "waits": [{"wait_key": f"w{n % 2}"}], "occurred_at_ms": n} for n in range(1, 41)]
    rows = [{"sequence": n, "event": json.dumps(x)} for n, x in enumerate(e, 1)]
    random.Random(3).shuffle(rows)
    told, calls = {}, {}
    for together in (0, 900, live.TOGETHER):
        made = {}
        handle = SimpleNamespace(getValueState=lambda name, *_, made=made: made.setdefault(name, Held()), getMapState=lambda name, *_, made=made: made.setdefault(name, Held()))
        p = live.LiveProjection(tuple(live.PARTS), 1, 1, False, False, together)
        p.init(handle)
        Held.calls, out = 0, {}
        for lo in range(0, 40, 10):
            for r in p.handleInputRows(("a",), iter([*rows[lo : lo + 10], *rows[: lo // 2]]), SimpleNamespace()):
                out[r.part, r.key] = (r.through_sequence, r.body)
        told[together], calls[together] = out, Held.calls
    assert told[0] == told[900] == told[live.TOGETHER] and told[0]["invocation", ""][0] == 40
    assert calls[live.TOGETHER] <= 2 * 4 < calls[0]


def run_health(spark, path, name, **k):
    s = lambda table, schema: spark.readStream.schema(schema).parquet(f"{path}/{table}/*")
    stream = health.journal_health(s("r", TABLES["runtime_events"]), s("u", TABLES["user_events"]), s("m", health.MARKS), timeout_ms=0, **k)
    return ran(stream, f"{path}/{name}", "update")


def test_two_journals_and_marks(spark, tmp_path):
    plain = [c.split()[0] for c in TABLES["runtime_events"].split(", ")]
    put = lambda n, rows, users, marks: [df.coalesce(1).write.parquet(f"{tmp_path}/{t}/{n}") for t, df in (("r", events(spark, rows).select(plain)), ("u", user_events(spark, users)), ("m", spark.createDataFrame(marks, health.MARKS)))]
    told = lambda: [(r.invocation_id, r.journal, r.status, r.expected, r.got) for r in run_health(spark, tmp_path, "o", timers=False).orderBy("batch_id", "told").collect()]
    put(1, [event("a", 1, "invocation.completed"), event("b", 2), event("c", 1)], [("a", 3, "x"), ("a", 9, "x"), ("b", 1, "x")], [("a", "user", "degraded", 0, 5), ("c", "runtime", "durable", 1, 5)])
    want = [("a", "user", "degraded", None, None), ("b", "runtime", "degraded", 1, 2)]
    assert sorted(told()) == want  # a is terminal, but its runtime journal isn't settled
    put(2, [event("b", 1), event("c", 2, "invocation.failed"), event("b", 2)], [], [("a", "runtime", "durable", 0, 6), ("a", "runtime", "durable", 1, 7)])
    more = [("a", "runtime", "ended", 1, None), ("b", "runtime", "healthy", None, None)]
    assert sorted(told()) == sorted(want + more)  # c is durable up to event 1 only
    put(3, [event("a", 1, "invocation.completed"), event("a", 7), event("b", 1)], [("a", 3, "x")], [("c", "runtime", "memory_only", 0, 9), ("a", "runtime", "unserializable", 0, 9)])
    assert sorted(told()) == sorted([*want, *more, ("c", "runtime", "ended", 2, None)])


def test_ends_are_taken_back_by_what_comes_later(spark, tmp_path):
    """Each end seems whole until the next file comes; of `b`, event 3 never comes."""
    plain = [c.split()[0] for c in TABLES["runtime_events"].split(", ")]
    put = lambda n, rows, marks: [df.coalesce(1).write.parquet(f"{tmp_path}/{t}/{n}") for t, df in (("r", events(spark, rows).select(plain)), ("u", user_events(spark, [("x", 1, "x")])), ("m", spark.createDataFrame(marks, health.MARKS)))]
    told, end = [], []
    put(1, [event(i, 1, "invocation.completed") for i in "abc"], [(i, "runtime", "unserializable", 1, 5) for i in "abc"])
    for n, rows in ((2, []), (3, [event("a", 2), event("b", 2, "invocation.failed"), event("b", 4), event("c", 2)]), (4, [event("a", 3, "invocation.failed"), event("b", 1, "invocation.completed")])):
        put(n, rows, [])
        told.append(run_health(spark, tmp_path, "o", timers=False, final=False))
        s = spark.readStream.schema(TABLES["runtime_events"]).parquet(f"{tmp_path}/r/*")
        end.append(streams.stream_ends(ran(streams.detect_stream_end(s, timers=False), f"{tmp_path}/e")))
    of = lambda df: sorted((r.invocation_id, r.state, r.final_sequence) for r in df.collect())
    assert of(health.ends(told[-1])) == of(end[-1]) == [("a", "failed", 3), ("c", "completed", 2)]
    assert sorted((r.invocation_id, r.status, r.expected, r.got) for r in health.last_health(told[-1]).filter("journal = 'runtime'").collect()) == [("a", "unserializable", None, None), ("b", "unserializable", 3, 4), ("c", "unserializable", None, None)]


def test_ages_count_without_timers():
    """a batch looks at the age of what waits, also where only a user event comes."""
    advance, state = health._advance(10, True), None
    said = []
    for now, texts in ((100, ["2"]), (109, [""]), (110, [""]), (111, ["1", '3 {"told": "completed"}'])):
        state, rows = advance("a", json.loads(json.dumps(state)), texts, now)
        said += [(now, r.status, r.expected, r.got) for r in rows]
    assert said == [(110, "degraded", 1, 2), (111, "healthy", None, None)]


def test_a_repeat_after_expiry_raises_no_alarm(spark, tmp_path):
    """The state of an ended invocation has shrunk to its last sequence when a repeat of its second event comes."""
    import time

    plain = [c.split()[0] for c in TABLES["runtime_events"].split(", ")]
    put = lambda n, rows: events(spark, rows).select(plain).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    put(1, [event("a", 1), event("a", 2, "invocation.completed")])
    s = lambda: spark.readStream.schema(TABLES["runtime_events"]).parquet(f"{tmp_path}/in/*")
    made = {"gaps": streams.detect_gaps(s(), timeout_ms=0, keep_ms=1), "live": live.live_projection(s(), keep_ms=1, parts=("invocation", "execution"))}
    running = [df.writeStream.outputMode("update").foreachBatch(lambda b, n, name=name: b.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch_id={n}")).option("checkpointLocation", f"{tmp_path}/ck{name}").trigger(processingTime="500 milliseconds").start() for name, df in made.items()]
    seen = lambda q: sum(p.numInputRows for p in q.recentProgress)

    def wait(n):
        end = time.time() + 60
        while min(map(seen, running)) < n and time.time() < end:
            time.sleep(0.3)

    try:
        wait(2)
        for n, rows in ((2, [event("z", 1)]), (3, [event("z", 2)]), (4, [event("a", 2, "invocation.completed")])):
            time.sleep(2)  # timers of the end fire meanwhile
            put(n, rows)
            wait(n + 1)
        time.sleep(1)
    finally:
        for q in running:
            q.stop()
    assert spark.read.schema("invocation_id string, status string").parquet(f"{tmp_path}/gaps").filter("invocation_id = 'a'").count() == 0
    rows = spark.read.schema(live.TOLD).parquet(f"{tmp_path}/live")
    assert {(r.invocation_id, r.through_sequence) for r in rows.filter("part = 'invocation'").collect()} >= {("a", 2), ("z", 2)} and rows.filter("invocation_id = 'a' AND part = 'invocation'").count() <= 2
