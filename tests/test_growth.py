"""Parts of operators whose cost must not grow faster than their input."""

import re
import time

from pyspark.sql import functions as F

from tracelake.jobs import graph_queries, stream_queries
from tracelake.operators import agent, audit, graph, state
from tracelake.schemas import TABLES
from tracelake.sources import adapters
from tracelake.streaming import health, streams


def test_keyed_state_gets_one_text_an_event(spark):
    """what a group costs follows its number of columns."""
    assert streams._columns(spark.createDataFrame([], TABLES["runtime_events"])).columns == ["invocation_id", "event"]


def test_states_of_short_invocations_are_read_and_written_by_bundles(spark, tmp_path, monkeypatch):
    """state is one row a bundle and not one an invocation; what doesn't fit is kept apart, with the same results."""
    plain = [c.split()[0] for c in TABLES["runtime_events"].split(", ")]
    row = lambda i, s, name: (f"e{i}{s}", f"i{i}", s, 1, "state_change", name, "n", "n", s, None, name.rpartition(".")[2], "{}", "{}", None, None, None)
    late = [row(i, s, "node.running") for i in range(40) for s in (1, 3)]
    for n, rows in ((1, late), (2, [row(i, s, "invocation.completed" if s == 3 else "node.running") for i in range(40) for s in (2, 3) if i % 4]), (3, [row(40, 1, "node.running")])):
        spark.createDataFrame(rows, TABLES["runtime_events"]).select(plain).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    told = {}
    for name, together in (("whole", streams.TOGETHER), ("apart", 500)):
        monkeypatch.setattr(streams, "TOGETHER", together)
        at = lambda n: streams.run_to_end(streams.live_projection(spark.readStream.schema(TABLES["runtime_events"]).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{n}"), timers=False, bundles=3), f"{tmp_path}/{name}", f"{tmp_path}/ck-{name}", "update")  # noqa: B023, E731
        at("*")
        rows = spark.read.parquet(f"{tmp_path}/{name}").collect()
        told[name] = {r.invocation_id: (r.through_sequence, r.node_events) for r in sorted(rows, key=lambda r: r.batch_id)}
    assert told["whole"] == told["apart"] == {f"i{i}": (3, 3) if i % 4 else (1, 1) for i in range(40)} | {"i40": (1, 1)}
    state = lambda name, var: spark.read.format("statestore").option("stateVarName", var).load(f"{tmp_path}/ck-{name}").count()
    assert state("whole", "kept") == 3 == state("apart", "kept") and state("whole", "apart") == 0 < state("apart", "apart")


def test_health_of_short_invocations_is_kept_by_bundles(spark, tmp_path, monkeypatch):
    """without timers state is one row a bundle, with the same words as a state for each invocation has with timers."""
    row = lambda i, s, name: (f"e{i}{s}", f"i{i}", s, 1, "state_change", name, "n", "n", s, None, f"a\n{s}" if i == 5 and s == 1 else name.rpartition(".")[2], "{}", "{}", None, None, None)
    user = [(f"u{i}", "s", f"i{i}", 9, 1, "note", "{}", "n", "[]", None, None, 1) for i in range(41)]
    ends = lambda i: "invocation.running" if i == 5 else "invocation.completed"
    files = [
        ([row(i, s, ends(i) if s != 2 else "node.running") for i in range(40) for s in (1, 3)], [(f"i{i}", "runtime", "durable", 2 + i % 2, 1) for i in range(40)]),
        ([row(i, 2, "node.running") for i in range(40) if i % 4], [("i7", "runtime", "pending", 3, 2), ("i8", "user", "degraded", None, 1), ("i8", "user", "durable", None, 0)]),
        ([row(1, 4, "node.running"), row(3, 3, "invocation.failed"), row(40, 1, "invocation.failed")], [("i40", "runtime", "memory_only", None, 1)]),
    ]
    for n, (rows, marks) in enumerate(files):
        for name, df in (("r", spark.createDataFrame(rows, TABLES["runtime_events"])), ("u", spark.createDataFrame(user[n::3], TABLES["user_events"])), ("m", spark.createDataFrame(marks, health.MARKS))):
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}/{n}")
            time.sleep(0.02)  # files are read in the order of their times
    stream = lambda **k: health.journal_health(*[spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{t}/*") for t, s in (("r", TABLES["runtime_events"]), ("u", TABLES["user_events"]), ("m", health.MARKS))], timeout_ms=0, final=False, **k)
    each = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/timers/batch_id={n}")
    running = stream().writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{tmp_path}/ck-timers").trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 120
        while sum(p.numInputRows for p in running.recentProgress) < sum(len(r) + len(m) for r, m in files) + len(user) and time.time() < end:
            time.sleep(0.2)
    finally:
        running.stop()
    told = {"timers": spark.read.parquet(f"{tmp_path}/timers")}
    for name, together in (("whole", streams.TOGETHER), ("apart", 500)):
        monkeypatch.setattr(streams, "TOGETHER", together)
        streams.run_to_end(stream(timers=False, bundles=3), f"{tmp_path}/{name}", f"{tmp_path}/ck-{name}", "update")
        told[name] = spark.read.parquet(f"{tmp_path}/{name}")
    words = {name: sorted(map(str, df.drop("batch_id").collect())) for name, df in told.items()}
    assert words["whole"] == words["apart"] == words["timers"]
    last = {r.invocation_id: (r.state, r.final_sequence, r.persistence) for r in health.ends(told["whole"]).collect()}
    assert last == {f"i{i}": ("completed", 3, "durable") for i in range(40) if i % 2 and i not in (1, 5, 7)} | {"i40": ("failed", 1, "memory_only")}
    missing = {(r.invocation_id, r.journal): (r.expected, r.got) for r in health.last_health(told["whole"]).filter("status = 'degraded'").collect()}
    assert missing == {(f"i{i}", "runtime"): (2, 3) for i in range(0, 40, 4)} | {("i8", "user"): (None, None)}
    state = lambda name, var: spark.read.format("statestore").option("stateVarName", var).load(f"{tmp_path}/ck-{name}").count()
    assert state("whole", "kept") == 3 == state("apart", "kept") and state("whole", "apart") == 0 < state("apart", "apart")


def test_marks_are_made_in_one_pass(spark):
    """the older marks are not the invocations made again."""
    m = stream_queries.marks(spark, "/root/testdata/sf0.001", {0: "durable"}, {0: "runtime"}, {}, 4)
    assert m._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert {r.n for r in m.groupBy("invocation_id", "journal", "durable_sequence").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "marked_at_ms", "status"))).alias("n")).select(F.concat_ws(",", "n").alias("n")).collect()} == {"1 pending,2 durable"}


def test_files_of_a_stream_follow_its_rows(spark, tmp_path, monkeypatch):
    """a file, and the task that writes it, has a bounded number of rows; triggers stay two."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 10)
    assert stream_queries.dealt(spark.range(200).withColumn("id", F.col("id").cast("string")), f"{tmp_path}/a") == 10
    assert len(list((tmp_path / "a").glob("*.parquet"))) == 20
    assert stream_queries.dealt(spark.range(8).withColumn("id", F.col("id").cast("string")), f"{tmp_path}/b") == 2


def test_rounds_on_graphs_send_no_table_to_the_driver(spark):
    """nothing is broadcast, however small it looks."""
    arcs = spark.createDataFrame([("r", "e1", "a", "b"), ("r", "e2", "b", "c")], "revision_id string, edge_id string, from string, to string")
    runs = spark.createDataFrame([("x", "r")], "run_id string, revision_id string")
    skipped = graph.propagate_skips(arcs, spark.createDataFrame([], "run_id string, edge_id string, selected boolean"), spark.createDataFrame([("x", "a")], "run_id string, node_id string"), runs)
    assert sorted(r.node_id for r in skipped.collect()) == ["a", "b", "c"]
    plan = graph._met(arcs, arcs.select("revision_id", "edge_id"), ["revision_id", "edge_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_known_edges_are_found_without_the_driver(spark):
    """the nodes that edges are compared with are dealt out, not sent to all."""
    nodes, edges = adapters.graph(spark, "/root/testdata/sf0.001")
    plan = adapters.known_edges(nodes, edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_loops_are_found_without_the_driver(spark):
    """neither the graphs that loops are sought in are sent to all."""
    nodes, edges = adapters.graph(spark, "/root/testdata/sf0.001")
    plan = graph.natural_loops(nodes, adapters.known_edges(nodes, edges))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Broadcast" not in plan


def test_small_revisions_reach_python_together(spark, monkeypatch):
    """a group of Python is a bundle of revisions, as many as the nodes ask for; each revision has its own loops."""
    ids = [None, 2**60 + 1, *range(18)]
    nodes = spark.createDataFrame([(r, n, i) for r in ids for i, n in enumerate("abc")], "revision_id long, node_id string, ord int")
    edges = spark.createDataFrame([(r, f"e{i}", a, b, i) for r in ids for i, (a, b) in enumerate(["ab", "bc", "cb", "cc"][: 4 if r is None or r % 2 else 3])], "revision_id long, edge_id string, from string, to string, ord int")
    for size, bundles in ((5_000, 1), (10, 7), (1, 61)):
        monkeypatch.setattr(graph, "BUNDLE_NODES", size)
        out = graph.natural_loops(nodes, edges)
        assert re.search(rf"pmod\(xxhash64\(.*, {bundles}\) AS bundle", out._jdf.queryExecution().optimizedPlan().toString())
        told = [(r.revision_id, r.loop_id, r.header, r.node_ids, r.entry_edges, r.parent) for r in out.collect()]
        outer, inner = (("loop_1", "b", ["b", "c"], ["e0"], None), ("loop_2", "c", ["c"], ["e1"], "loop_1"))
        assert sorted(told, key=str) == sorted([(r, *x) for r in ids for x in ((outer, inner) if r is None or r % 2 else (outer,))], key=str)


def test_diagnostics_of_loops_find_components_once(spark):
    """the last step joins two tables of rounds, without components, loops and edges made again for each use."""
    out = graph.loop_diagnostics(*graph_queries.known(spark, "/root/testdata/sf0.01"))
    assert out.count() == 77
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_large_parts_are_written_once_and_measured_without_writing_leaves(spark, monkeypatch):
    """Sizes are added up; a task writes a part once for an owner; batches for Python are small."""
    calls, plain = [], state.compact
    monkeypatch.setattr(state, "compact", lambda v: calls.append(1) or plain(v))
    text = plain({"big": "x" * 9000, "in": {"list": [7] * 4500}, "s": 1})
    small, made = state._shrunk(text, 8192)
    assert len(made) == 2 and len(small) < 300 and len(calls) < 10  # 4,500 before
    monkeypatch.undo()
    rows, parts = state.externalize_trees(spark.createDataFrame([(1, "o", text), (2, "o", text), (3, "p", text)], "id int, owner string, v string").coalesce(1), "owner", "v")
    assert sorted((r.owner, r.uses, r.size_bytes) for r in parts.collect()) == [("o", 2, 9001), ("o", 2, 9002), ("p", 1, 9001), ("p", 1, 9002)]
    assert {r.v for r in rows.collect()} == {small}


def test_candidates_carry_no_lists(spark):
    """the lists of a policy are rows of their own before candidates are ranked."""
    ops = spark.createDataFrame([("c", x, 1, True, False) for x in "abde"], "capability_id string, operator_id string, priority int, enabled boolean, is_default boolean")
    policies = spark.createDataFrame([("c", "priority", ["d", "b", "d"], ["a", None], True), ("x", "default", None, None, True)], "capability_id string, mode string, preferred array<string>, excluded array<string>, allow_fallback boolean")
    out = audit.rank_candidates(ops, policies)
    assert sorted((r.rank, r.operator_id) for r in out.collect() if r.rank) == [(1, "d"), (2, "b"), (3, "e")]
    assert [r.error for r in out.collect() if r.capability_id == "x"] == ["CAPABILITY_UNAVAILABLE"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "array_position" not in plan


def test_calls_are_not_dealt_by_tool(spark):
    """all calls of one tool are not one task's."""
    calls = spark.createDataFrame([("c", 0, 0, "i", "t", "{}")], "conversation_id string, response_index long, call_index long, id string, name string, raw_arguments string")
    out = agent.validate_tool_calls(calls, spark.createDataFrame([("t", ["n"])], "name string, required array<string>"), 1)
    assert "hashpartitioning(name" not in out._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert [r.error for r in out.collect()] == ["invalid_arguments"]
