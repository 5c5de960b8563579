"""Hand-written cases of scalar rules, ingest, state, graphs, workflows, agents and streams."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tracelake.functions import events as H
from tracelake.operators import agent, audit, graph, ingest, pages, projection, state, workflow
from tracelake.schemas import TABLES
from tracelake.streaming import streams


def test_backoff(spark):
    rows = [("fixed", 2.0, None, "none", i) for i in range(3)] + [("linear", 2.0, None, "none", i) for i in range(3)] + [("exponential", 2.0, None, "none", i) for i in range(3)] + [("exponential", 3.0, 250.0, "full", 2), ("fixed", 2.0, None, "equal", 0)]
    df = spark.createDataFrame(rows, "mode string, m double, most double, jitter string, i int")
    got = [(r.d.low, r.d.high) for r in df.select(H.retry_delay_ms(F.col("mode"), F.lit(100.0), F.col("m"), F.col("most"), F.col("jitter"), F.col("i")).alias("d")).collect()]
    assert got == [(100, 100)] * 3 + [(100, 100), (300, 300), (500, 500)] + [(100, 100), (200, 200), (400, 400)] + [(0, 250), (50, 100)]


def test_revision_ids_are_name_based_uuids(spark):
    rows = [("wf", "h1"), ("", ""), ("ä", "x" * 99)]
    got = [r.r for r in spark.createDataFrame(rows, "w string, h string").select(H.revision_id(F.col("w"), F.col("h")).alias("r")).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(H.REVISION_NAMESPACE), f"{w}\0{h}")) for w, h in rows]


def test_timestamps(spark):
    cases = {"5": 5, "-7": -7, "1.9": 1, '"2024-01-01T00:00:00Z"': 1704067200000, '"2024-01-01T02:00:00+02:00"': 1704067200000, '"2024-01-01T00:00:00.250"': 1704067200250, "true": None, '"junk"': None}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", H.coerce_timestamp_ms(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == cases


def test_append_is_idempotent(spark):
    fields = TABLES["runtime_events"]
    row = lambda s, **k: tuple({**dict(id=f"e{s}", invocation_id="i", sequence=s, schema_version=1, event_type="t", event_name="n", subject_type="s", subject_id="x", occurred_at_ms=s, elapsed_ns=None, status=None, timing_json="{}", payload_json="{}", input_json=None, output_json=None, operations_json=None), **k}.values())
    journal = spark.createDataFrame([row(1), row(2)], fields)
    batch = spark.createDataFrame([row(1), row(2, status="other"), row(3), row(3), row(4), row(4, status="z")], fields)
    new, same, conflicts = ingest.append(journal, batch)
    assert sorted(r.sequence for r in new.collect()) == [3, 4] and sorted(r.sequence for r in same.collect()) == [1, 3] and sorted(r.sequence for r in conflicts.collect()) == [2, 4]
    again, _, _ = ingest.append(journal.union(new), batch)
    assert again.count() == 0


def test_sequences_start_at_one_for_each_key(spark):
    batch = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "k string, o int")
    stored = spark.createDataFrame([("a", 4)], "k string, sequence long")
    assert {(r.k, r.sequence) for r in pages.assign_sequences(batch, stored, "k", ["o"]).collect()} == {("a", 5), ("a", 6), ("b", 1)}


def test_large_values_become_one_artifact(spark):
    big = "x" * 10_240
    df = spark.createDataFrame([("i", 1, big), ("i", 2, big), ("j", 3, big), ("i", 4, "small")], "owner string, id int, v string")
    rows, artifacts = ingest.externalize(df, "owner", "v")
    assert artifacts.count() == 2
    store = artifacts.select(F.col("sha256").alias("id"), F.to_json(F.struct("payload")).alias("payload")).distinct()
    back = state.hydrate_artifacts(rows.select("id", "v"), "id", "v", store).collect()
    assert all(json.loads(r.v)["payload"] == big if r.id != 4 else r.v == "small" for r in back)


def tree(rng, depth=3):
    kind = rng.randrange(4 if depth else 2)
    if kind == 0:
        return rng.choice([None, True, 1, 2.5, "s", "é"])
    if kind == 1:
        return rng.randrange(5)
    if kind == 2:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcd/~"): tree(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_edits_lead_from_one_tree_to_the_other():
    rng = random.Random(3)
    for _ in range(500):
        a, b = {"r": tree(rng), "k": 1}, {"r": tree(rng), "z": tree(rng)}
        assert state.apply_edits(json.loads(json.dumps(a)), state.edits(a, b)) == b
    assert state.differing({"a/b": 1, "l": [1]}, {"a/b": 2, "l": [2], "~": 1}) == ["/a~1b", "/l", "/~0"]


def test_replay_and_its_errors(spark):
    rng = random.Random(4)
    trees = [{"l": [], "n": {}}]
    for _ in range(12):
        trees.append({"l": [rng.randrange(3) for _ in range(rng.randrange(5))], "n": {rng.choice("abc"): tree(rng)}})
    ops = [json.dumps(state.edits(a, b)) for a, b in zip(trees, trees[1:], strict=False)]
    events = [("i", s, o) for s, o in enumerate(ops, 1)] + [("gap", 1, ops[0]), ("gap", 3, ops[2]), ("none", 1, None)]
    rng.shuffle(events)
    snapshots = [("i", 0, json.dumps(trees[0])), ("i", 5, json.dumps(trees[5])), ("gap", 0, json.dumps(trees[0])), ("none", 0, "{}")]
    got = state.replay_state(
        spark.createDataFrame(snapshots, "invocation_id string, event_sequence long, state_json string"),
        spark.createDataFrame(events, "invocation_id string, sequence long, operations_json string").repartition(3),
        spark.createDataFrame([("i", s) for s in range(13)] + [("gap", 3), ("none", 1), ("unknown", 1)], "invocation_id string, target_sequence long"),
    ).collect()
    for r in got:
        if r.invocation_id == "i":
            assert json.loads(r.state_json) == trees[r.target_sequence] and r.error is None
        else:
            assert r.error.startswith({"gap": "gap: expected 2, got 3", "none": "no_operations", "unknown": "no_snapshot"}[r.invocation_id])


def test_references_are_followed_to_the_end(spark):
    ref = lambda i: '{"$artifact":"%s"}' % i
    chain = [(f"a{k}", f'{{"k":{k},"in":{ref(f"a{k + 1}")}}}') for k in range(12)] + [("a12", "[1]")]
    artifacts = [*chain, ("x", f"[{ref('y')}]"), ("y", f"[{ref('x')}]"), ("behind", ref("x")), ("self", ref("self")), ("lacks", f"[{ref('gone')},{ref('a12')}]")]
    rows = [(1, ref("a0")), (2, f"[{ref('x')}]"), (3, f"[{ref('lacks')},{ref('a12')},{ref('nowhere')}]"), (4, "7"), (5, None), (6, ref("behind"))]
    out = {r.id: r for r in state.hydrate_artifacts(spark.createDataFrame(rows, "id int, v string"), "id", "v", spark.createDataFrame(artifacts, "id string, payload string")).collect()}
    v, depth = json.loads(out[1].v), 0
    while isinstance(v, dict):
        assert v["k"] == depth
        v, depth = v["in"], depth + 1
    assert (v, depth, out[1].missing, out[1].cyclic) == ([1], 12, [], [])
    assert out[2].cyclic == ["x"] and out[2].v == '[{"$cyclic":"x"}]' and out[6].cyclic == ["behind"]
    assert out[3].missing == ["gone", "nowhere"] and out[3].v == '[[{"$missing":"gone"},[1]],[1],{"$missing":"nowhere"}]'
    assert out[4].v == "7" and out[5].v is None and out[5].missing == []


def test_null_states_and_equal_values(spark):
    rows = [(None, '{"a":1}'), ('{"a":1}', None), (None, None), ('{"a":1}', '{"a":true}'), ("1", "true")]
    out = spark.createDataFrame(rows, "a string, b string").select(state.diff_states("a", "b").alias("e"), state.changed_paths("a", "b").alias("p")).collect()
    assert [json.loads(r.e) for r in out] == [[{"op": "replace", "path": [], "value": {"a": 1}}], [{"op": "replace", "path": [], "value": None}], [], [], []]
    assert [r.p for r in out] == [["/"], ["/"], [], [], []]
    contexts = spark.createDataFrame([("c", None, 0), ("d", "{}", 1)], "context_id string, data_json string, revision long")
    writes = spark.createDataFrame([("c", 1, "a/b", None, 0, 1)], "context_id string, write_id int, path string, value string, base_revision long, revision long")
    got = {r.context_id: (json.loads(r.data_json), r.revision) for r in state.merge_context_writes(contexts, writes).collect()}
    assert got == {"c": ({"a": {"b": None}}, 1), "d": ({}, 1)}


def test_latencies_of_skewed_groups(spark):
    rng = random.Random(8)
    groups = {"one": [5], "same": [7] * 400, "wide": [rng.randrange(10**9) for _ in range(1001)], "skew": [1] * 900 + [10**8] * 3, None: [1, 2, 4], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    out = {r.g: r for r in audit.latency_stats(spark.createDataFrame(rows, "g string, v long"), "g", "v").collect()}
    assert set(out) == {g for g, vs in groups.items() if vs}
    for g, r in out.items():
        vs, n = sorted(groups[g]), len(groups[g])
        assert (r.runs, r.p95, r.median) == (n, vs[int((n - 1) * 0.95)], (vs[(n - 1) // 2] + vs[n // 2]) / 2)


def test_results_quote_node_ids(spark):
    executions = spark.createDataFrame([("i", n, f"x{k}", 1, "completed") for k, n in enumerate(['a"b', "c\\d"])], "invocation_id string, node_id string, execution_id string, ordinal long, state string")
    outputs = spark.createDataFrame([("i", "x0", "1"), ("i", "x1", "[2]")], "invocation_id string, execution_id string, output_json string")
    got = projection.invocation_results(executions, executions.select("node_id"), outputs).first().result_json
    assert json.loads(got) == {"outputs": {'a"b': 1, "c\\d": [2]}}


def test_views_of_tagged_values(spark):
    v = {"a": {"$type": "decimal", "value": "1.5"}, "b": {"$type": "tuple", "value": [{"$type": "set", "value": [1]}]}, "c": {"$type": "artifact", "value": {"id": 1}}}
    assert state.view(v) == {"a": "1.5", "b": [[1]], "c": {"$artifact": {"id": 1}}}
    r = spark.createDataFrame([(json.dumps(v),), ('{"$type":"who"}',), ("junk",), (None,)], "v string").select(state.json_view("v").alias("x")).collect()
    assert json.loads(r[0].x.view) == state.view(v) and all(x.x.view is None and x.x.error for x in r[1:])


def test_context_conflicts(spark):
    rows = [("c", 1, 0, 1, "a/b"), ("c", 2, 0, 2, "a/b/c"), ("c", 3, 2, 3, "a"), ("c", 4, 0, 4, "x"), ("c", 5, 4, 5, "ab")]
    got = {(r.write_id, r.other_id) for r in audit.context_conflicts(spark.createDataFrame(rows, "context_id string, write_id long, base_revision long, revision long, path string")).collect()}
    assert got == {(2, 1)}


def graph_tables(spark, arcs, names="abcdefgh"):
    nodes = spark.createDataFrame([("r", n, i, []) for i, n in enumerate(names)], "revision_id string, node_id string, ord int, workflow_path array<string>")
    edges = spark.createDataFrame([("r", f"e{i}", a, b, i, []) for i, (a, b) in enumerate(arcs)], "revision_id string, edge_id string, from string, to string, ord int, workflow_path array<string>")
    return nodes, edges


def test_nested_loops(spark):
    nodes, edges = graph_tables(spark, ["ab", "bc", "cd", "dc", "de", "eb", "ef"], "abcdef")
    loops = {r.header: r for r in graph.natural_loops(nodes, edges).collect()}
    assert set(loops) == {"b", "c"} and loops["b"].node_ids == list("bcde") and loops["c"].node_ids == list("cd")
    assert loops["c"].parent == loops["b"].loop_id and (loops["b"].depth, loops["c"].depth) == (0, 1)
    assert (loops["b"].back_edges, loops["b"].exit_edges, loops["b"].entry_edges, loops["c"].exit_edges) == (["e5"], ["e6"], ["e0"], ["e4"])
    assert graph.loop_diagnostics(nodes, edges).count() == 0


def test_irreducible_cycle(spark):
    nodes, edges = graph_tables(spark, ["ab", "ac", "bc", "cb"], "abc")
    assert [tuple(r) for r in graph.loop_diagnostics(nodes, edges).collect()] == [("r", "CYCLE_ENTRIES", "b")]


def test_levels_and_components(spark):
    nodes, edges = graph_tables(spark, ["ab", "ac", "bd", "cd", "ef", "fe", "fg"], "abcdefg")
    assert {r.node_id: r.level for r in graph.topological_levels(nodes, edges).collect()} == dict(a=0, b=1, c=1, d=2, e=None, f=None, g=None)
    assert {r.node_id: (r.component_id, r.is_cycle) for r in graph.strong_components(nodes, edges).collect() if r.is_cycle} == dict(e=("e", True), f=("e", True))


def test_skips_stop_at_a_fan_in(spark):
    _, edges = graph_tables(spark, ["ab", "ac", "bd", "cd", "be", "ef"], "abcdef")
    decisions = spark.createDataFrame([("run", "e0", False), ("run", "e1", True)], "run_id string, edge_id string, selected boolean")
    none = spark.createDataFrame([], "run_id string, node_id string")
    assert {r.node_id for r in graph.propagate_skips(edges, decisions, none).collect()} == set("bef")


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(23)
    nodes, edges, want = [], [], {}
    for r in range(6):
        n = rng.randrange(1, 15)
        own = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n + 1))]
        nodes += [(f"r{r}", f"n{i:02}") for i in range(n)]
        edges += [(f"r{r}", f"n{a:02}", f"n{b:02}") for a, b in own]
        reach = {i: {i} for i in range(n)}
        for _ in range(n):
            for a, b in own:
                reach[a] |= reach[b]
        for i in range(n):
            mates = [j for j in range(n) if j in reach[i] and i in reach[j]]
            want[f"r{r}", f"n{i:02}"] = (f"n{min(mates):02}", len(mates) > 1 or (i, i) in own)
    out = graph.strong_components(spark.createDataFrame(nodes, "revision_id string, node_id string"), spark.createDataFrame(edges, "revision_id string, from string, to string")).collect()
    assert {(r.revision_id, r.node_id): (r.component_id, r.is_cycle) for r in out} == want and len(out) == len(want)


def test_loop_conflict(spark):
    loops = spark.createDataFrame([("l", "back", "back"), ("l", "exit", "exit")], "loop_id string, edge_id string, role string")
    d = spark.createDataFrame([("s1", "back", True), ("s1", "exit", True), ("s2", "back", True), ("s2", "exit", False), ("s3", "back", False), ("s3", "exit", False), ("s4", "back", True)], "scope_key string, edge_id string, selected boolean")
    assert {r.scope_key: r.outcome for r in audit.loop_outcomes(loops, d).collect()} == dict(s1="conflict", s2="continue", s3="dead_end", s4="incomplete")


def test_deltas_merge_to_32_characters(spark):
    rows = [("c", i, 0, "text_delta", "x", None, None, None) for i in range(100)] + [("d", 0, 0, "text_delta", "ab", None, None, None), ("d", 1, 9, "text_delta", "c", None, None, None), ("d", 2, 9, "completed", "abc", None, None, None), ("t", 0, 0, "tool_call_delta", "{", 0, None, "f"), ("t", 1, 0, "tool_call_delta", "}", 0, "id", None), ("t", 2, 0, "tool_call_delta", "{", 1, None, None)]
    df = spark.createDataFrame(rows, "call_id string, seq long, at_ms long, type string, text string, tool_index int, tool_id string, tool_name string")
    out = {}
    for r in agent.coalesce_deltas(df.repartition(4)).orderBy("call_id", "position").collect():
        out.setdefault(r.call_id, []).append(r.text)
    assert [len(x) for x in out["c"]] == [32, 32, 32, 4] and out["d"] == ["ab", "c", "abc"] and out["t"] == ["{}", "{"]


def user_event(seq, kind, call="c", path="[]", **data):
    return (f"u{seq}", "s", "i", seq, 1, kind, json.dumps(data), "n", path, "x", call, seq * 10)


def test_messages_tools_and_items(spark):
    df = spark.createDataFrame([
        user_event(1, "reasoning_delta", delta="thi"), user_event(2, "reasoning_delta", delta="nk"), user_event(3, "message_delta", delta="par"), user_event(4, "message_completed", message={"content": "whole", "reasoning_content": "other"}),
        user_event(5, "tool_call_delta", tool_call_index=0, tool_name="f", arguments_delta="{"), user_event(6, "tool_call_delta", tool_call_index=0, tool_call_id="t1", arguments_delta="}"), user_event(7, "tool_call_requested", calls=[{"tool_call_id": "t1", "name": "f", "raw_arguments": ""}]),
        user_event(8, "tool_result", results=[{"tool_call_id": "t1", "output": "o"}, {"tool_call_id": "t9", "error": "e"}]), user_event(9, "message_completed", call=None, message={"content": "late"}), user_event(10, "odd_type", v=1),
    ], TABLES["user_events"]).repartition(3)
    m = {r.message_key: r for r in agent.messages(df).collect()}
    assert (m["c"].content, m["c"].reasoning, m["c"].completed, m["c"].first_sequence, m["c"].message_sequence) == ("whole", "think", True, 1, 3) and m["x"].content == "late"
    t = {r.tool_key: r for r in agent.tool_calls(df).collect()}
    assert (t["t1"].name, t["t1"].raw_arguments, t["t1"].output, t["t1"].requested_at_ms, t["t1"].first_sequence) == ("f", "{}", "o", 70, 5) and t["t9"].error == "e"
    assert {(r.kind, r.sequence) for r in agent.activity_items(df).filter("block_key = 'llm:c'").collect()} == {("thinking", 1), ("message", 3), ("tool", 5), ("tool", 8)}
    shown = df.union(spark.createDataFrame([user_event(11, "agent_output", output="x")], TABLES["user_events"]))
    assert "message" not in {r.kind for r in agent.activity_items(shown).collect()} and {r.block_kind for r in agent.activity_blocks(shown).collect()} == {"react", "custom"}
    zero = spark.createDataFrame([("i", 6)], "invocation_id string, read_through long")
    assert agent.unread_counts(shown, zero).first().unread == 6


def test_retries_then_fallbacks(spark):
    def flaky(x):
        raise RuntimeError("down")

    df = spark.createDataFrame([("1",)], "x string")
    r = workflow.call_with_retry(df, "x", [flaky, lambda x: x + "!"], 2).first()
    assert r.output == "1!" and [a.reason for a in r.attempts] == ["normal", "retry", "fallback"]
    r = workflow.call_with_retry(df, "x", [flaky, lambda x: x], 2, budget=2).first()
    assert (r.output, r.error, len(r.attempts)) == (None, "attempt_budget_exhausted", 2)


def test_routes_are_inclusive(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    rows, decisions = workflow.route(df, {"a": F.col("x") > 0, "b": F.col("x") > 1, "c": None})
    assert sorted((r.x, r.edge_id) for r in rows.collect()) == [(1, "a"), (1, "c"), (2, "a"), (2, "b"), (2, "c")]
    assert decisions.filter("state = 'failed'").count() == 2


def test_limits_of_rows(spark):
    out = workflow.validate_rows(spark.createDataFrame([('{"a":1}',), ('{"a":1.5}',), ('{"a":true,"z":1}',), (None,), ("{}",)], "v string"), "v", {"a": ("integer", True)})
    assert [r.problems for r in out.collect()] == [[], ["type:a"], ["type:a", "extra:z"], ["not_an_object"], ["missing:a"]]


def test_stream_gap_holds_events_back(spark, tmp_path):
    fields = TABLES["runtime_events"]
    row = lambda s, name: (f"e{s}", "i", s, 1, "state_change", name, "n", "n", s, None, name.rpartition(".")[2], "{}", "{}", None, None, None)
    write = lambda rows, n: spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda: streams.run_to_end(streams.live_projection(spark.readStream.schema(fields).parquet(f"{tmp_path}/in/*"), timers=False), f"{tmp_path}/out", f"{tmp_path}/ck", "update")
    last = lambda: spark.read.parquet(f"{tmp_path}/out").orderBy(F.desc("batch_id")).first()
    write([row(3, "invocation.completed"), row(1, "node.running")], 1)
    run()
    assert (last().state, last().through_sequence) == ("created", 1)
    write([row(2, "invocation.running"), row(1, "node.running")], 2)
    run()
    assert (last().state, last().through_sequence, last().node_events) == ("completed", 3, 1)


def test_stuck_gap_degrades(spark, tmp_path):
    fields = TABLES["runtime_events"]
    rows = [(f"e{s}", "i", s, 1, "t", "node.running", "n", "n", s, None, "running", "{}", "{}", None, None, None) for s in (1, 3)]
    spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/in")
    stream = streams.detect_gaps(spark.readStream.schema(fields).parquet(f"{tmp_path}/in"), timeout_ms=1000)
    q = stream.writeStream.format("memory").queryName("gaps").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if (got := spark.sql("select * from gaps").collect()) or q.awaitTermination(1):
                break
    finally:
        q.stop()
    assert tuple(got[0]) == ("i", 2, 3, "degraded")


def stream_row(s, name, **k):
    return tuple({**dict(id=f"e{s}", invocation_id="i", sequence=s, schema_version=1, event_type="t", event_name=name, subject_type="n", subject_id="n", occurred_at_ms=s, elapsed_ns=None, status=name.rpartition(".")[2], timing_json="{}", payload_json="{}", input_json=None, output_json=None, operations_json=None), **k}.values())


def test_stream_end_is_told_once_and_only_when_nothing_is_missing(spark, tmp_path):
    fields = TABLES["runtime_events"]
    write = lambda rows, n: spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda: streams.run_to_end(streams.detect_stream_end(spark.readStream.schema(fields).parquet(f"{tmp_path}/in/*"), timers=False), f"{tmp_path}/out", f"{tmp_path}/ck")
    told = lambda: [(r.invocation_id, r.state, r.final_sequence) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    write([stream_row(1, "invocation.running"), stream_row(3, "invocation.completed"), stream_row(1, "invocation.failed", invocation_id="j")], 1)
    run()
    assert told() == [("j", "failed", 1)]  # i lacks event 2
    write([stream_row(2, "node.running")], 2)
    run()
    assert sorted(told()) == [("i", "completed", 3), ("j", "failed", 1)]
    write([stream_row(3, "invocation.completed"), stream_row(9, "node.running"), stream_row(1, "invocation.failed", invocation_id="j")], 3)
    run()
    assert len(told()) == 2


def test_a_gap_degrades_although_events_go_on(spark, tmp_path):
    """The timeout counts from the gap's start, not from the last event."""
    import time

    fields = TABLES["runtime_events"]
    write = lambda rows, n: spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda: streams.run_to_end(streams.detect_gaps(spark.readStream.schema(fields).parquet(f"{tmp_path}/in/*"), timeout_ms=4000, timers=False), f"{tmp_path}/out", f"{tmp_path}/ck", "update")
    told = lambda: [tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch_id").collect()]
    write([stream_row(1, "node.running"), stream_row(3, "node.running")], 1)
    run()
    assert told() == []
    for n in (4, 5):
        time.sleep(2.2)
        write([stream_row(n, "node.running")], n)
        run()
    assert told() == [("i", 2, 3, "degraded")]
    write([stream_row(2, "node.running")], 9)
    run()
    assert told() == [("i", 2, 3, "degraded"), ("i", 6, None, "healthy")]


def test_states_of_ended_invocations_are_removed(spark, tmp_path):
    import time

    fields = TABLES["runtime_events"]
    rows = [stream_row(1, "invocation.completed"), stream_row(1, "invocation.running", invocation_id="k")]
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/in")
    made = {"m2": (streams.live_projection, "update"), "m4": (streams.detect_stream_end, "append"), "m8": (streams.waits_open, "append"), "m5": (streams.detect_gaps, "update")}
    queries = [f(spark.readStream.schema(fields).parquet(f"{tmp_path}/in"), keep_ms=500, mark_ms=500).writeStream.format("noop").outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(processingTime="1 second").start() for name, (f, mode) in made.items()]
    left = lambda name: sorted(r.key[0] for r in spark.read.format("statestore").load(f"{tmp_path}/{name}").collect())
    try:
        for _ in range(60):
            time.sleep(1)
            if all(q.lastProgress and q.lastProgress["batchId"] > 3 for q in queries):
                break
    finally:
        for q in queries:
            q.stop()
    assert [left(name) for name in made] == [["k"]] * 4


def test_stream_append_replays_and_reads_near_days_only(spark, tmp_path):
    fields, day = TABLES["runtime_events"], 86_400_000
    row = lambda i, s, d, **k: stream_row(s, "node.running", invocation_id=i, id=f"{i}{s}", occurred_at_ms=d * day + s, **k)
    write = lambda rows, n: spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda ck: streams.stream_append(spark.readStream.schema(fields).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/journal", f"{tmp_path}/conflicts", f"{tmp_path}/{ck}", days=2).trigger(availableNow=True).start().awaitTermination()
    write([row("a", 1, 100), row("a", 2, 100), row("b", 1, 300)], 1)
    run("ck")
    write([row("a", 2, 100), row("a", 3, 101), row("a", 1, 101, status="other"), row("b", 2, 300)], 2)
    run("ck")
    keys = lambda: sorted((r.invocation_id, r.sequence) for r in spark.read.parquet(f"{tmp_path}/journal").collect())
    conflicts = lambda: [(r.invocation_id, r.sequence, r.status) for r in spark.read.parquet(f"{tmp_path}/conflicts").collect()]
    want = [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert keys() == want and conflicts() == [("a", 1, "other")]
    run("another")  # all batches once more, as after a lost checkpoint
    assert keys() == want and set(conflicts()) == {("a", 1, "other")}


def test_any_exception_is_tried_again_and_mapping_errors_are_final(spark):
    df = spark.createDataFrame([("a",), ("bad",)], "x string")

    def once(x, seen=[]):  # noqa: B006  counts its calls
        seen.append(x)
        if len(seen) % 2:
            raise ValueError("first time")
        return x

    def mapping(x):
        if x == "bad":
            raise KeyError("no such input")
        return x + x

    rows = {r.x: r for r in workflow.call_with_retry(df.coalesce(1), "x", [once], 3, mapping=mapping).collect()}
    assert rows["a"].output == "aa" and [a.error for a in rows["a"].attempts] == ["first time", None]
    assert rows["bad"].output is None and "no such input" in rows["bad"].error and rows["bad"].attempts == []


def test_usage_needs_all_counters(spark):
    df = spark.createDataFrame([("x", *range(7)), ("x", *[None] * 7), ("x", *range(7))], "execution_id string, " + ", ".join(f"{c} long" for c in audit.USAGE))
    row = audit.resource_usage(df).first()
    assert [row[c] for c in audit.USAGE] == [2 * k for k in range(7)]
    with pytest.raises(Exception, match="concurrency_wait_ns"):
        audit.resource_usage(df.drop("concurrency_wait_ns"))


def test_fold_takes_result_error_and_mode(spark):
    from tracelake.operators import ingest

    inv = spark.createDataFrame([("i", "s", "v", "n", "running", "live", "full", 1, None, "old", None, None, 1, 1)], TABLES["invocations"])
    batch = spark.createDataFrame([("i", 3, "failed", "test", None, "E", 9), ("i", 2, "completed", None, "R", None, 8), ("i", 4, None, None, None, None, 10)], "invocation_id string, sequence long, state string, execution_mode string, result_json string, error_json string, occurred_at_ms long")
    r = ingest.fold_events(inv, batch).first()
    assert (r.state, r.execution_mode, r.result_json, r.error_json, r.durable_sequence, r.updated_at_ms) == ("failed", "test", None, "E", 4, 10)
    late = ingest.fold_events(inv.withColumn("state_sequence", F.lit(5).cast("long")).withColumn("durable_sequence", F.lit(5).cast("long")), batch).first()
    assert (late.state, late.result_json, late.durable_sequence, late.updated_at_ms, late.state_sequence) == ("running", "old", 5, 1, 5)


def test_loop_headers_wait_for_entries_then_for_back_edges(spark):
    edges = spark.createDataFrame([("in", "h"), ("back", "h"), ("body", "b"), ("out", "z")], "edge_id string, to string")
    headers = spark.createDataFrame([("h", "L", "in", "entry"), ("h", "L", "back", "back")], "node_id string, loop_id string, edge_id string, role string")
    scope = lambda *f: [{"loop_id": k, "iteration": n} for k, n in f]
    told = [("i", scope(("L", 0)), "in", True), ("i", scope(("L", 1)), "back", True), ("i", scope(("L", 2)), "back", False), ("j", scope(("O", 3), ("L", 0)), "in", False), ("j", scope(), "out", False), ("k", scope(("L", 1)), "in", True)]
    decisions = spark.createDataFrame(told, "invocation_id string, scope array<struct<loop_id: string, iteration: int>>, edge_id string, selected boolean")
    got = {(r.invocation_id, r.node_id, tuple((f.loop_id, f.iteration) for f in r.scope)): r.status for r in audit.fan_in_loops(edges, decisions, headers).collect()}
    assert got == {("i", "h", (("L", 0),)): "ready", ("i", "h", (("L", 1),)): "ready", ("i", "h", (("L", 2),)): "skipped", ("j", "h", (("O", 3), ("L", 0))): "loop_skipped", ("j", "z", ()): "skipped", ("k", "h", (("L", 1),)): "pending"}


def test_trees_lose_their_large_parts_first(spark):
    import hashlib
    import json

    inner = "é" * 50
    rows = [(1, "i", json.dumps({"k": [inner, inner, {"$artifact": "x"}], "n": 1})), (2, "i", json.dumps(inner)), (3, "j", json.dumps([9] * 60)), (4, "j", None), (5, "j", "[1, 2]"), (6, "i", json.dumps([inner]))]
    out, parts = state.externalize_trees(spark.createDataFrame(rows, "id long, owner string, v string"), "owner", "v", 100)
    body = json.dumps(inner)
    ref = '{"$artifact":"' + hashlib.sha256(body.encode()).hexdigest() + '"}'
    got = {r.id: r.v for r in out.collect()}
    assert (got[2], got[4], got[5], got[6]) == (ref, None, "[1, 2]", "[" + ref + "]")
    assert got[1] != rows[0][2] and got[3].startswith('{"$artifact"')
    made = {(r.owner, r.sha256): (r.payload, r.uses, r.size_bytes) for r in parts.collect()}
    assert made["i", hashlib.sha256(body.encode()).hexdigest()] == (body, 3, len(body)) and len(made) == 3
    assert state._shrunk(json.dumps([0] * 900 + [1]), 10_000)[1] == []


def test_dominators_by_taking_nodes_away():
    import random

    rng = random.Random(3)
    for _ in range(400):
        names = [f"n{k}" for k in range(rng.randint(1, 9))]
        succ = {}
        for _ in range(rng.randint(0, 16)):
            succ.setdefault(rng.choice(names), []).append(rng.choice(names))
        entries = [x for x in names if not any(x in v for v in succ.values())]

        def reach(without):
            seen, todo = set(), [e for e in entries if e != without]
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += [m for m in succ.get(x, ()) if m != without]
            return seen

        tree = graph._Dominators(entries, succ)
        assert set(tree.order) == reach(None)
        for x in tree.order:
            want = {d for d in tree.order if d == x or x not in reach(d)}
            assert set(tree.of(x)) == want == {d for d in tree.order if tree.over(d, x)}


def test_edits_lead_from_one_tree_to_the_other():
    import copy
    import random

    rng = random.Random(4)

    def tree(depth=0):
        if depth > 3 or rng.random() < 0.4:
            return rng.choice([1, True, None, "a", [1], [1, 2], [1, 2, 3], {}, 0])
        return {rng.choice("ab/~c"): tree(depth + 1) for _ in range(rng.randint(0, 3))}

    for _ in range(3000):
        a, b = {"r": tree()}, {"r": tree(), **({"z": 1} if rng.random() < 0.3 else {})}
        assert state.apply_edits(copy.deepcopy(a), state.edits(a, b)) == b
        assert bool(state.edits(a, b)) == (a != b) == bool(state.differing(a, b))


def test_json_schemas_reach_nested_parts(spark):
    from tracelake.functions.json_schema import json_problems

    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": ["integer", "null"]}, "a": {"type": "array", "items": {"type": "object", "properties": {"u": {"enum": ["x", 1, None]}}}}}}
    want = {
        '{"n":1}': [], '{"n":null,"a":[]}': [], '{"n":12345678901234567890}': [], '{"n":"1"}': ["type:/n"], '{"n":1.5}': ["type:/n"], "[]": ["type:$"], "null": ["type:$"], "{": ["no_json"], None: ["no_json"],
        '{"n":1,"b":2}': ["extra:/b"], '{"a":[{"u":"x"},{"u":1},{"u":null}]}': ["missing:/n"], '{"n":1,"a":[{"u":2},{"u":3},5]}': ["enum:/a/*/u", "type:/a/*"], '{"n":1,"a":{}}': ["type:/a"],
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: sorted(r.p) for r in df.select("t", json_problems("t", schema).alias("p")).collect()} == want


def test_changes_are_told_by_trigger(spark, tmp_path):
    fields = TABLES["runtime_events"]
    put = lambda n, rows: spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    owners = spark.createDataFrame([("i", "s"), ("j", "s"), ("k", "t")], "id string, session_id string")
    run = lambda: streams.session_changes(spark.readStream.schema(fields).parquet(f"{tmp_path}/in/*"), owners, f"{tmp_path}/out", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    put(1, [stream_row(1, "node.running"), stream_row(2, "node.running"), stream_row(1, "node.running", invocation_id="k")])
    run()
    put(2, [stream_row(1, "node.running", invocation_id="j")])
    run()
    told = sorted((r.batch_id, r.session_id, r.invocation_id, r.events, r.through_sequence) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert told == [(0, "s", "i", 2, 2), (0, "t", "k", 1, 1), (1, "s", "j", 1, 1)]


def test_change_against_a_baseline(spark):
    stats = spark.createDataFrame([("a", 2.0, 10.0), ("b", 3.0, 5.0), ("c", None, None)], "g string, median double, runs_per_s double")
    rows = {r.g: (r.latency_change_percent, r.throughput_change_percent) for r in audit.latency_change(stats, stats.filter("g = 'a'"), "g").collect()}
    assert rows == {"a": (0.0, 0.0), "b": (50.0, -50.0), "c": (None, None)}
    assert audit.latency_change(stats, stats.filter("g = 'z'"), "g").filter("latency_change_percent IS NOT NULL").count() == 0


def test_sizes_of_all_tables(spark):
    one = {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
    one["invocations"] = spark.createDataFrame([("i", "s", "v", "n", "running", "live", "full", 1, "{}", None, "[1]", '{"a":1}', 1, 1)], TABLES["invocations"])
    rows = {r.part: (r.rows, r.size) for r in audit.journal_sizes(one).collect()}
    assert rows["invocations"] == (1, 12) and rows["genesis"] == (1, 7) and rows["artifacts"] == (0, 0) and len(rows) == len(audit.SIZED)


def test_newest_conflicts_are_those_of_pairs(spark):
    import random

    rng = random.Random(9)
    rows = [("c", n, rng.randint(0, 40), rng.randint(1, 40), rng.choice(["a", "a/b", "a/b/c", "a/bc", "b", "b/x", "a/b/c/d"])) for n in range(150)]
    df = spark.createDataFrame(rows, "context_id string, write_id long, base_revision long, revision long, path string")
    newest = {}
    for r in audit.context_conflicts(df).collect():
        newest[r.write_id] = max(newest.get(r.write_id, (0, 0)), (rows[r.other_id][3], r.other_id))
    assert {r.write_id: (r.other_revision, r.other_id) for r in audit.newest_conflicts(df).collect()} == newest
