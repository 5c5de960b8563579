"""Projection rules on hand-written journals, and against a plain fold on random ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import pages
from tracelake.operators import projection as P
from tracelake.schemas import TABLES

INV = "i"


def event(seq, name, at=None, status=None, kind=None, inv=INV, **payload):
    kind = kind or ("routing" if name.startswith("edge.") else "operator_call" if name.startswith("operator_call.") else "wait" if name.startswith("wait.") else "state_change" if name.split(".")[0] in ("node", "invocation") else "phase")
    return dict(id=f"{inv}{seq}", invocation_id=inv, sequence=seq, schema_version=1, event_type=kind, event_name=name, subject_type="node", subject_id=payload.get("node_id", "s"), occurred_at_ms=at if at is not None else seq * 10, elapsed_ns=seq * 1000, status=status or name.rpartition(".")[2], timing_json="{}", payload_json=json.dumps(payload), input_json=None, output_json=None, operations_json=None)


@pytest.fixture
def journal(spark):
    return lambda rows: P.prepare(spark.createDataFrame([tuple(r.values()) for r in rows], TABLES["runtime_events"]))


def test_counts_of_calls_edges_and_a_cancelled_node(journal):
    x = dict(node_id="worker", node_execution_id="e")
    p = journal([
        event(1, "node.running", **x),
        event(3, "operator_call.completed", operator_call_id="primary", node_execution_id="e", state="failed", reason="normal", error={"code": "OPERATOR_TIMEOUT", "message": "t"}),
        event(4, "operator_call.completed", operator_call_id="fallback", node_execution_id="e", state="completed", reason="fallback", streaming=True, stream_chunk_count=7),
        {**event(5, "operator_call.completed"), "payload_json": json.dumps(dict(operator_call_id="mapped", node_execution_id="e", state="completed", kind="map", summary={"call_count": 8}))},
        event(6, "edge.evaluated", edge_id="worker->done", selected=True, state="selected"),
        event(7, "node.cancelled", error={"code": "INVOCATION_FAILED_FAST", "message": "f"}, **x),
    ])
    n = P.project_nodes(p).first()
    assert (n.state, n.operator_call_count, n.failed_operator_call_count, n.fallback_count, n.timeout_count, n.streaming_call_count, n.stream_chunk_count, n.parallel_call_count) == ("cancelled", 3, 1, 1, 1, 1, 7, 8)
    assert P.project_node_executions(p).first().first_event_sequence == 1 and P.invocation_states(p).first().through_sequence == 7


def test_a_skip_does_not_erase_a_run(journal):
    x = dict(node_id="n", node_execution_id="e")
    p = journal([event(1, "node.running", **x), event(2, "node.completed", **x), event(3, "node.skipped", node_id="n", node_instance_key="n@l:1"), event(4, "node.skipped", node_id="never_run", node_instance_key="k")])
    got = {r.node_id: r for r in P.project_nodes(p).collect()}
    assert (got["n"].state, got["n"].latest_occurrence_state, got["n"].execution_count, got["n"].skipped_count) == ("completed", "skipped", 1, 1)
    assert got["never_run"].state == "skipped" and got["never_run"].latest_execution_id is None


def test_edges_keep_lifetime_counts(journal):
    p = journal([event(1, "edge.evaluated", edge_id="e", selected=True, state="selected"), event(2, "edge.evaluated", edge_id="e", selected=False, state="skipped"), event(3, "edge.evaluated", edge_id="f")])
    got = {r.edge_id: r for r in P.project_edges(p).collect()}
    assert (got["e"].state, got["e"].latest_state, got["e"].selected_count, got["e"].skipped_count, got["e"].selected) == ("selected", "skipped", 1, 1, True)
    assert got["f"].state == "evaluated" and got["f"].latest_selected is False


def test_calls_before_their_execution_count_for_nothing_but_states(journal):
    p = journal([event(1, "operator_call.completed", operator_call_id="c", node_execution_id="e", state="failed"), event(2, "node.running", node_id="n", node_execution_id="e")])
    assert P.operator_rollup(p).count() == 0 and P.operator_states(p).first().state == "failed"


def test_waits_and_states(journal):
    p = journal([event(1, "wait.created", waits=[{"wait_key": "a", "wait_type": "human"}]), event(2, "wait.created", wait_keys=["b", "c"]), event(3, "wait.resumed", wait_key="b")])
    assert sorted(r.wait_key for r in P.active_waits(p).collect()) == ["a", "c"] and P.invocation_states(p).first().state == "waiting"
    p = journal([event(1, "invocation.running"), event(2, "recovery.interrupted", kind="recovery"), event(3, "node.created", node_id="n", kind="recovery")])
    assert P.invocation_states(p).first().state == "interrupted"


def test_gaps_name_what_was_expected(spark):
    rows = spark.createDataFrame([("a", s) for s in (1, 2, 4, 7)] + [("b", 1), ("b", 2), ("c", 2)], "invocation_id string, sequence long")
    assert {tuple(r) for r in P.journal_gaps(rows).collect()} == {("a", 3, 4), ("c", 1, 2)}
    assert {tuple(r) for r in P.journal_gaps(rows, 4).collect()} == {("a", 5, 7)}


def fold(events):
    """The projection rules, one event after another."""
    ex, nodes, edges, state = {}, {}, {}, "created"
    counters = lambda: dict(calls=0, failed=0, retry=0, fallback=0, timeout=0)
    for e in sorted(events, key=lambda e: e["sequence"]):
        p, name = json.loads(e["payload_json"]), e["event_name"]
        if name.startswith("invocation."):
            state = e["status"]
        elif name.startswith("node."):
            key = p.get("node_execution_id")
            if key:
                old = ex.get(key) or dict(node=p["node_id"], n=1 + sum(x["node"] == p["node_id"] for x in ex.values()), first=e["sequence"], started=None, **counters())
                ex[key] = old | dict(state=e["status"], error=(p.get("error") or {}).get("code"), started=e["occurred_at_ms"] if e["status"] == "running" else old["started"], ended=e["occurred_at_ms"] if e["status"] in ("completed", "failed") else None)
            own = [(x["n"], k) for k, x in ex.items() if x["node"] == p["node_id"]]
            top = max(own)[1] if own else None
            nodes[p["node_id"]] = dict(state=ex[top]["state"] if top else e["status"], occurrence=e["status"], count=len(own), skipped=nodes.get(p["node_id"], {}).get("skipped", 0) + (name == "node.skipped"), **{k: ex[top][k] if top else 0 for k in counters()})
        elif name == "edge.evaluated":
            old = edges.setdefault(p["edge_id"], [0, 0, 0])
            edges[p["edge_id"]] = [old[0] + 1, old[1] + bool(p.get("selected")), old[2] + (p.get("state") == "skipped")]
        elif name == "operator_call.completed" and p["node_execution_id"] in ex:
            x = ex[p["node_execution_id"]]
            x["calls"] += 1
            x["failed"] += p["state"] != "completed"
            x["retry"] += p["reason"] == "retry"
            x["fallback"] += p["reason"] == "fallback"
            x["timeout"] += (p.get("error") or {}).get("code") == "OPERATOR_TIMEOUT"
            nodes[x["node"]] |= {k: x[k] for k in counters()}
        elif name == "wait.created":
            state = "waiting"
    return ex, nodes, edges, state


@pytest.mark.parametrize("seed", range(3))
def test_random_journals_equal_a_plain_fold(spark, journal, seed):
    rng = random.Random(seed)
    rows = []
    for inv in range(12):
        for s in range(1, rng.randint(2, 40)):
            n = f"n{rng.randrange(3)}"
            x = f"{n}x{rng.randrange(3)}"
            kind = rng.choice(["node.running", "node.completed", "node.failed", "node.skipped", "edge.evaluated", "operator_call.completed", "operator_call.completed", "wait.created", "invocation.running"])
            more = {"node.skipped": dict(node_id=n), "edge.evaluated": dict(edge_id=f"e{rng.randrange(2)}", selected=rng.random() < 0.5, state=rng.choice(["selected", "skipped"])), "operator_call.completed": dict(operator_call_id=f"c{s}", node_execution_id=x, state=rng.choice(["completed", "failed"]), reason=rng.choice(["normal", "retry", "fallback"]), error=rng.choice([None, {"code": "OPERATOR_TIMEOUT"}])), "wait.created": dict(wait_keys=["w"]), "invocation.running": {}}.get(kind)
            if more is None:
                more = dict(node_id=n, node_execution_id=x, error={"code": "E"} if kind == "node.failed" else None)
            rows.append(event(s, kind, at=rng.randrange(1000), inv=f"i{inv}", **more))
    shuffled = rows + rng.sample(rows, len(rows) // 3)  # any order, with repeats
    rng.shuffle(shuffled)
    p = journal(shuffled)
    ex = {(r.invocation_id, r.execution_id): (r.node_id, r.ordinal, r.first_event_sequence, r.state, json.loads(r.error)["code"] if r.error else None, r.started_at_ms, r.ended_at_ms) for r in P.project_node_executions(p).collect()}
    nodes = {(r.invocation_id, r.node_id): (r.state, r.latest_occurrence_state, r.execution_count, r.skipped_count, r.operator_call_count, r.failed_operator_call_count, r.retry_count, r.fallback_count, r.timeout_count) for r in P.project_nodes(p).collect()}
    edges = {(r.invocation_id, r.edge_id): [r.evaluation_count, r.selected_count, r.skipped_count] for r in P.project_edges(p).collect()}
    states = {r.invocation_id: r.state for r in P.invocation_states(p).collect()}
    for inv in {r["invocation_id"] for r in rows}:
        a, b, c, d = fold([r for r in rows if r["invocation_id"] == inv])
        assert {k[1]: v for k, v in ex.items() if k[0] == inv} == {k: (v["node"], v["n"], v["first"], v["state"], v["error"], v["started"], v["ended"]) for k, v in a.items()}
        assert {k[1]: v for k, v in nodes.items() if k[0] == inv} == {k: (v["state"], v["occurrence"], v["count"], v["skipped"], v["calls"], v["failed"], v["retry"], v["fallback"], v["timeout"]) for k, v in b.items()}
        assert {k[1]: v for k, v in edges.items() if k[0] == inv} == c and states[inv] == d


def test_one_exchange_by_invocation(journal):
    """The groupings of the projection reuse the partitioning of the prepared events."""
    p = journal([event(1, "node.running", node_id="n", node_execution_id="e")])
    for df in (P.project_node_executions(p), P.operator_rollup(p), P.project_edges(p), P.invocation_states(p), P.active_waits(p)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 1 + plan.count("Union"), plan


def test_pages_and_status_merge(spark):
    i = spark.createDataFrame([("a", 30), ("b", 3)], "id string, durable_sequence long")
    e = spark.createDataFrame([("a", s) for s in range(1, 31)] + [("b", s) for s in (1, 2, 3)], "invocation_id string, sequence long")
    last = pages.event_page(e, i, before=21, limit=5).filter("invocation_id = 'a'").orderBy("sequence").collect()
    assert [r.sequence for r in last] == [16, 17, 18, 19, 20] and last[0].has_earlier and last[0].has_later
    first = pages.event_page(e, i, limit=5).filter("invocation_id = 'b'").first()
    assert not first.has_earlier and not first.has_later
    d = spark.createDataFrame([("a", "completed", 5), ("b", "running", 5), ("c", "running", 9)], "id string, state string, updated_at_ms long")
    v = spark.createDataFrame([("a", "running", 5), ("b", "completed", 5), ("c", "failed", 8), ("d", "created", 1)], "id string, state string, updated_at_ms long")
    assert {r.id: r.state for r in pages.overlay(d, v).collect()} == {"a": "completed", "b": "completed", "c": "running", "d": "created"}


def test_cursors(spark):
    rows = [(1, "x"), (1700000000000, 'q"é'), (0, "y?>~")]
    df = spark.createDataFrame(rows, "t long, i string").select("*", pages.encode_cursor(F.col("t"), F.col("i")).alias("c")).withColumn("d", pages.decode_cursor(F.col("c")))
    assert all((r.d.timestamp, r.d.id) == (r.t, r.i) and not set(r.c) & set("+/=") for r in df.collect())
    bad = spark.createDataFrame([("",), ("???",), ("eyJ0aW1lc3RhbXAiOi0xLCJpZCI6ImEifQ",), ("e30",), (None,), ("YQ",)], "c string")
    assert all(r.d is None for r in bad.select(pages.decode_cursor(F.col("c")).alias("d")).collect())
