"""Queries of workflow operators and state trees, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S
from ..operators import workflow as L
from ..sources.adapters import JOURNAL_SQL, invocations, numbered_events, runtime_events, table
from .registry import query

WITH = f"WITH {JOURNAL_SQL}"
K = "CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))


def routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("k")
    return L.route(events(spark, sf_dir).drop("event_type"), {"always": None, "even": k % 2 == 0, "third": F.when(k % 11 != 0, k % 3 == 0)})


@query(f"WITH e AS (SELECT event_id, {K} AS k FROM events) SELECT event_id, k, 'always' AS edge_id FROM e WHERE k%11<>0 UNION ALL SELECT event_id, k, 'even' FROM e WHERE k%11<>0 AND k%2=0 UNION ALL SELECT event_id, k, 'third' FROM e WHERE k%11<>0 AND k%3=0")
def l1_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir)[0]


@query(f"WITH e AS (SELECT event_id, {K} AS k FROM events) SELECT event_id, k, 'always' AS edge_id, 'selected' AS state FROM e UNION ALL SELECT event_id, k, 'even', CASE WHEN k%2=0 THEN 'selected' ELSE 'skipped' END FROM e UNION ALL SELECT event_id, k, 'third', CASE WHEN k%11=0 THEN 'failed' WHEN k%3=0 THEN 'selected' ELSE 'skipped' END FROM e")
def l1_route_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir)[1]


@query(f"WITH e AS (SELECT event_id, {K} AS k FROM events) SELECT event_id, CASE WHEN k%2=0 AND k%3=0 THEN '{{\"b0\":' || k || ',\"b1\":' || k*10 || '}}' WHEN k%2=0 THEN CAST(k AS VARCHAR) WHEN k%3=0 THEN CAST(k*10 AS VARCHAR) ELSE '\"in\"' END AS value FROM e".replace("{{", "{").replace("}}", "}"))
def l2_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    a = e.filter("k % 2 = 0").select("event_id", F.lit("b0").alias("source"), F.col("k").cast("string").alias("value"))
    b = e.filter("k % 3 = 0").select("event_id", F.lit("b1").alias("source"), (F.col("k") * 10).cast("string").alias("value"))
    return L.fan_in(a.union(b), e.select("event_id", F.lit('"in"').alias("value")), "event_id")


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    items = F.when(k % 5 == 0, '{"a":1}').when(k % 5 == 1, "7").when(k % 5 == 2, '[{"x":1},2]').otherwise(F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), k % 4 + 1), lambda i: F.concat(F.lit('{"x":'), (i * k).cast("string"), F.lit("}"))), ","), F.lit("]")))
    return events(spark, sf_dir).select("event_id", items.alias("items"))


@query(f"WITH e AS (SELECT event_id, {K} AS k FROM events WHERE {K}%5 > 2) SELECT event_id, CAST(i AS INTEGER) AS item_index, '{{\"x\":' || (i+1)*k || '}}' AS item, event_id || ':' || i AS idempotency_key FROM (SELECT *, unnest(range(k%4+1)) AS i FROM e)".replace("{{", "{").replace("}}", "}"))
def l3_map_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.map_items(item_rows(spark, sf_dir), "event_id", "items", mappings=True)[0].drop("items")


@query(f"SELECT event_id, CASE WHEN {K}%5=2 THEN 'item_not_mapping' ELSE 'not_iterable' END AS error FROM events WHERE {K}%5 <= 2")
def l3_map_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.map_items(item_rows(spark, sf_dir), "event_id", "items", mappings=True)[1]


@query("WITH t AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i, l_partkey AS p FROM lineitem) SELECT o AS order_key, CASE WHEN bool_or(p%17=0) THEN NULL ELSE string_agg(CAST(p AS VARCHAR), ',' ORDER BY i) END AS output, CASE WHEN bool_or(p%17=0) THEN 'E' || min(i) FILTER (p%17=0) END AS error FROM t GROUP BY 1")
def l4_map_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    li, p = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    items = li.select(F.col("l_orderkey").alias("order_key"), i.alias("item_index"), p.cast("string").alias("output"), p.alias("p")).withColumn("error", F.when(F.col("p") % 17 == 0, F.concat(F.lit("E"), F.col("item_index").cast("string"))))
    return L.map_aggregate(items, "order_key", lambda o: F.array_join(o, ","))


@query(f"WITH e AS (SELECT event_id, {K} AS k, unnest(range(3)) AS i FROM events) SELECT event_id, max(k*(i+1)%7) AS choice FROM e GROUP BY 1")
def l5_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.replicate(events(spark, sf_dir), 3)
    return r.groupBy("event_id").agg(F.max(F.col("k") * (F.col("item_index") + 1) % 7).alias("choice"))


def _mapped(x: str) -> str:
    if int(x) % 11 == 5:
        raise ValueError("bad mapping")
    return x


def _first(x: str) -> str:
    if int(x) % 3 == 0:
        raise RuntimeError("busy")
    if int(x) % 7 == 0:
        raise ValueError("bad input")
    return f"a{x}"


def _second(x: str) -> str:
    if int(x) % 2 == 0:
        raise RuntimeError("down")
    return f"b{x}"


@query(f"""WITH e AS (SELECT event_id, {K} AS k FROM events), f AS (SELECT *, k%3=0 OR k%7=0 AS again, k%11=5 AS unmapped FROM e)
SELECT event_id, CASE WHEN unmapped THEN NULL WHEN NOT again THEN 'a' || k WHEN k%2<>0 THEN 'b' || k END AS output, CASE WHEN unmapped THEN 'bad mapping' WHEN again AND k%2=0 THEN 'down' END AS error,
CASE WHEN unmapped THEN '' WHEN NOT again THEN 'normal' WHEN k%2=0 THEN 'normal,retry,fallback,retry' ELSE 'normal,retry,fallback' END AS reasons FROM f""")
def l6_call_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", F.col("k").cast("string").alias("x"))
    out = L.call_with_retry(e, "x", [_first, _second], 2, mapping=_mapped)
    return out.select("event_id", "output", "error", F.array_join(F.transform("attempts", lambda a: a["reason"]), ",").alias("reasons"))


@query(f"WITH e AS (SELECT event_id, {K} AS k FROM events), r AS (SELECT *, greatest(1, CAST((100 - k + 29) // 30 AS BIGINT)) AS n FROM e) SELECT event_id, k + 30*least(n, 3) AS k, CAST(least(n, 3) AS INTEGER) AS rounds, CASE WHEN n > 3 THEN 'LOOP_LIMIT' END AS error FROM r")
def l7_bounded_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bounded_loop(events(spark, sf_dir).drop("event_type"), lambda d: d.withColumn("k", F.col("k") + 30), F.col("k") >= 100, 3)


@query(f"WITH e AS (SELECT event_id, {K} AS k FROM events) SELECT event_id, CASE k%5 WHEN 0 THEN '' WHEN 1 THEN 'type:a' WHEN 2 THEN 'missing:a;extra:z' WHEN 3 THEN 'not_an_object' ELSE 'type:b' END AS problems FROM e")
def l8_validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 5
    v = F.when(k == 0, '{"a":1,"b":"x"}').when(k == 1, '{"a":"1"}').when(k == 2, '{"b":"x","z":[]}').when(k == 3, "[1]").otherwise('{"a":2,"b":null}')
    out = L.validate_rows(events(spark, sf_dir).select("event_id", v.alias("v")), "v", {"a": ("integer", True), "b": ("string", False)})
    return out.select("event_id", F.array_join("problems", ";").alias("problems"))


@query(f"WITH e AS (SELECT event_id, {K} AS k FROM events), u AS (SELECT event_id, 0 AS o, 'started' AS type, '{{\"k\":' || k || '}}' AS data FROM e WHERE k%2=0 UNION ALL SELECT event_id, 1, CASE WHEN k%5=0 THEN 'user_event_mapping_failed' ELSE 'measured' END, CASE WHEN k%5=0 THEN '{{\"type\":\"measured\"}}' ELSE 'm' || k END FROM e UNION ALL SELECT event_id, 2, 'ended', 'x' FROM e WHERE k%3=0) SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS BIGINT) AS position, type, data FROM u".replace("{{", "{").replace("}}", "}"))
def l9_emit_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, no = F.col("k"), F.lit(False)
    return L.emit_user_events(events(spark, sf_dir), "event_id", [("started", F.when(k % 2 == 0, F.to_json(F.struct(k.alias("k")))), no), ("measured", F.concat(F.lit("m"), k.cast("string")), k % 5 == 0), ("ended", F.when(k % 3 == 0, "x"), no)])


def edit_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-mode events: each node event replaces its node's value, all others change nothing."""
    return runtime_events(spark, sf_dir).withColumn("operations_json", F.coalesce("operations_json", F.lit("[]")))


@query(f"""{WITH}, n AS (SELECT invocation_id, node, arg_max(k, sequence) AS v FROM ev WHERE event_name LIKE 'node.%' GROUP BY 1, 2),
g AS (SELECT invocation_id, string_agg('"' || node || '":' || v, ',' ORDER BY node) AS s FROM n GROUP BY 1) SELECT iv.id AS invocation_id, durable_sequence AS target_sequence, '{{"nodes":{{' || COALESCE(s, '') || '}}}}' AS state_json, CAST(NULL AS VARCHAR) AS error FROM iv LEFT JOIN g ON g.invocation_id = iv.id""")
def i1_replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of each invocation, from snapshots at each eighth of them."""
    i, e = invocations(spark, sf_dir), edit_journal(spark, sf_dir)
    genesis = i.select(F.col("id").alias("invocation_id"), F.lit(0).cast("long").alias("event_sequence"), F.lit('{"nodes":{}}').alias("state_json"))
    eighths = e.filter("sequence % 8 = 0").select("invocation_id", F.col("sequence").alias("target_sequence"))
    made = S.replay_state(genesis, e, eighths).select("invocation_id", F.col("target_sequence").alias("event_sequence"), "state_json")
    return S.replay_state(S.snapshots_with_genesis(genesis, made), e, i.select(F.col("id").alias("invocation_id"), F.col("durable_sequence").alias("target_sequence")))


@query("""WITH d AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderstatus AS s FROM orders) SELECT id, CASE WHEN c%3=0 THEN '[{"op":"remove","path":["b"],"value":null},' ELSE '[' END || '{"op":"add","path":["n"],"value":' || c || '},{"op":"add","path":["l",2],"value":"' || s || '"}]' AS edits, CASE WHEN c%3=0 THEN '/b,/l,/n' ELSE '/l,/n' END AS changed FROM d""")
def i2_diff_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2, H10"""
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string")
    before = F.lit('{"b":1,"l":[1,2],"m":{"x":1}}')
    after = F.concat(F.lit('{"l":[1,2,"'), F.col("o_orderstatus"), F.lit('"],"m":{"x":1},"n":'), c, F.when(F.col("o_custkey") % 3 != 0, ',"b":1').otherwise(""), F.lit("}"))
    return o.select(F.col("o_orderkey").alias("id"), S.diff_states(before, after).alias("edits"), F.array_join(S.changed_paths(before, after), ",").alias("changed"))


@query(f"{WITH} SELECT invocation_id, 'nodes/' || node AS path, 'replace' AS op, CAST(arg_max(k, sequence) AS VARCHAR) AS value FROM ev WHERE event_name LIKE 'node.%' GROUP BY 1, 2")
def i3_leaf_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leaf_state(runtime_events(spark, sf_dir))


@query("SELECT o_orderkey AS id, '{\"executions\":[{\"id\":\"x' || o_custkey || '\",\"operator_calls\":[{\"id\":\"c\"}]}]}' AS state FROM orders")
def i4_compact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.concat(F.lit('{"executions":[{"id":"x'), F.col("o_custkey").cast("string"), F.lit('","input":"{}","operator_calls":[{"id":"c","input":"i","output":"o"}]}]}'))
    schema = "executions array<struct<id string, input string, operator_calls array<struct<id string, input string, output string>>>>"
    return o.select(F.col("o_orderkey").alias("id"), S.compact_state(state, schema).alias("state"))


@query(f"""{WITH}, w AS (SELECT 'c' || user_id%40 AS c, event_id AS id, event_id - 1 - k%60 AS b, event_id AS r, 'd' || k%97 AS p, k FROM ev WHERE event_type = 'state_change'), x AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.c = w.c AND o.p = w.p AND o.r > w.b AND o.r < w.r)),
l AS (SELECT c, p, arg_max(k, r) AS v, count(*) AS n FROM x GROUP BY 1, 2) SELECT c AS context_id, '{{' || string_agg('"' || p || '":' || v, ',' ORDER BY p) || '}}' AS data_json, CAST(sum(n) AS BIGINT) AS revision FROM l GROUP BY 1""")
def i5_merge_context_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = numbered_events(spark, sf_dir).filter("event_name LIKE 'node.%' OR event_name LIKE 'invocation.%'"), F.col("k")
    w = e.select(F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("context_id"), F.col("event_id").alias("write_id"), (F.col("event_id") - 1 - k % 60).alias("base_revision"), F.col("event_id").alias("revision"), F.concat(F.lit("d"), (k % 97).cast("string")).alias("path"), k.cast("string").alias("value"))
    contexts = w.select("context_id").distinct().select("context_id", F.lit("{}").alias("data_json"), F.lit(0).cast("long").alias("revision"))
    return S.merge_context_writes(contexts, w).drop("rejected")


@query("""WITH d AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders) SELECT id, CASE WHEN c%5=0 THEN '{"a":{"$missing":"none"},"b":1}' WHEN c%2=0 THEN '{"a":{"n":' || c%100 || ',"in":[' || c%100 || ']}}' ELSE '{"a":2}' END AS v, CASE WHEN c%5=0 THEN 'none' ELSE '' END AS missing FROM d""")
def c8_hydrate_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    m = (c % 100).cast("string")
    v = F.when(c % 5 == 0, '{"a":{"$artifact":"none"},"b":1}').when(c % 2 == 0, F.concat(F.lit('{"a":{"$artifact":"o'), m, F.lit('"}}'))).otherwise('{"a":2}')
    n = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).cast("string").alias("n")).distinct()
    outer = n.select(F.concat(F.lit("o"), "n").alias("id"), F.concat(F.lit('{"n":'), "n", F.lit(',"in":{"$artifact":"i'), "n", F.lit('"}}')).alias("payload"))
    inner = n.select(F.concat(F.lit("i"), "n").alias("id"), F.concat(F.lit("["), "n", F.lit("]")).alias("payload"))
    out = S.hydrate_artifacts(o.select(F.col("o_orderkey").alias("id"), v.alias("v")), "id", "v", outer.union(inner))
    return out.withColumn("missing", F.array_join("missing", ",")).drop("cyclic")


@query("SELECT p_partkey AS id, '{\"a\":[1,\"' || p_partkey || '\"],\"k\":{\"$artifact\":{\"id\":' || p_size || '}},\"t\":\"x\"}' AS view, CAST(NULL AS VARCHAR) AS error FROM part WHERE p_size%2=0 UNION ALL SELECT p_partkey, NULL, 'unknown tag odd' FROM part WHERE p_size%2<>0")
def h8_json_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i, s = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    good = F.concat(F.lit('{"t":{"$type":"uuid","value":"x"},"a":{"$type":"tuple","value":[1,{"$type":"decimal","value":"'), i, F.lit('"}]},"k":{"$type":"mapping","value":{"$type":"artifact","value":{"id":'), s, F.lit("}}}}"))
    v = F.when(F.col("p_size") % 2 == 0, good).otherwise('{"$type":"odd"}')
    return p.select(F.col("p_partkey").alias("id"), S.json_view(v).alias("v")).select("id", "v.*")


@query("SELECT p_partkey AS id, CAST(128 + 65 + 32 + 65 + 96 + 64 + strlen(p_name) + 32 AS BIGINT) AS queue_bytes, CAST(2 + 3 + 2 + 32 + 3 + 2 + 2 + (length(p_name) + 2) + 1 + 33 AS BIGINT) AS inline_bytes FROM part")
def h9_estimated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = F.concat(F.lit('{"a":'), F.col("p_size").cast("string"), F.lit(',"b":["'), F.col("p_name"), F.lit('",null]}'))
    return p.select(F.col("p_partkey").alias("id"), S.estimated_sizes(v).alias("v")).select("id", "v.*")


@query("SELECT p_partkey AS id, '{\"a\":[1,\"\\u00e9\"],\"b\":' || p_size || '}' AS canonical FROM part")
def h7_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = F.concat(F.lit('{"b" : '), F.col("p_size").cast("string"), F.lit(', "a": [1, "é"]}'))
    return p.select(F.col("p_partkey").alias("id"), S.canonical_json(v).alias("canonical"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each document: a text, a list and a small value, the first two at times large (SQL: `tr`)."""
    n, m = F.col("n_chars") % 20000, F.col("doc_id") % 5000
    big = F.concat(F.lit('{"big":"'), F.repeat(F.lit("x"), n.cast("int")), F.lit('","in":{"list":['), F.repeat(F.lit("7,"), m.cast("int")), F.lit('7]},"s":'), F.col("doc_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("owner"), big.alias("v"))


TREES_SQL = """tr AS (SELECT doc_id, COALESCE(source, 'none') AS owner, '"' || repeat('x', n_chars%20000) || '"' AS big, '[' || repeat('7,', doc_id%5000) || '7]' AS list FROM documents),
ts AS (SELECT *, CASE WHEN strlen(big) > 8192 THEN sha256(big) END AS big_sha, CASE WHEN strlen(list) > 8192 THEN sha256(list) END AS list_sha FROM tr),
tb AS (SELECT *, CASE WHEN big_sha IS NULL THEN big ELSE '{"$artifact":"' || big_sha || '"}' END AS b, '{"list":' || CASE WHEN list_sha IS NULL THEN list ELSE '{"$artifact":"' || list_sha || '"}' END || '}' AS l0 FROM ts),
ti AS (SELECT *, CASE WHEN strlen(l0) > 8192 THEN sha256(l0) END AS in_sha, CASE WHEN strlen(l0) > 8192 THEN '{"$artifact":"' || sha256(l0) || '"}' ELSE l0 END AS i FROM tb),
t0 AS (SELECT *, '{"big":' || b || ',"in":' || i || ',"s":' || doc_id || '}' AS v0 FROM ti),
tv AS (SELECT *, CASE WHEN strlen(v0) > 8192 THEN sha256(v0) END AS sha, CASE WHEN strlen(v0) > 8192 THEN '{"$artifact":"' || sha256(v0) || '"}' ELSE v0 END AS v FROM t0)"""


@query(f"WITH {TREES_SQL} SELECT doc_id, owner, v FROM tv")
def i6_externalize_tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.externalize_trees(trees(spark, sf_dir), "owner", "v")[0]


@query(f"""WITH {TREES_SQL}, a AS (SELECT owner, big_sha AS sha256, big AS p FROM tv UNION ALL SELECT owner, list_sha, list FROM tv UNION ALL SELECT owner, in_sha, l0 FROM tv UNION ALL SELECT owner, sha, v0 FROM tv)
SELECT owner, sha256, CAST(max(strlen(p)) AS BIGINT) AS size_bytes, count(*) AS uses FROM a WHERE sha256 IS NOT NULL GROUP BY 1, 2""")
def i6_externalize_tree_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.externalize_trees(trees(spark, sf_dir), "owner", "v")[1].drop("payload")


@query("SELECT doc_id, strlen(repeat('x', n_chars%20000)) + 2 * (doc_id%5000) + 33 + strlen(CAST(doc_id AS VARCHAR)) AS n, 0 AS missing FROM documents")
def i6_externalize_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees' parts taken out and put back (C8): their lengths, as before."""
    rows, parts = S.externalize_trees(trees(spark, sf_dir), "owner", "v")
    back = S.hydrate_artifacts(rows, "doc_id", "v", parts.select(F.col("sha256").alias("id"), "payload"))
    return back.select("doc_id", F.length("v").cast("long").alias("n"), F.size("missing").alias("missing"))


@query(f"""{WITH}, b AS (SELECT invocation_id, max(sequence) FILTER (event_name IN ('wait.created', 'invocation.running', 'node.completed', 'node.failed', 'node.skipped')) AS p, max(sequence) AS l FROM ev GROUP BY 1),
r AS (SELECT b.*, CASE WHEN durable_sequence%2=0 THEN durable_sequence//2 ELSE 0 END AS base FROM b JOIN iv ON iv.id = invocation_id),
m AS (SELECT invocation_id, base, CASE WHEN p > base THEN p WHEN l - base >= 4 THEN l END AS upto, CASE WHEN p > base THEN 'recovery_point' ELSE 'interval' END AS reason FROM r),
n AS (SELECT ev.invocation_id, node, arg_max(k, sequence) AS v FROM ev JOIN m ON m.invocation_id = ev.invocation_id AND sequence <= upto WHERE event_name LIKE 'node.%' GROUP BY 1, 2),
g AS (SELECT invocation_id, string_agg('"' || node || '":' || v, ',' ORDER BY node) AS s FROM n GROUP BY 1)
SELECT m.invocation_id, upto AS event_sequence, '{{"nodes":{{' || COALESCE(s, '') || '}}}}' AS state_json, base AS from_sequence, reason, CAST(NULL AS VARCHAR) AS error FROM m LEFT JOIN g ON g.invocation_id = m.invocation_id WHERE upto IS NOT NULL""")
def i7_checkpoint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the invocations have a checkpoint in their middle; the batch is all events after it and some before."""
    i, e = invocations(spark, sf_dir), edit_journal(spark, sf_dir)
    genesis = i.select(F.col("id").alias("invocation_id"), F.lit('{"nodes":{}}').alias("state_json"))
    middle = i.filter("durable_sequence % 2 = 0").select(F.col("id").alias("invocation_id"), F.expr("durable_sequence div 2").alias("target_sequence"))
    stored = S.replay_state(genesis.withColumn("event_sequence", F.lit(0).cast("long")), e, middle).select("invocation_id", F.col("target_sequence").alias("event_sequence"), "state_json")
    return S.checkpoint_states(genesis, stored, e, 4)
