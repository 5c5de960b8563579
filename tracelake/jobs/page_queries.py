"""Queries of pages, directories, set operations and ingest, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import pages as G
from ..operators import projection as P
from ..sources.adapters import CUSTOMER_VERSIONS_SQL, JOURNAL_SQL, customer_versions, invocations, numbered_events, runtime_events, sessions, workflow_versions
from ..schemas import TABLES
from ..sources.journal import load_journal, write_events
from ..sources.scratch import shared_folder
from .projection_queries import EXEC_SQL, prepared
from .registry import query

WITH = f"WITH {JOURNAL_SQL}"


def event_number(df: DataFrame) -> DataFrame:
    return df.withColumn("_e", F.substring("id", 2, 20).cast("long"))


def repeated_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(journal, batch): every 7th event is new; of the batch every 53rd repeats a stored event, every 59th conflicts."""
    e = event_number(runtime_events(spark, sf_dir))
    journal = e.filter("_e % 7 <> 0").drop("_e")
    n = F.col("_e")
    batch = e.filter("_e % 7 = 0 OR _e % 53 = 0 OR _e % 59 = 0")
    return journal, batch.withColumn("elapsed_ns", F.when((n % 59 == 0) & (n % 7 != 0), F.col("elapsed_ns") + 1).otherwise(F.col("elapsed_ns"))).drop("_e")


SLIM = "invocation_id, sequence, event_name, elapsed_ns"


@query(f"{WITH} SELECT {SLIM} FROM ev WHERE event_id % 7 = 0")
def a4_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.append(*repeated_batch(spark, sf_dir))[0].select(*SLIM.split(", "))


@query(f"{WITH} SELECT {SLIM} FROM ev WHERE event_id % 7 <> 0 AND event_id % 53 = 0 AND event_id % 59 <> 0")
def a4_append_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.append(*repeated_batch(spark, sf_dir))[1].select(*SLIM.split(", "))


@query(f"{WITH} SELECT invocation_id, sequence, event_name, elapsed_ns + 1 AS elapsed_ns FROM ev WHERE event_id % 7 <> 0 AND event_id % 59 = 0")
def a4_append_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.append(*repeated_batch(spark, sf_dir))[2].select(*SLIM.split(", "))


@query(f"""WITH {CUSTOMER_VERSIONS_SQL}, inc AS (SELECT id || 'x' AS id, workflow_id, definition_hash, created_at_ms + 7 AS created_at_ms, 'v2' AS ver FROM cv WHERE n%3 <> 0 UNION ALL SELECT id || 'n', workflow_id, 'n' || definition_hash, created_at_ms + 9, 'v2' FROM cv WHERE n%5 = 0)
SELECT COALESCE(cv.id, inc.id) AS id, COALESCE(cv.workflow_id, inc.workflow_id) AS workflow_id, COALESCE(cv.definition_hash, inc.definition_hash) AS definition_hash, COALESCE(ver, '1') AS workflow_version, COALESCE(cv.created_at_ms, inc.created_at_ms) AS created_at_ms
FROM cv FULL JOIN inc ON cv.workflow_id = inc.workflow_id AND cv.definition_hash = inc.definition_hash""")
def a2_upsert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = customer_versions(spark, sf_dir)
    later = lambda rows, mark, ms: rows.withColumns({"id": F.concat("id", F.lit(mark)), "created_at_ms": F.col("created_at_ms") + ms, "workflow_version": F.lit("v2")}).drop("n")
    newer = later(v.filter("n % 3 <> 0"), "x", 7)
    extra = later(v.filter("n % 5 = 0").withColumn("definition_hash", F.concat(F.lit("n"), "definition_hash")), "n", 9)
    return I.upsert_versions(v.drop("n"), newer.union(extra)).select("id", "workflow_id", "definition_hash", "workflow_version", "created_at_ms")


def admitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, i = sessions(spark, sf_dir), invocations(spark, sf_dir)
    old = F.col("created_at_ms") % 3 != 0
    return I.admit(s, i.filter(old), s.filter(F.col("id").cast("long") % 2 == 0).withColumn("updated_at_ms", F.col("updated_at_ms") + 1), i.withColumn("state", F.lit("created")))


@query(f"{WITH} SELECT id, CASE WHEN created_at_ms % 3 <> 0 THEN state ELSE 'created' END AS state, event_mode, event_mode = 'full' AS has_genesis FROM iv")
def a3_admit_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir)[1].select("id", "state", "event_mode", F.col("genesis_state_json").isNotNull().alias("has_genesis"))


@query(f"{WITH} SELECT id, CAST(updated_at_ms + CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS updated_at_ms FROM se")
def a3_admit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir)[0].select("id", "updated_at_ms")


@query(f"{WITH} SELECT id AS invocation_id, CAST(0 AS BIGINT) AS event_sequence, '{{}}' AS state_json FROM iv WHERE created_at_ms % 3 = 0 AND event_mode <> 'minimal'")
def a3_admit_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir)[2].select("invocation_id", "event_sequence", "state_json")


@query("WITH a AS (SELECT sha256(text) AS id, strlen(text) AS n FROM documents), s AS (SELECT DISTINCT id FROM a WHERE n % 3 = 0) SELECT DISTINCT id, CAST(n AS BIGINT) AS size_bytes FROM a WHERE id NOT IN (SELECT id FROM s)")
def a6_append_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = docs.select(F.sha2("text", 256).alias("id"), F.octet_length("text").cast("long").alias("size_bytes"))
    return I.append_artifacts(a.filter("size_bytes % 3 = 0").distinct(), a)


@query(f"""{WITH}, b AS (SELECT invocation_id, max(sequence) AS s, arg_max(CASE WHEN event_name LIKE 'invocation.%' THEN status END, sequence) FILTER (event_name LIKE 'invocation.%') AS st, arg_max(ms, sequence) AS t FROM ev WHERE event_id % 3 = 0 GROUP BY 1)
SELECT iv.id, COALESCE(st, state) AS state, greatest(durable_sequence - 3, s) AS durable_sequence, COALESCE(t, updated_at_ms) AS updated_at_ms FROM iv LEFT JOIN b ON iv.id = invocation_id""")
def a7_fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_number(runtime_events(spark, sf_dir)).filter("_e % 3 = 0").withColumn("state", F.when(F.col("event_name").startswith("invocation."), F.col("status")))
    old = invocations(spark, sf_dir).withColumn("durable_sequence", F.col("durable_sequence") - 3)
    return I.fold_events(old, e).select("id", "state", "durable_sequence", "updated_at_ms")


@query(f"{WITH} SELECT id, greatest(updated_at_ms - 10, (SELECT max(updated_at_ms) FROM iv WHERE session_id = se.id)) AS updated_at_ms FROM se")
def a7_fold_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).withColumn("updated_at_ms", F.col("updated_at_ms") - 10)
    return I.fold_sessions(s, invocations(spark, sf_dir)).select("id", "updated_at_ms")


def state_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).filter("k % 4 = 0")
    null = F.lit(None).cast("string")
    return e.select(F.when(F.col("k") % 20 == 0, F.concat(F.col("invocation_id"), F.lit("?"))).otherwise(F.col("invocation_id")).alias("id"), "sequence", F.concat(F.lit("s"), (F.col("k") % 5).cast("string")).alias("state"), null.alias("input_json"), F.col("props").alias("result_json"), null.alias("error_json"), F.col("ms").alias("updated_at_ms"))


BATCH_SQL = "b AS (SELECT CASE WHEN k%20=0 THEN invocation_id || '?' ELSE invocation_id END AS id, arg_max(struct_pack(s := 's' || k%5, m := ms), sequence) AS l FROM ev WHERE k%4=0 GROUP BY 1)"


@query(f"{WITH}, {BATCH_SQL} SELECT iv.id, COALESCE(l.s, state) AS state, COALESCE(l.m, updated_at_ms) AS updated_at_ms FROM iv LEFT JOIN b USING (id)")
def a8_apply_invocation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.apply_invocation_states(invocations(spark, sf_dir), state_batch(spark, sf_dir))[0].select("id", "state", "updated_at_ms")


@query(f"{WITH}, {BATCH_SQL} SELECT id, 'invocation_not_admitted' AS error FROM b WHERE id NOT IN (SELECT id FROM iv)")
def a8_unknown_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.apply_invocation_states(invocations(spark, sf_dir), state_batch(spark, sf_dir))[1]


PAGE = "invocation_id, sequence, event_name, first_sequence, last_sequence, has_earlier, has_later"
PAGE_SQL = """SELECT invocation_id, sequence, event_name, min(sequence) OVER w AS first_sequence, max(sequence) OVER w AS last_sequence, min(sequence) OVER w > 1 AS has_earlier, max(sequence) OVER w < durable_sequence AS has_later
FROM p JOIN iv ON iv.id = p.invocation_id WINDOW w AS (PARTITION BY invocation_id)"""


@query(f"{WITH}, p AS (SELECT * FROM ev WHERE sequence > 3 QUALIFY row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) <= 5) {PAGE_SQL}")
def b1_event_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.event_page(runtime_events(spark, sf_dir), invocations(spark, sf_dir), after=3, limit=5).select(*PAGE.split(", "))


@query(f"{WITH}, p AS (SELECT * FROM ev WHERE sequence < 9 QUALIFY row_number() OVER (PARTITION BY invocation_id ORDER BY sequence DESC) <= 4) {PAGE_SQL}")
def b1_event_page_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.event_page(runtime_events(spark, sf_dir), invocations(spark, sf_dir), before=9, limit=4).select(*PAGE.split(", "))


@query(f"{WITH}, q AS (SELECT id AS invocation_id, CAST(u AS BIGINT) AS sequence FROM iv, (VALUES (1), (12)) t(u)) SELECT q.invocation_id, q.sequence, event_name, ev.id IS NOT NULL AS found FROM q LEFT JOIN ev ON q.invocation_id = ev.invocation_id AND q.sequence = ev.sequence")
def b2_event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = invocations(spark, sf_dir).select(F.col("id").alias("invocation_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("sequence"))
    return G.event_detail(runtime_events(spark, sf_dir), keys).select("invocation_id", "sequence", "event_name", "found")


@query(f"{WITH}, p AS (SELECT *, max(sequence) OVER (PARTITION BY invocation_id) AS l FROM ev WHERE event_type <> 'routing') SELECT invocation_id, sequence, max(sequence) OVER (PARTITION BY invocation_id) < l AS has_later FROM (SELECT * FROM p WHERE sequence > 4 QUALIFY row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) <= 3)")
def b3_user_event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.user_event_page(runtime_events(spark, sf_dir).filter("event_type <> 'routing'"), 4, 3).select("invocation_id", "sequence", "has_later")


@query(f"{WITH} SELECT invocation_id, event_id, CAST(row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) AS BIGINT) AS sequence, FALSE AS has_values FROM ev WHERE event_type <> 'phase'")
def b4_project_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = event_number(I.project_mode(runtime_events(spark, sf_dir), "standard"))
    return out.select("invocation_id", F.col("_e").alias("event_id"), "sequence", F.coalesce("input_json", "output_json", "operations_json").isNotNull().alias("has_values"))


@query(f"{WITH} SELECT invocation_id, sequence FROM ev WHERE event_name IN ('wait.created', 'invocation.running', 'node.completed', 'node.failed', 'node.skipped')")
def b5_recovery_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.recovery_points(runtime_events(spark, sf_dir)).select("invocation_id", "sequence")


@query(f"{WITH} SELECT id, event_name = 'node.running' AS has_input, event_name = 'node.completed' AS has_output, event_name LIKE 'node.%' AS has_operations, CAST(NULL AS VARCHAR) AS output_json FROM ev")
def b7_event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.event_view(runtime_events(spark, sf_dir), False).select("id", "has_input", "has_output", "has_operations", "output_json")


@query(f"{WITH} SELECT id, CASE WHEN event_name LIKE 'node.%' THEN node WHEN subject_type = 'node' THEN subject_id END AS node_id, edge_id FROM ev")
def b9_normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.normalize_events(runtime_events(spark, sf_dir)).select("id", "node_id", "edge_id")


@query(f"{WITH} SELECT iv.id, iv.session_id, state, iv.created_at_ms FROM iv JOIN se ON se.id = iv.session_id AND current_invocation_id = iv.id WHERE workflow_revision_id IN ('v1', 'v2', 'v4') AND event_mode <> 'minimal' AND state IN ('created', 'running', 'waiting')")
def c1_recoverable_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = workflow_versions(spark, sf_dir).filter(F.col("id").isin("v1", "v2", "v4"))
    return G.recoverable_invocations(sessions(spark, sf_dir), invocations(spark, sf_dir), revisions).select("id", "session_id", "state", "created_at_ms")


@query(f"{WITH} SELECT iv.id, ve.workflow_id, definition_hash, session_key, durable_sequence AS live_sequence, current_invocation_id = iv.id AS is_current FROM iv JOIN ve ON ve.id = workflow_version_id JOIN se ON se.id = session_id")
def c2_invocation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.invocation_records(invocations(spark, sf_dir), workflow_versions(spark, sf_dir), sessions(spark, sf_dir))
    return out.select("id", "workflow_id", "definition_hash", "session_key", "live_sequence", "is_current")


@query(f"{WITH} SELECT se.id, workflow_id, session_key, current_invocation_id, iv.state AS current_state, (SELECT count(*) FROM iv WHERE session_id = se.id) AS invocation_count, se.created_at_ms, se.updated_at_ms FROM se LEFT JOIN iv ON iv.id = current_invocation_id")
def c3_session_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.session_directory(sessions(spark, sf_dir), invocations(spark, sf_dir))


@query(f"""{WITH}, a AS (SELECT session_id, id AS anchor_id, created_at_ms AS c FROM iv WHERE created_at_ms % 4 = 1),
r AS (SELECT a.session_id, anchor_id, iv.id, row_number() OVER (PARTITION BY anchor_id ORDER BY created_at_ms DESC, iv.id DESC) AS n, created_at_ms FROM iv JOIN a ON iv.session_id = a.session_id AND (created_at_ms, iv.id) < (c, anchor_id))
SELECT session_id, anchor_id, id, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY n DESC) AS BIGINT) AS position, has_more FROM (SELECT *, max(n) OVER (PARTITION BY anchor_id) > 2 AS has_more FROM r) WHERE n <= 2""")
def c4_invocation_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = invocations(spark, sf_dir)
    return G.invocation_neighbors(i, i.filter("created_at_ms % 4 = 1"), "older", 2).select("session_id", "anchor_id", "id", "position", "has_more")


@query(f"""{WITH}, r AS (SELECT a.session_id, a.id AS anchor_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY b.created_at_ms, b.id) AS n FROM iv a JOIN iv b ON b.session_id = a.session_id AND (b.created_at_ms, b.id) > (a.created_at_ms, a.id))
SELECT session_id, anchor_id, id, CAST(n AS BIGINT) AS position, has_more FROM (SELECT *, max(n) OVER (PARTITION BY anchor_id) > 3 AS has_more FROM r) WHERE n <= 3""")
def c4_newer_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invocation as an anchor."""
    i = invocations(spark, sf_dir)
    return G.invocation_neighbors(i, i, "newer", 3).select("session_id", "anchor_id", "id", "position", "has_more")


@query(f"{WITH} SELECT CASE WHEN user_id%2=0 THEN session_id ELSE 'none' END AS session_id, id || CASE WHEN user_id%3=0 THEN '?' ELSE '' END AS id, CASE WHEN user_id%3=0 THEN 'unknown_anchor' ELSE 'other_session' END AS error FROM iv WHERE user_id%3=0 OR user_id%2=1")
def c4_anchor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = invocations(spark, sf_dir), F.col("session_id").cast("long")
    anchors = i.select(F.when(u % 2 == 0, F.col("session_id")).otherwise("none").alias("session_id"), F.concat("id", F.when(u % 3 == 0, "?").otherwise("")).alias("id"))
    return G.anchor_errors(i, anchors)


@query(f"""{WITH}, d AS (SELECT id, state, updated_at_ms, durable_sequence FROM iv WHERE created_at_ms % 5 <> 0), l AS (SELECT id, 'running' AS state, updated_at_ms + created_at_ms % 3 - 1 AS updated_at_ms, durable_sequence + 1 AS durable_sequence FROM iv WHERE created_at_ms % 7 <> 0),
j AS (SELECT d.id AS di, l.id AS li, d.state AS ds, l.state AS ls, d.updated_at_ms AS du, l.updated_at_ms AS lu, d.durable_sequence AS dq, l.durable_sequence AS lq, d.id IS NOT NULL AND (l.id IS NULL OR d.updated_at_ms > l.updated_at_ms OR (d.updated_at_ms = l.updated_at_ms AND d.state IN ('completed','failed','cancelled','interrupted'))) AS keep FROM d FULL JOIN l USING (id))
SELECT COALESCE(li, di) AS id, CASE WHEN keep THEN ds ELSE ls END AS state, CASE WHEN keep THEN du ELSE lu END AS updated_at_ms, COALESCE(lq, dq) AS durable_sequence FROM j""")
def c5_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = invocations(spark, sf_dir).select("id", "state", "updated_at_ms", "durable_sequence", "created_at_ms")
    live = i.filter("created_at_ms % 7 <> 0").withColumns({"state": F.lit("running"), "updated_at_ms": F.expr("updated_at_ms + created_at_ms % 3 - 1"), "durable_sequence": F.expr("durable_sequence + 1")})
    return G.overlay(i.filter("created_at_ms % 5 <> 0").drop("created_at_ms"), live.drop("created_at_ms"))


@query(f"{WITH}, q AS (SELECT session_id AS sid, id, session_id || CASE WHEN created_at_ms % 2 = 0 THEN '' ELSE '' END AS s, CASE WHEN created_at_ms % 6 = 0 THEN 'v0' ELSE workflow_version_id END AS rev FROM iv) SELECT q.id AS request_id, sid AS session_id, CASE WHEN rev <> workflow_revision_id THEN 'revision_mismatch' WHEN c.state IN ('created','running','waiting') THEN 'busy' ELSE 'accepted' END AS verdict FROM q JOIN se ON se.id = sid LEFT JOIN iv c ON c.id = current_invocation_id")
def c10_admission_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = invocations(spark, sf_dir)
    requests = i.select(F.col("id").alias("request_id"), "session_id", F.when(F.col("created_at_ms") % 6 == 0, "v0").otherwise(F.col("workflow_version_id")).alias("revision_id"))
    return I.admission_conflicts(sessions(spark, sf_dir), i, requests)


WAITS_SQL = "w AS (SELECT invocation_id, wait_key FROM (SELECT invocation_id, wait_key, arg_max(event_name, sequence) AS l FROM ev WHERE event_name LIKE 'wait.%' GROUP BY 1, 2) WHERE l = 'wait.created')"


@query(f"""{WITH}, {WAITS_SQL}, q AS (SELECT event_id, CASE WHEN k%17=0 THEN 'v9' ELSE 'v' || user_id%5 END AS rev, 's' || user_id AS sk, wait_key AS wk FROM ev WHERE k%3=0)
SELECT event_id AS response_id, CASE WHEN se.id IS NULL THEN 'unknown_session' WHEN iv.id IS NULL THEN 'no_current_invocation' WHEN iv.state IN ('created','running') THEN 'busy' WHEN iv.state <> 'waiting' THEN 'not_waiting' WHEN iv.workflow_version_id <> rev THEN 'other_definition' WHEN w.wait_key IS NULL THEN 'unknown_wait_key' ELSE 'ok' END AS verdict
FROM q LEFT JOIN se ON workflow_revision_id = rev AND session_key = sk LEFT JOIN iv ON iv.id = current_invocation_id LEFT JOIN w ON w.invocation_id = iv.id AND w.wait_key = wk""")
def c11_match_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).filter("k % 3 = 0")
    responses = e.select(F.col("event_id").alias("response_id"), F.when(F.col("k") % 17 == 0, "v9").otherwise(F.concat(F.lit("v"), (F.col("user_id") % 5).cast("string"))).alias("revision_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_key"), F.concat(F.lit("w"), (F.col("k") % 3).cast("string")).alias("wait_key"))
    return I.match_resumes(sessions(spark, sf_dir), invocations(spark, sf_dir), P.active_waits(prepared(spark, sf_dir)), responses)


@query(f"{WITH} SELECT ev.id FROM ev JOIN iv ON iv.id = invocation_id WHERE created_at_ms % 9 = 0")
def c12_orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.orphan_events(runtime_events(spark, sf_dir), invocations(spark, sf_dir).filter("created_at_ms % 9 <> 0")).select("id")


@query(f"""{WITH}, i AS (SELECT id, session_id, CASE WHEN created_at_ms % 10 = 0 THEN 'v7' WHEN created_at_ms % 10 = 1 THEN 'v1' ELSE workflow_version_id END AS v FROM iv), s AS (SELECT * FROM se WHERE CAST(id AS BIGINT) % 11 <> 0)
SELECT * FROM (SELECT i.id, session_id, v AS workflow_version_id, CASE WHEN s.id IS NULL THEN 'no_session' WHEN ve.id IS NULL THEN 'no_version' WHEN workflow_revision_id <> v THEN 'mismatch' END AS problem FROM i LEFT JOIN s ON s.id = session_id LEFT JOIN ve ON ve.id = v) WHERE problem IS NOT NULL""")
def c13_revision_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("created_at_ms") % 10
    i = invocations(spark, sf_dir).withColumn("workflow_version_id", F.when(c == 0, "v7").when(c == 1, "v1").otherwise(F.col("workflow_version_id")))
    return I.revision_mismatches(sessions(spark, sf_dir).filter(F.col("id").cast("long") % 11 != 0), i, workflow_versions(spark, sf_dir))


@query(f"{WITH}, b AS (SELECT id AS invocation_id, durable_sequence FROM iv WHERE event_mode <> 'full') SELECT iv.id AS invocation_id, COALESCE(durable_sequence, 0) AS latest_sequence, COALESCE((SELECT max(sequence) FROM ev WHERE ev.invocation_id = iv.id AND event_type = 'routing'), 0) AS latest_user_sequence FROM iv")
def d9_latest_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runtime_events(spark, sf_dir)
    return P.latest_sequences(invocations(spark, sf_dir), e, e.filter("event_type = 'routing'"))


@query(f"{WITH}, b AS (SELECT * FROM ev WHERE event_type = 'operator_call') SELECT id, CAST(row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) + COALESCE((SELECT max(sequence) FROM ev e WHERE e.invocation_id = b.invocation_id AND event_type = 'routing'), 0) AS BIGINT) AS sequence FROM b")
def e3_assign_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runtime_events(spark, sf_dir)
    batch = e.filter("event_type = 'operator_call'").withColumnRenamed("sequence", "old")
    return G.assign_sequences(batch, e.filter("event_type = 'routing'"), "invocation_id", ["old"]).select("id", "sequence")


@query(f"{WITH}, r AS (SELECT * FROM iv WHERE state IN ('completed','failed','cancelled','interrupted') AND durable_sequence % 2 = 0 AND created_at_ms % 3 <> 0) SELECT id FROM r QUALIFY row_number() OVER (ORDER BY updated_at_ms DESC, id DESC) > 10")
def e5_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = invocations(spark, sf_dir).withColumn("runtime_durable", F.col("durable_sequence") % 2 == 0).withColumn("user_durable", F.col("created_at_ms") % 3 != 0)
    return G.retention(i, "recent", 10).select("id")


@query(f"{WITH}, s AS (SELECT invocation_id, sequence - 1 AS event_sequence FROM ev) SELECT * FROM s WHERE event_sequence = 0 UNION ALL (SELECT * FROM s WHERE event_sequence <> 0 QUALIFY row_number() OVER (PARTITION BY invocation_id ORDER BY event_sequence DESC) <= 8)")
def e6_retain_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.retain_checkpoints(runtime_events(spark, sf_dir).select("invocation_id", (F.col("sequence") - 1).alias("event_sequence")))


@query(f"""{WITH}, p AS (SELECT id, created_at_ms, row_number() OVER (ORDER BY created_at_ms DESC, id DESC) AS n FROM iv WHERE (created_at_ms, id) < (1706000000000, 'm'))
SELECT id, created_at_ms, CAST(n AS BIGINT) AS position, CASE WHEN n = 20 AND EXISTS (SELECT 1 FROM p WHERE n = 21) THEN rtrim(translate(to_base64(encode('{{"timestamp":' || created_at_ms || ',"id":"' || id || '"}}')), '+/', '-_'), '=') END AS next_cursor FROM p WHERE n <= 20""")
def f1_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keyset_page(invocations(spark, sf_dir), "created_at_ms", "id", (1706000000000, "m"), 20).select("id", "created_at_ms", "position", "next_cursor")


@query(f"""{WITH}, p AS (SELECT id, session_id, created_at_ms, row_number() OVER (PARTITION BY session_id ORDER BY created_at_ms DESC, id DESC) AS n FROM iv)
SELECT id, session_id, CAST(n AS BIGINT) AS position, CASE WHEN n = 2 AND max(n) OVER (PARTITION BY session_id) > 2 THEN rtrim(translate(to_base64(encode('{{"timestamp":' || created_at_ms || ',"id":"' || id || '"}}')), '+/', '-_'), '=') END AS next_cursor FROM p QUALIFY n <= 2""")
def f1_keyset_page_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keyset_page(invocations(spark, sf_dir), "created_at_ms", "id", None, 2, within="session_id").select("id", "session_id", "position", "next_cursor")


@query(f"{WITH} SELECT id, CASE WHEN user_id%4=0 THEN NULL ELSE created_at_ms END AS timestamp, CASE WHEN user_id%4=0 THEN NULL ELSE id END AS decoded_id FROM iv")
def f2_cursor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = invocations(spark, sf_dir), F.col("session_id").cast("long")
    cursor = F.when(u % 8 == 0, F.lit("?junk")).when(u % 4 == 0, G.encode_cursor(-F.col("created_at_ms"), F.col("id"))).otherwise(G.encode_cursor(F.col("created_at_ms"), F.col("id")))
    return i.withColumn("c", G.decode_cursor(cursor)).select("id", "c.timestamp", F.col("c.id").alias("decoded_id"))


@query(f"{WITH}, {EXEC_SQL.strip()}, inv AS (SELECT invocation_id, min(ms) - 5 AS created FROM ev GROUP BY 1) SELECT invocation_id, execution_id, CAST(row_number() OVER (PARTITION BY invocation_id ORDER BY first_event_sequence, COALESCE(started_at_ms, created), execution_id) AS BIGINT) AS rank FROM d1 JOIN inv USING (invocation_id)")
def f3_order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = P.timeline_spans(P.project_node_executions(prepared(spark, sf_dir)), invocations(spark, sf_dir))
    return G.order_spans(spans, "invocation_id").select("invocation_id", "execution_id", "rank")


@query("""WITH d AS (SELECT p_partkey, p_brand, CASE p_size%3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN p_size%4<>0 THEN p_size%7 END AS si, p_type, p_name FROM part)
SELECT p_partkey AS id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, si NULLS LAST, p_type, p_name, p_partkey) AS BIGINT) AS rank FROM d""")
def f3_order_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    d = p.select("p_partkey", "p_brand", F.when(p.p_size % 3 == 0, "error").when(p.p_size % 3 == 1, "warning").otherwise("info").alias("severity"), F.when(p.p_size % 4 != 0, p.p_size % 7).alias("source_index"), F.col("p_type").alias("object_type"), F.col("p_name").alias("object_id"), F.col("p_partkey").alias("field"), F.lit("c").alias("code"), F.lit("m").alias("message"))
    return G.order_diagnostics(d, "p_brand").select(F.col("p_partkey").alias("id"), "rank")


@query(f"WITH {CUSTOMER_VERSIONS_SQL}, l AS (SELECT id || 'l' AS id, workflow_id, definition_hash FROM cv WHERE n%3 <> 1 UNION ALL SELECT id || 'm', workflow_id, 'm' || definition_hash FROM cv WHERE n%5 = 0), d AS (SELECT id, workflow_id, definition_hash FROM cv WHERE n%4 <> 3), u AS (SELECT * FROM d UNION ALL SELECT * FROM l WHERE (workflow_id, definition_hash) NOT IN (SELECT (workflow_id, definition_hash) FROM d)) SELECT *, (workflow_id, definition_hash) IN (SELECT (workflow_id, definition_hash) FROM cv WHERE n%2 = 0) AS registered FROM u")
def g1_version_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = customer_versions(spark, sf_dir).select("id", "workflow_id", "definition_hash", "n")
    live = v.filter("n % 3 <> 1").withColumn("id", F.concat("id", F.lit("l")))
    extra = v.filter("n % 5 = 0").withColumns({"id": F.concat("id", F.lit("m")), "definition_hash": F.concat(F.lit("m"), "definition_hash")})
    return G.version_directory(v.filter("n % 4 <> 3"), v.filter("n % 2 = 0"), live.union(extra)).select("id", "workflow_id", "definition_hash", "registered")


@query(f"{WITH} SELECT DISTINCT invocation_id, instance_key FROM ev WHERE event_name = 'node.skipped' EXCEPT SELECT invocation_id, instance_key FROM ev WHERE event_name = 'node.skipped' AND sequence <= 5")
def g2_new_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prepared(spark, sf_dir).filter("event_name = 'node.skipped'").select("invocation_id", "sequence", F.col("p.node_instance_key").alias("instance_key"))
    return G.new_skips(s.filter("sequence <= 5"), s)


@query(f"{WITH}, d AS (SELECT invocation_id, sequence FROM ev WHERE sequence <= 6 AND user_id%7<>0), x AS (SELECT invocation_id, max(sequence) AS m FROM d GROUP BY 1), u AS (SELECT *, 'durable' AS source FROM d UNION ALL SELECT e.invocation_id, sequence, 'live' FROM ev e LEFT JOIN x USING (invocation_id) WHERE sequence >= 5 AND (m IS NULL OR sequence > m)) SELECT * FROM u WHERE sequence > 2 QUALIFY row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) <= 7")
def g3_merge_user_event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).select("invocation_id", "sequence", "user_id")
    return G.merge_user_event_pages(e.filter("sequence <= 6 AND user_id % 7 <> 0").drop("user_id"), e.filter("sequence >= 5").drop("user_id"), 2, 7)


@query("WITH d AS (SELECT doc_id, source, text, CASE WHEN strlen(text) > 8192 THEN sha256(text) END AS s FROM documents) SELECT source AS owner, s AS sha256, CAST(max(strlen(text)) AS BIGINT) AS size_bytes, count(*) AS uses FROM d WHERE s IS NOT NULL GROUP BY 1, 2")
def i6_externalize_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("owner"), "text")
    return I.externalize(docs, "owner", "text")[1].drop("payload")


@query("""SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN '{"$artifact":"' || sha256(text) || '"}' ELSE text END AS text FROM documents""")
def i6_externalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("owner"), "text")
    return I.externalize(docs, "owner", "text")[0].select("doc_id", "text")


@query(f"""{WITH}, b AS (SELECT invocation_id, max(sequence) FILTER (event_name IN ('wait.created', 'invocation.running', 'node.completed', 'node.failed', 'node.skipped')) AS p, max(sequence) AS l FROM ev WHERE k%3<>0 GROUP BY 1),
r AS (SELECT b.*, CASE WHEN durable_sequence%2=0 THEN durable_sequence//2 ELSE 0 END AS base FROM b JOIN iv ON iv.id = invocation_id)
SELECT * FROM (SELECT invocation_id, base AS from_sequence, CASE WHEN p > base THEN p WHEN l - base >= 4 THEN l END AS to_sequence, CASE WHEN p > base THEN 'recovery_point' ELSE 'interval' END AS reason FROM r) WHERE to_sequence IS NOT NULL""")
def i7_advance_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = invocations(spark, sf_dir).filter("durable_sequence % 2 = 0").select(F.col("id").alias("invocation_id"), F.expr("durable_sequence div 2").alias("event_sequence"))
    e = runtime_events(spark, sf_dir).join(numbered_events(spark, sf_dir).select("invocation_id", "sequence", "k"), ["invocation_id", "sequence"]).filter("k % 3 <> 0")
    return I.advance_checkpoints(stored, e, 4)


@query(f"{WITH} SELECT id, invocation_id, sequence, event_type FROM ev")
def a1_load_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived events written as a journal and read back."""
    path = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    for name, schema in TABLES.items():
        if name != "runtime_events":
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
    write_events(runtime_events(spark, sf_dir), f"{path}/runtime_events")
    return load_journal(spark, path)["runtime_events"].select("id", "invocation_id", "sequence", "event_type")
