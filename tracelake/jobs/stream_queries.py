"""Streaming queries: the derived journal is written in several files and streamed back; results equal the batch operators'."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import TABLES
from ..sources.adapters import JOURNAL_SQL, USER_EVENTS_SQL, invocations, runtime_events, sessions, user_events
from ..sources.scratch import shared_folder
from ..streaming import appends as A
from ..streaming import health, live
from ..streaming import streams as M
from . import agent_queries, projection_queries  # noqa: F401  their SQL
from .registry import ORACLE_SQL, query

WITH = f"WITH {JOURNAL_SQL}"


def journal(spark: SparkSession, sf_dir: str, repeats: bool = False, cursors: DataFrame | None = None) -> tuple[str, DataFrame, int]:
    """(folder, stream, bundles for its invocations) of the derived journal, in files of random events."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = runtime_events(spark, sf_dir)
    if repeats:
        events = events.union(events.filter("sequence % 4 = 0"))
    each = dealt(events, f"{base}/events")
    return base, M.tail_events(spark, f"{base}/events", cursors, each), bundled(each)


#: Rows of a file of a derived journal.
FILE_ROWS = 50_000
#: Events of a bundle of invocations, about: some ten to twenty invocations.
BUNDLE_ROWS = 250


def bundled(each: int) -> int:
    """Bundles for a stream with two triggers of so many files: they follow its rows."""
    return 2 * each * FILE_ROWS // BUNDLE_ROWS


def dealt(events: DataFrame, path: str, least: int = 4) -> int:
    """Writes events to files of random ones, as many as their number asks for and `least` at least; how many a trigger
    takes, so that a stream has two triggers. Files and tasks stay small however long the journal is."""
    n = max(least, -(-events.count() // FILE_ROWS))
    events.repartition(n, F.xxhash64("id", F.lit(1))).write.parquet(path)
    return -(-n // 2)


def ran(stream: DataFrame, base: str, mode: str = "append") -> DataFrame:
    M.run_to_end(stream, f"{base}/out", f"{base}/checkpoint", mode)
    return stream.sparkSession.read.parquet(f"{base}/out")


def last_batch(df: DataFrame, key: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc("batch_id")))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n", "batch_id")


@query(f"{WITH}, c AS (SELECT id AS invocation_id, durable_sequence // 2 AS cur FROM iv WHERE durable_sequence % 2 = 0) SELECT ev.invocation_id, sequence, event_name FROM ev LEFT JOIN c USING (invocation_id) WHERE sequence > COALESCE(cur, 0)")
def m1_tail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = invocations(spark, sf_dir).filter("durable_sequence % 2 = 0").select(F.col("id").alias("invocation_id"), F.expr("durable_sequence div 2").alias("cursor"))
    base, stream, _ = journal(spark, sf_dir, cursors=cursors)
    return ran(stream, base).select("invocation_id", "sequence", "event_name")


@query(ORACLE_SQL["d18_unread_counts"])
def m1_live_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    each = dealt(user_events(spark, sf_dir), f"{base}/events")
    read = spark.read.parquet(f"{base}/events").select("invocation_id").distinct().withColumn("read_through", F.col("invocation_id").cast("long") % 6).filter(F.col("invocation_id").cast("long") % 3 != 0)
    stream = M.tail_events(spark, f"{base}/events", files_per_trigger=each, table="user_events")
    return last_batch(ran(M.live_unread(stream, read), base, "update"), "invocation_id")


@query(f"""{WITH}, w AS (SELECT invocation_id, string_agg(wait_key, ',' ORDER BY wait_key) AS o FROM (SELECT invocation_id, wait_key, arg_max(event_name, sequence) AS l FROM ev WHERE event_name LIKE 'wait.%' GROUP BY 1, 2) WHERE l = 'wait.created' GROUP BY 1)
SELECT iv.id AS invocation_id, state, durable_sequence AS through_sequence, (SELECT count(*) FROM ev WHERE ev.invocation_id = iv.id AND event_name LIKE 'node.%') AS node_events, COALESCE(o, '') AS open_waits FROM iv LEFT JOIN w ON w.invocation_id = iv.id""")
def m2_live_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, stream, bundles = journal(spark, sf_dir, repeats=True)
    return last_batch(ran(M.live_projection(stream, timers=False, bundles=bundles), base, "update"), "invocation_id")


@query(f"{WITH} SELECT id, invocation_id, sequence FROM ev")
def m3_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return committed(spark, sf_dir).read("runtime_events").select("id", "invocation_id", "sequence")


def committed(spark: SparkSession, sf_dir: str):
    """The store that a stream of both journals, with repeats, has been committed to."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = runtime_events(spark, sf_dir).withColumn("state", F.when(F.col("event_name").startswith("invocation."), F.col("status"))).withColumn("error_json", F.when(F.col("event_name") == "invocation.failed", F.col("timing_json")))
    own = A.items(e.union(e.filter("sequence % 4 = 0")))
    each = dealt(own, f"{base}/items")
    store = A.journal_store(spark, f"{base}/store")
    A.admit(store, invocations(spark, sf_dir).withColumn("durable_sequence", F.lit(0).cast("long")).withColumn("state", F.lit("created")), sessions(spark, sf_dir))
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/items")
    A.stream_commits(stream, store, f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store


@query(f"""{WITH}, t AS (SELECT invocation_id AS id, max(sequence) AS durable_sequence, max(ms) AS updated_at_ms, arg_max(struct_pack(s := status, q := t_queue, r := t_run, f := event_name = 'invocation.failed'), sequence) FILTER (event_name LIKE 'invocation.%') AS l FROM ev GROUP BY 1)
SELECT id, COALESCE(l.s, 'created') AS state, durable_sequence, updated_at_ms, CASE WHEN l.f THEN '{{"queue":' || l.q || ',"run":' || l.r || '}}' END AS error_json FROM t""")
def m3_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return committed(spark, sf_dir).read("invocations").select("id", "state", "durable_sequence", "updated_at_ms", "error_json")


@query(f"""{WITH}, {USER_EVENTS_SQL} SELECT journal, invocation_id, CAST(sequence AS BIGINT) AS sequence, verdict FROM (
SELECT 'user_events' AS journal, invocation_id, sequence, CASE WHEN conv_id%7=0 THEN 'unknown' ELSE 'new' END AS verdict FROM ue
UNION ALL SELECT 'user_events', invocation_id, sequence, CASE WHEN conv_id%7=0 THEN 'unknown' WHEN sequence%2=0 THEN 'duplicate' ELSE 'conflict' END FROM ue WHERE sequence%3=0)""")
def m3_stream_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events in two commits, the second with repeats and contradictions of the first; some invocations aren't admitted."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    store, u = A.journal_store(spark, f"{base}/store"), user_events(spark, sf_dir)
    none = runtime_events(spark, sf_dir).limit(0)
    owners = u.select(F.col("invocation_id").alias("id")).distinct().filter(F.col("id").cast("long") % 7 != 0)
    A.admit(store, owners.select(*[(F.col("id") if c == "id" else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in TABLES["invocations"].split(", "))]), spark.createDataFrame([], TABLES["sessions"]))
    A.commit_batch(store, A.items(none, u), 1)
    again = u.filter("sequence % 3 = 0").withColumn("occurred_at_ms", F.col("occurred_at_ms") + F.col("sequence") % 2)
    second = A.items(none, again)
    A.commit_batch(store, second, 2)
    key = ("journal", "invocation_id", "sequence")
    new = store.read("user_events").select(F.lit("user_events").alias("journal"), *key[1:], F.lit("new").alias("verdict"))
    told = [store.read(t).select(*key, F.lit(v).alias("verdict")) for t, v in (("conflicts", "conflict"), ("unknown", "unknown"))]
    same = A.classify(store, second, store.manifest()).filter("verdict = 'duplicate'").select(*key, "verdict")
    return new.union(told[0]).union(told[1]).union(same)


def live_rows(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    base, stream, _ = journal(spark, sf_dir, repeats=True)
    return live.view(live.latest(ran(live.live_projection(stream, parts=(part,), timers=False), base, "update")), part)


@query(ORACLE_SQL["d1_node_executions"])
def m2_live_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_queries.with_code(live_rows(spark, sf_dir, "execution"), "error", "error_code").drop("timing_json")


@query(ORACLE_SQL["d2_nodes"])
def m2_live_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_queries.with_code(live_rows(spark, sf_dir, "node"), "latest_error", "latest_error_code").drop("latest_timing")


@query(ORACLE_SQL["d3_edges"])
def m2_live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(spark, sf_dir, "edge")


@query(ORACLE_SQL["d4_operator_rollup"])
def m2_live_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(spark, sf_dir, "rollup")


@query(ORACLE_SQL["d5_operator_states"])
def m2_live_call_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(spark, sf_dir, "call_state")


@query(ORACLE_SQL["d6_active_waits"])
def m2_live_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(spark, sf_dir, "wait")


@query(ORACLE_SQL["d8_latest_phase"])
def m2_live_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(spark, sf_dir, "phase")


@query(f"{WITH} SELECT id AS invocation_id, state, durable_sequence AS final_sequence FROM iv WHERE state IN ('completed', 'failed', 'cancelled', 'interrupted')")
def m4_detect_stream_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, stream, bundles = journal(spark, sf_dir)
    return M.stream_ends(ran(M.detect_stream_end(stream, timers=False, bundles=bundles), base))


@query(f"""{WITH}, kept AS (SELECT invocation_id, sequence FROM ev WHERE ms % 5 <> 3), n AS (SELECT *, row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) AS place FROM kept)
SELECT invocation_id, min(place) AS expected, min(sequence) AS got, 'degraded' AS status FROM n WHERE sequence <> place GROUP BY 1""")
def m5_detect_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal that lacks about a fifth of its events; a gap counts at once, and what is told last holds."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    each = dealt(runtime_events(spark, sf_dir).filter("occurred_at_ms % 5 <> 3"), f"{base}/events")
    out = ran(M.detect_gaps(M.tail_events(spark, f"{base}/events", files_per_trigger=each), timeout_ms=0, timers=False, bundles=bundled(each)), base, "update")
    return last_batch(out, "invocation_id").filter("status = 'degraded'")


def healthy(spark: SparkSession, sf_dir: str, events: DataFrame, marks: DataFrame) -> DataFrame:
    """What three streams tell of invocations: events, the even ones once more as user events, and marks."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    each = dealt(events, f"{base}/runtime")
    events = spark.read.schema(events.schema).parquet(f"{base}/runtime")
    u = events.filter("sequence % 2 = 0").select(*[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in TABLES["user_events"].split(", "))])
    user = dealt(u, f"{base}/user", 2)
    few = dealt(marks.withColumn("id", F.concat_ws(" ", "invocation_id", "journal", "marked_at_ms")), f"{base}/marks", 2)
    streams = [M.tail_events(spark, f"{base}/runtime", files_per_trigger=each), M.tail_events(spark, f"{base}/user", files_per_trigger=user, table="user_events"), spark.readStream.schema(health.MARKS).option("maxFilesPerTrigger", few).parquet(f"{base}/marks")]
    return ran(health.journal_health(*streams, timeout_ms=0, timers=False, final=False, bundles=bundled(each)), base, "update")


def marks(spark: SparkSession, sf_dir: str, status: dict[int, str], journal: dict[int, str], behind: dict[int, int], mod: int) -> DataFrame:
    """A mark, and an older one that doesn't count, of invocations whose session's number modulo `mod` has a status."""
    rest = F.col("session_id").cast("long") % mod
    pick = lambda of: F.coalesce(F.lit(None), *[F.when(rest == k, F.lit(v)) for k, v in of.items()])
    rows = invocations(spark, sf_dir).select(F.col("id").alias("invocation_id"), pick(journal).alias("journal"), pick(status).alias("status"), (F.col("durable_sequence") - F.coalesce(pick(behind), F.lit(0))).alias("durable_sequence"), F.lit(2).cast("long").alias("marked_at_ms")).filter("status IS NOT NULL")
    older = F.struct(F.lit("pending").alias("status"), F.lit(1).cast("long").alias("marked_at_ms"))
    return rows.withColumn("_m", F.explode(F.array(F.struct("status", "marked_at_ms"), older))).select("invocation_id", "journal", "_m.status", "durable_sequence", "_m.marked_at_ms")


@query(f"{WITH} SELECT id AS invocation_id, state, durable_sequence AS final_sequence, CASE user_id%4 WHEN 0 THEN 'durable' WHEN 1 THEN 'degraded' END AS persistence FROM iv WHERE state IN ('completed', 'failed', 'cancelled', 'interrupted') AND user_id%4 < 2")
def m4_settled_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends need a settled mark: durable up to the last event, or degraded; durable but behind, or no mark at all, is no end."""
    m = marks(spark, sf_dir, {0: "durable", 1: "degraded", 2: "durable"}, dict.fromkeys(range(3), "runtime"), {2: 1}, 4)
    return health.ends(healthy(spark, sf_dir, runtime_events(spark, sf_dir), m))


@query(f"""{WITH}, kept AS (SELECT invocation_id, user_id, sequence FROM ev WHERE ms % 5 <> 3), n AS (SELECT *, row_number() OVER (PARTITION BY invocation_id ORDER BY sequence) AS place FROM kept),
g AS (SELECT invocation_id, min(place) AS expected, min(sequence) AS got FROM n WHERE sequence <> place GROUP BY 1)
SELECT iv.id AS invocation_id, 'runtime' AS journal, CASE WHEN user_id%4=2 THEN 'unserializable' ELSE 'degraded' END AS status, expected, got FROM iv LEFT JOIN g ON g.invocation_id = iv.id WHERE expected IS NOT NULL OR user_id%4=2
UNION ALL SELECT id, 'user', 'degraded', NULL, NULL FROM iv WHERE user_id%4=1""")
def m5_journal_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runtime journal that lacks a fifth of its events, and marks of both journals."""
    m = marks(spark, sf_dir, {1: "degraded", 2: "unserializable"}, {1: "user", 2: "runtime"}, {}, 4)
    return health.last_health(healthy(spark, sf_dir, runtime_events(spark, sf_dir).filter("occurred_at_ms % 5 <> 3"), m)).filter("status <> 'healthy'")


@query(f"{WITH} SELECT session_id, CAST(count(*) AS BIGINT) AS events, max(ms) AS last_at_ms FROM ev JOIN iv ON iv.id = invocation_id GROUP BY 1")
def m6_session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, stream, _ = journal(spark, sf_dir)
    out = ran(M.session_activity(stream, invocations(spark, sf_dir)), base, "update")
    return last_batch(out, "session_id").select("session_id", "events", "last_at_ms")


@query(f"{WITH} SELECT iv.session_id, iv.id AS invocation_id, CAST(count(*) AS BIGINT) AS events, max(sequence) AS through_sequence FROM ev JOIN iv ON iv.id = invocation_id GROUP BY 1, 2")
def m6_session_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of all triggers together."""
    base, stream, _ = journal(spark, sf_dir)
    M.session_changes(stream, invocations(spark, sf_dir), f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("session_id", "invocation_id").agg(F.sum("events").alias("events"), F.max("through_sequence").alias("through_sequence"))


@query(f"{WITH} SELECT id, invocation_id, sequence FROM ev")
def m7_dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, stream, _ = journal(spark, sf_dir, repeats=True)
    return ran(M.dedupe_stream(stream, "3650 days"), base).select("id", "invocation_id", "sequence")


@query(f"""{WITH}, x AS (SELECT *, lag(CASE WHEN event_name = 'wait.created' THEN ms END) OVER (PARTITION BY invocation_id, wait_key ORDER BY sequence) AS since FROM ev WHERE event_name LIKE 'wait.%')
SELECT invocation_id, wait_key, TRUE AS is_open, ms AS created_at_ms, CAST(NULL AS BIGINT) AS waited_ms FROM x WHERE event_name = 'wait.created' UNION ALL SELECT invocation_id, wait_key, FALSE, since, ms - since FROM x WHERE event_name = 'wait.resumed' AND since IS NOT NULL""")
def m8_waits_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, stream, bundles = journal(spark, sf_dir, repeats=True)
    return ran(M.waits_open(stream, timers=False, bundles=bundles), base).drop("batch_id")
