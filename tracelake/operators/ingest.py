"""Idempotent ingest of journal batches (inventory A2-A8, B4-B6, C10-C13, I6, I7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import ACTIVE_INVOCATION, DELTA_TYPES, TERMINAL_NODE

#: The fields that decide whether two events of one key are the same event.
EVENT_FIELDS = ("id", "schema_version", "event_type", "event_name", "subject_type", "subject_id", "occurred_at_ms", "elapsed_ns", "status", "timing_json", "payload_json", "input_json", "output_json", "operations_json")
USER_EVENT_FIELDS = ("id", "session_id", "schema_version", "type", "data_json", "node_id", "workflow_path_json", "node_execution_id", "operator_call_id", "occurred_at_ms")


def upsert_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A2: by (workflow_id, definition_hash): the first id and creation stay, all else is overwritten. Of several rows of
    a key in a batch the last by creation and id counts."""
    key = ["workflow_id", "definition_hash"]
    batch = incoming.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("created_at_ms"), F.desc("id")))).filter("_n = 1").drop("_n")
    o, n = existing.alias("o"), batch.alias("n")
    rows = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in (*key, "id", "created_at_ms") else F.when(F.col("n.id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return rows.select(*[pick(c).alias(c) for c in existing.columns])


def admit(sessions: DataFrame, invocations: DataFrame, new_sessions: DataFrame, new_invocations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A3: (sessions, invocations, recovery states): sessions are overwritten by id, invocations only added. Genesis
    states are kept for full mode only; all but minimal invocations that are new get a recovery state at sequence 0."""
    merged = new_sessions.unionByName(sessions.join(new_sessions, "id", "left_anti"))
    fresh = new_invocations.join(invocations, "id", "left_anti").dropDuplicates(["id"])
    recovery = fresh.filter("event_mode <> 'minimal'").select(F.col("id").alias("invocation_id"), F.lit(0).cast("long").alias("event_sequence"), F.coalesce("genesis_state_json", F.lit("{}")).alias("state_json"), F.col("created_at_ms").alias("updated_at_ms"))
    added = fresh.withColumn("genesis_state_json", F.when(F.col("event_mode") == "full", F.col("genesis_state_json")))
    return merged, invocations.unionByName(added), recovery


def append(journal: DataFrame, batch: DataFrame, fields: tuple[str, ...] = EVENT_FIELDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A4, A5: (new, duplicates, conflicts) of a batch by (invocation_id, sequence).

    Rows of a key are compared in `fields`, nulls being equal. In the batch itself the first row of a key in the order of
    its fields stands for it, and its other rows are duplicates of it or conflicts with it.
    """
    key = ["invocation_id", "sequence"]
    whole = F.struct(*fields)
    first = F.first(whole).over(W.partitionBy(*key).orderBy(whole))
    n = F.row_number().over(W.partitionBy(*key).orderBy(whole))
    numbered = batch.withColumn("_first", first).withColumn("_n", n)
    stored = journal.join(batch.select("invocation_id").distinct(), "invocation_id", "left_semi").select(*key, whole.alias("_stored"))
    seen = numbered.join(stored, key, "left").withColumn("_against", F.coalesce("_stored", F.when(F.col("_n") > 1, F.col("_first"))))
    clean = lambda df: df.select(*batch.columns)
    new = clean(seen.filter(F.col("_against").isNull()))
    old = seen.filter(F.col("_against").isNotNull()).withColumn("_same", whole.eqNullSafe(F.col("_against")))
    return new, clean(old.filter("_same")), clean(old.filter("NOT _same"))


def append_artifacts(artifacts: DataFrame, batch: DataFrame) -> DataFrame:
    """Artifacts with ids that aren't stored yet, one each."""
    return batch.dropDuplicates(["id"]).join(artifacts.select("id"), "id", "left_anti")


def fold_events(invocations: DataFrame, batch: DataFrame) -> DataFrame:
    """Each invocation's state, mode, result, error and times from its last event in the batch (invocation_id, sequence,
    state, occurred_at_ms; execution_mode, result_json and error_json if the batch has them). A null state or mode leaves
    the old one; result and error are the last event's, null or not, wherever it tells a state. The durable sequence
    never goes back. Batches are taken in order, unless invocations has the column state_sequence: then an event older than
    the one that told the stored state changes nothing, and batches may come in any order."""
    told = F.when(F.col("state").isNotNull(), F.col("sequence"))
    own = [c for c in ("result_json", "error_json") if c in batch.columns]
    mode = [F.max_by("execution_mode", F.when(F.col("execution_mode").isNotNull(), F.col("sequence"))).alias("_execution_mode")] if "execution_mode" in batch.columns else []
    last = batch.groupBy("invocation_id").agg(F.max("sequence").alias("_seq"), F.max_by(F.struct("state", *own, "sequence"), told).alias("_told"), F.max_by("occurred_at_ms", "sequence").alias("_at"), *mode)
    rows = invocations.join(last, invocations["id"] == last["invocation_id"], "left").drop("invocation_id")
    if "state_sequence" in invocations.columns:
        newer = F.coalesce(F.col("_told.sequence") > F.coalesce("state_sequence", F.lit(0)), F.lit(False))
        rows = rows.withColumn("_told", F.when(newer, F.col("_told"))).withColumn("_at", F.when(F.col("_seq") > F.col("durable_sequence"), F.col("_at")))
    changed = {"state": F.coalesce("_told.state", "state"), "durable_sequence": F.greatest("durable_sequence", "_seq"), "updated_at_ms": F.coalesce("_at", "updated_at_ms")}
    changed |= {c: F.when(F.col("_told").isNotNull(), F.col(f"_told.{c}")).otherwise(F.col(c)) for c in own}
    changed |= {"state_sequence": F.coalesce("_told.sequence", "state_sequence")} if "state_sequence" in invocations.columns else {}
    changed |= {"execution_mode": F.coalesce("_execution_mode", "execution_mode")} if mode else {}
    return rows.withColumns(changed).select(*invocations.columns)


def fold_sessions(sessions: DataFrame, invocations: DataFrame) -> DataFrame:
    """Sessions are as new as their newest invocation."""
    last = invocations.groupBy("session_id").agg(F.max("updated_at_ms").alias("_at"))
    rows = sessions.join(last, sessions["id"] == last["session_id"], "left").drop("session_id")
    return rows.withColumn("updated_at_ms", F.greatest("updated_at_ms", "_at")).drop("_at")


def apply_invocation_states(invocations: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invocations, errors): the newest summary row of each invocation overwrites its state, input, result, error and
    time; summaries of unknown invocations are errors. batch (id, sequence, and those columns)."""
    values = ("state", "input_json", "result_json", "error_json", "updated_at_ms")
    last = batch.groupBy("id").agg(F.max_by(F.struct(*values), "sequence").alias("_v"))
    rows = invocations.join(last, "id", "left")
    for c in values:
        rows = rows.withColumn(c, F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)))
    return rows.drop("_v"), last.join(invocations.select("id"), "id", "left_anti").select("id", F.lit("invocation_not_admitted").alias("error"))


def project_mode(events: DataFrame, mode: str) -> DataFrame:
    """A full journal as `standard` (no phases, no values) or `minimal` (no events), with contiguous sequences."""
    if mode == "full":
        return events
    if mode == "minimal":
        return events.filter(F.lit(False))
    rows = events.filter(F.col("event_type") != "phase")
    for c in ("input_json", "output_json", "operations_json"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.withColumn("sequence", F.row_number().over(W.partitionBy("invocation_id").orderBy("sequence")).cast("long"))


def is_recovery_point(kind: Column, name: Column, status: Column) -> Column:
    """Whether an event forces a checkpoint in standard mode."""
    return (kind == "recovery") | (name == "wait.created") | (name.startswith("node.") & status.isin(*TERMINAL_NODE)) | (name == "invocation.running")


def recovery_points(events: DataFrame) -> DataFrame:
    """B5"""
    return events.filter(is_recovery_point(F.col("event_type"), F.col("event_name"), F.col("status")))


def durable_user_events(user_events: DataFrame) -> DataFrame:
    """Without the delta types; the sequences keep their gaps."""
    return user_events.filter(~F.col("type").isin(*DELTA_TYPES))


def orphan_events(events: DataFrame, invocations: DataFrame) -> DataFrame:
    """Events of unknown invocations."""
    return events.join(invocations.select(F.col("id").alias("invocation_id")), "invocation_id", "left_anti")


def revision_mismatches(sessions: DataFrame, invocations: DataFrame, versions: DataFrame) -> DataFrame:
    """Invocations without a session or version row, or whose version differs from the session's."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("workflow_revision_id").alias("_rev"), F.lit(True).alias("_s"))
    v = versions.select(F.col("id").alias("workflow_version_id"), F.lit(True).alias("_v"))
    rows = invocations.join(s, "session_id", "left").join(v, "workflow_version_id", "left")
    problem = F.when(F.col("_s").isNull(), "no_session").when(F.col("_v").isNull(), "no_version").when(~F.col("_rev").eqNullSafe(F.col("workflow_version_id")), "mismatch")
    return rows.select("id", "session_id", "workflow_version_id", problem.alias("problem")).filter("problem IS NOT NULL")


def admission_conflicts(sessions: DataFrame, invocations: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, session_id, revision_id) with `verdict`: busy, revision_mismatch or accepted. An unknown session is accepted."""
    current = invocations.select(F.col("id").alias("current_invocation_id"), "state")
    s = sessions.select(F.col("id").alias("session_id"), "workflow_revision_id", "current_invocation_id").join(current, "current_invocation_id", "left")
    rows = requests.join(s, "session_id", "left")
    verdict = F.when(F.col("workflow_revision_id") != F.col("revision_id"), "revision_mismatch").when(F.col("state").isin(*ACTIVE_INVOCATION), "busy").otherwise("accepted")
    return rows.select("request_id", "session_id", verdict.alias("verdict"))


def match_resumes(sessions: DataFrame, invocations: DataFrame, waits: DataFrame, responses: DataFrame) -> DataFrame:
    """C11: responses (response_id, revision_id, session_key, wait_key) with the first verdict that applies."""
    known = sessions.groupBy("session_key").agg(F.first("session_key").alias("_any"))
    s = sessions.select(F.col("workflow_revision_id").alias("revision_id"), "session_key", "current_invocation_id", F.lit(True).alias("_s"))
    i = invocations.select(F.col("id").alias("current_invocation_id"), "state", "workflow_version_id", F.lit(True).alias("_i"))
    w = waits.select(F.col("invocation_id").alias("current_invocation_id"), "wait_key", F.lit(True).alias("_w"))
    rows = responses.join(s, ["revision_id", "session_key"], "left").join(known, "session_key", "left").join(i, "current_invocation_id", "left").join(w, ["current_invocation_id", "wait_key"], "left")
    verdict = (
        F.when(F.col("_s").isNull(), "unknown_session")
        .when(F.col("_i").isNull(), "no_current_invocation")
        .when(F.col("state").isin("created", "running"), "busy")
        .when(F.col("state") != "waiting", "not_waiting")
        .when(F.col("workflow_version_id") != F.col("revision_id"), "other_definition")
        .when(F.col("_w").isNull(), "unknown_wait_key")
        .otherwise("ok")
    )
    return rows.select("response_id", verdict.alias("verdict"))


def externalize(df: DataFrame, owner: str, value: str, limit: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(rows with large values replaced by a reference, artifacts): values over `limit` UTF-8 bytes become one
    artifact for each (owner, SHA-256). The digest is shuffled before the values are."""
    large = F.octet_length(value) > limit
    rows = df.withColumn("_sha", F.when(large, F.sha2(F.col(value), 256)))
    artifacts = rows.filter("_sha IS NOT NULL").groupBy(owner, F.col("_sha").alias("sha256")).agg(F.first(value).alias("payload"), F.octet_length(F.first(value)).cast("long").alias("size_bytes"), F.count("*").alias("uses"))
    reference = F.concat(F.lit('{"$artifact":"'), F.col("_sha"), F.lit('"}'))
    return rows.withColumn(value, F.when(F.col("_sha").isNotNull(), reference).otherwise(F.col(value))).drop("_sha"), artifacts


def advance_checkpoints(recovery: DataFrame, events: DataFrame, interval: int = 200) -> DataFrame:
    """The sequence that each invocation's checkpoint moves to: the newest recovery point of the batch, or its last
    event once that is `interval` ahead of the stored checkpoint."""
    point = is_recovery_point(F.col("event_type"), F.col("event_name"), F.col("status"))
    last = events.groupBy("invocation_id").agg(F.max(F.when(point, F.col("sequence"))).alias("_point"), F.max("sequence").alias("_last"))
    rows = last.join(recovery.select("invocation_id", "event_sequence"), "invocation_id", "left")
    base = F.coalesce("event_sequence", F.lit(0))
    to = F.when(F.col("_point") > base, F.col("_point")).when(F.col("_last") - base >= interval, F.col("_last"))
    reason = F.when(F.col("_point") > base, "recovery_point").otherwise("interval")
    return rows.select("invocation_id", base.alias("from_sequence"), to.alias("to_sequence"), reason.alias("reason")).filter("to_sequence IS NOT NULL")


