"""Streaming appends to a journal of several tables (inventory M3 with A4, A5 and A7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ingest
from ..schemas import TABLES
from ..sources.store import TableStore

#: What a runtime event tells of its invocation, beside the journal's own columns.
FOLD = "state string, execution_mode string, result_json string, error_json string"
_KEY = "journal string, invocation_id string, sequence bigint"
SCHEMAS = {
    **{t: TABLES[t] for t in ("runtime_events", "user_events")},
    "invocations": f"{TABLES['invocations']}, state_sequence bigint, commit bigint",
    "sessions": f"{TABLES['sessions']}, commit bigint",
    "keys": f"{_KEY}, digest binary",
    "heads": "journal string, invocation_id string, top bigint",
    "conflicts": f"{_KEY}, row_json string, batch_id bigint",
    "unknown": f"{_KEY}, row_json string, batch_id bigint",
}
FIELDS = {"runtime_events": ingest.EVENT_FIELDS, "user_events": ingest.USER_EVENT_FIELDS}


def journal_store(spark: SparkSession, path: str) -> TableStore:
    """The journal's tables as one store: events by day, the newest row of each invocation and session, the keys of what is
    stored with a digest of each row, each invocation's greatest sequence, and what could not be taken."""
    newest = {t: (("id",), "commit") for t in ("invocations", "sessions")} | {"heads": (("journal", "invocation_id"), "top")}
    return TableStore(spark, path, SCHEMAS, newest, {"runtime_events": "occurred_at_ms", "user_events": "occurred_at_ms"})


def admit(store: TableStore, invocations: DataFrame, sessions: DataFrame) -> None:
    """The first commit: invocations and sessions that events may name."""
    store.commit(0, {"invocations": invocations.withColumn("state_sequence", F.lit(0).cast("long")).withColumn("commit", F.lit(0).cast("long")), "sessions": sessions.withColumn("commit", F.lit(0).cast("long"))})


def items(runtime_events: DataFrame, user_events: DataFrame | None = None) -> DataFrame:
    """Both journals' events as one stream, for stream_commits(): with `journal`, and the FOLD columns where they have them."""
    more = [c.split() for c in f"{FOLD}, {TABLES['user_events']}".split(", ")]
    rows = runtime_events.withColumn("journal", F.lit("runtime_events"))
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in more if c not in rows.columns})
    return rows if user_events is None else rows.unionByName(user_events.withColumn("journal", F.lit("user_events")), allowMissingColumns=True)


def _digest(journal: str) -> Column:
    """Of the fields that decide whether two rows of a key are the same; nulls differ from empty texts."""
    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*FIELDS[journal]), {"ignoreNullFields": "false"}), 256), 1, 32))


def classify(store: TableStore, batch: DataFrame, manifest: dict) -> DataFrame:
    """batch with `verdict`: new, duplicate, conflict or unknown (its invocation isn't admitted).

    Rows above their invocation's greatest stored sequence are new without a look at anything else. The others meet the
    stored keys of their invocations, at any distance in time: no part of the journal itself is read. In the batch the
    first row of a key, in the order of its fields, stands for it.
    """
    key = ["journal", "invocation_id", "sequence"]
    whole = F.when(F.col("journal") == "user_events", _digest("user_events")).otherwise(_digest("runtime_events"))
    order = [F.col(c) for c in dict.fromkeys((*FIELDS["runtime_events"], *FIELDS["user_events"])) if c in batch.columns]
    own = W.partitionBy(*key).orderBy(*order)
    rows = batch.withColumn("digest", whole).withColumns({"_n": F.row_number().over(own), "_first": F.first("digest").over(own)})
    heads, ids = store.read("heads", manifest), batch.select("invocation_id").distinct()
    rows = rows.join(heads.join(ids, "invocation_id", "left_semi"), ["journal", "invocation_id"], "left")
    old = rows.filter(F.col("sequence") <= F.col("top")).select("invocation_id").distinct()
    stored = store.read("keys", manifest, lambda df: df.join(F.broadcast(old) if old.count() <= 100_000 else old, "invocation_id", "left_semi"))
    rows = rows.join(stored.select(*key, F.col("digest").alias("_stored")), key, "left")
    admitted = store.read("invocations", manifest).select(F.col("id").alias("invocation_id"), F.lit(True).alias("_known"))
    rows = rows.join(admitted, "invocation_id", "left")
    against = F.coalesce("_stored", F.when(F.col("_n") > 1, F.col("_first")))
    verdict = F.when(F.col("_known").isNull(), "unknown").when(against.isNull(), "new").when(against == F.col("digest"), "duplicate").otherwise("conflict")
    return rows.withColumn("verdict", verdict).drop("_n", "_first", "_stored", "_known", "top")


def commit_batch(store: TableStore, batch: DataFrame, batch_id: int) -> bool:
    """A4, A5 and A7 of one batch as one commit; False if it is there already. Batches are numbered from 1, after admit()."""
    manifest = store.manifest()
    if batch_id <= manifest["batch_id"]:
        return False
    rows = classify(store, batch, manifest).persist()
    try:
        new = rows.filter("verdict = 'new'")
        said = lambda v: rows.filter(F.col("verdict") == v).select("journal", "invocation_id", "sequence", F.to_json(F.struct(*batch.columns)).alias("row_json"), F.lit(batch_id).cast("long").alias("batch_id"))
        fresh = new.filter("journal = 'runtime_events'")
        touched = store.read("invocations", manifest, lambda df: df.join(fresh.select(F.col("invocation_id").alias("id")).distinct(), "id", "left_semi"))
        folded = ingest.fold_events(touched, fresh).withColumn("commit", F.lit(batch_id).cast("long")).persist()
        owners = store.read("sessions", manifest, lambda df: df.join(folded.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi"))
        changes = {
            "runtime_events": fresh,
            "user_events": new.filter("journal = 'user_events'"),
            "keys": new,
            "heads": new.groupBy("journal", "invocation_id").agg(F.max("sequence").alias("top")),
            "invocations": folded,
            "sessions": ingest.fold_sessions(owners, folded).withColumn("commit", F.lit(batch_id).cast("long")),
            "conflicts": said("conflict"),
            "unknown": said("unknown"),
        }
        counts = {r.k: r.n for r in rows.groupBy(F.concat_ws(" ", "verdict", "journal").alias("k")).agg(F.count("*").alias("n")).collect()}
        some = lambda *names: any(k in counts for k in names)
        both = ("new runtime_events", "new user_events")
        needed = {"runtime_events": both[:1], "user_events": both[1:], "keys": both, "heads": both, "invocations": both[:1], "sessions": both[:1], "conflicts": ("conflict runtime_events", "conflict user_events"), "unknown": ("unknown runtime_events", "unknown user_events")}
        done = store.commit(batch_id, {t: df for t, df in changes.items() if some(*needed[t])})
        folded.unpersist()
        return done
    finally:
        rows.unpersist()


def stream_commits(rows: DataFrame, store: TableStore, checkpoint: str):
    """M3: a writer that commits each micro-batch of items() to the store: new events of both journals, the fold of invocations
    and sessions, conflicts and unknown invocations, all or nothing. A batch that was killed between two tables and runs
    again gives the same tables, as does the whole stream once more (its rows are duplicates then)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                commit_batch(store, batch, batch_id + 1)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
