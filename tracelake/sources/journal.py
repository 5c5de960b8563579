"""Reading and writing the journal's tables (inventory A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def load_journal(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A1: the journal's tables with their declared schemas, from Parquet folders under a path. Folders of days, as
    write_events makes them, are read whole; load_events reads some of them."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}").select(*_columns(schema)) for name, schema in TABLES.items()}


def load_events(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """A1: the events that write_events has put under `path`, of the days (inclusive, as yyyy-mm-dd). Other days' folders are
    not read."""
    schema = TABLES["runtime_events"]
    events = spark.read.schema(f"{schema}, event_date date").parquet(path)
    if first_day:
        events = events.filter(F.col("event_date") >= F.lit(first_day).cast("date"))
    if last_day:
        events = events.filter(F.col("event_date") <= F.lit(last_day).cast("date"))
    return events.select(*_columns(schema))


#: The column by whose range a database's table is read in parallel; small tables are read whole.
JDBC_RANGES = {"runtime_events": "occurred_at_ms", "user_events": "occurred_at_ms", "invocations": "created_at_ms", "runtime_recovery_states": "updated_at_ms", "artifacts": "created_at_ms", "sessions": "created_at_ms"}


def load_journal_jdbc(spark: SparkSession, url: str, properties: dict[str, str], partitions: int = 32) -> dict[str, DataFrame]:
    """A1: the same tables of a database. Tables that grow are read by `partitions` tasks, each a range of JDBC_RANGES'
    column between its least and greatest value; filters on the result go to the database."""
    out = {}
    for name, schema in TABLES.items():
        more = {}
        if column := JDBC_RANGES.get(name):
            low, high = spark.read.jdbc(url, name, properties=properties).agg(F.min(column), F.max(column)).first()
            if low is not None and high > low:
                more = {"column": column, "lowerBound": low, "upperBound": high + 1, "numPartitions": partitions}
        rows = spark.read.jdbc(url, name, properties=properties, **more)
        out[name] = rows.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))])
    return out


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def write_events(events: DataFrame, path: str) -> None:
    """A1: events appended in folders of their day, sorted by invocation and sequence, so that scans prune both."""
    dated = events.withColumn("event_date", F.to_date(F.timestamp_millis("occurred_at_ms")))
    dated.repartition("event_date", "invocation_id").sortWithinPartitions("event_date", "invocation_id", "sequence").write.mode("append").partitionBy("event_date").parquet(path)
