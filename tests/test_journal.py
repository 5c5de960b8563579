"""A journal written and read back."""

from tracelake.schemas import TABLES
from tracelake.sources.adapters import runtime_events
from tracelake.sources.journal import load_events, load_journal, load_journal_jdbc, write_events


def test_round_trip(spark, tmp_path):
    for name, schema in TABLES.items():
        if name != "runtime_events":
            spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    events = runtime_events(spark, "/root/testdata/sf0.001")
    write_events(events, f"{tmp_path}/runtime_events")
    back = load_journal(spark, str(tmp_path))
    assert back["runtime_events"].columns == events.columns
    assert set(back) == set(TABLES) and back["runtime_events"].exceptAll(events.select(*back["runtime_events"].columns)).count() == 0
    assert back["runtime_events"].count() == events.count()


def test_days_are_pruned(spark, tmp_path):
    events = runtime_events(spark, "/root/testdata/sf0.001")
    write_events(events, f"{tmp_path}/e")
    days = sorted(r.event_date for r in spark.read.parquet(f"{tmp_path}/e").select("event_date").distinct().collect())
    some = load_events(spark, f"{tmp_path}/e", str(days[1]), str(days[1]))
    assert some.columns == events.columns
    assert some.count() == spark.read.parquet(f"{tmp_path}/e/event_date={days[1]}").count() < events.count()
    assert "PartitionFilters: [isnotnull(event_date" in some._jdf.queryExecution().toString()
    assert load_events(spark, f"{tmp_path}/e").count() == events.count()


def test_a_database_is_read_in_ranges(spark, tmp_path):
    url, properties = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    events = runtime_events(spark, "/root/testdata/sf0.001")
    for name, schema in TABLES.items():
        rows = events if name == "runtime_events" else spark.createDataFrame([], schema)
        rows.coalesce(1).write.jdbc(url, name, properties=properties)
    back = load_journal_jdbc(spark, url, properties, partitions=3)
    assert set(back) == set(TABLES) and all(df.columns == [c.split()[0] for c in TABLES[n].split(", ")] for n, df in back.items())
    assert back["runtime_events"].rdd.getNumPartitions() == 3
    assert back["runtime_events"].count() == events.count() and back["runtime_events"].exceptAll(events).count() == 0
    one = back["runtime_events"].filter("sequence = 2")
    assert "PushedFilters: [*IsNotNull(sequence), *EqualTo(sequence,2)]" in one._jdf.queryExecution().toString() and one.count() == events.filter("sequence = 2").count()
