"""Tables that change together: each batch is one commit of several tables.

A table is a list of folders of Parquet files. A commit writes new folders, named by the batch, and then one manifest
that lists every table's folders. Readers follow the newest manifest, so they see all of a batch or nothing of it, and
a batch that died half-way is written again over its own folders. Sixteen folders of a level become one of the next.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of one level that a table has at most before they are merged.
FAN = 16


class TableStore:
    """Tables under a path of any Hadoop file system. schemas: {table: DDL}; keys: {table: (key columns, order column)} of the
    tables whose newest row of a key counts; days: {table: column of milliseconds} of those laid out by day."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], keys: dict[str, tuple[tuple[str, ...], str]] | None = None, days: dict[str, str] | None = None) -> None:
        self.spark, self.path, self.schemas, self.keys, self.days = spark, path.rstrip("/"), schemas, keys or {}, days or {}
        self.jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jvm_path(f"{self.path}/_manifest").getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest one: {version, batch_id, tables: {name: [[level, folder], ...]}}."""
        folder = self.jvm_path(f"{self.path}/_manifest")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        newest = max((n for n in names if n.endswith(".json")), default=None)
        if newest is None:
            return {"version": 0, "batch_id": -1, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_manifest/{newest}", wholetext=True).first()[0])

    def read(self, table: str, manifest: dict | None = None, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """A table as of a manifest (the newest if not given). `rows` filters its stored rows before the newest of a key is
        chosen: it must keep or drop a key's rows together."""
        folders = [f for _, f in (manifest or self.manifest())["tables"].get(table, [])]
        return self._newest(table, rows(self._stored(table, folders)))

    def _stored(self, table: str, folders: list[str]) -> DataFrame:
        schema = self.schemas[table] + (", event_date date" if table in self.days else "")
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def _newest(self, table: str, rows: DataFrame) -> DataFrame:
        columns = [c.split()[0] for c in self.schemas[table].split(", ")]
        if table in self.keys:
            key, order = self.keys[table]
            rows = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select("_r.*")
        return rows.select(*columns)

    def _write(self, table: str, rows: DataFrame, folder: str) -> None:
        columns = [c.split()[0] for c in self.schemas[table].split(", ")]
        rows = rows.select(*columns)
        if table in self.days:
            rows = rows.withColumn("event_date", F.to_date(F.timestamp_millis(self.days[table])))
            rows.repartition("event_date").sortWithinPartitions("event_date", *columns[1:3]).write.mode("overwrite").partitionBy("event_date").parquet(f"{self.path}/{folder}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def commit(self, batch_id: int, changes: dict[str, DataFrame]) -> bool:
        """Adds rows to tables as one step; False if the batch is there already. The batch's manifest is made by a rename
        that fails where there is one, so of two writers one gets an error."""
        now = self.manifest()
        if batch_id <= now["batch_id"]:
            return False
        tables = {k: list(v) for k, v in now["tables"].items()}
        for table, rows in changes.items():
            folder = f"{table}/b={batch_id}"
            self._write(table, rows, folder)
            tables.setdefault(table, []).append([0, folder])
            self._merge(table, tables[table], batch_id)
        self._publish({"version": now["version"] + 1, "batch_id": batch_id, "tables": tables})
        return True

    def _merge(self, table: str, folders: list, batch_id: int) -> None:
        """Merges a level that is full. Old folders stay for readers of older manifests."""
        level = 0
        while len(full := [f for f in folders if f[0] == level]) >= FAN:
            merged = f"{table}/m={batch_id}-{level + 1}"
            self._write(table, self._newest(table, self._stored(table, [f for _, f in full])), merged)
            folders[:] = [f for f in folders if f[0] != level] + [[level + 1, merged]]
            level += 1

    def _publish(self, manifest: dict) -> None:
        name = f"{self.path}/_manifest/{manifest['version']:012d}"
        out = self.fs.create(self.jvm_path(f"{name}.tmp"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.fs.exists(self.jvm_path(f"{name}.json")) or not self.fs.rename(self.jvm_path(f"{name}.tmp"), self.jvm_path(f"{name}.json")):
            raise RuntimeError(f"another writer has made {name}.json")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the manifests but the newest `keep`, and the folders that those don't list."""
        folder = self.jvm_path(f"{self.path}/_manifest")
        names = sorted(n for f in self.fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json"))
        kept = [json.loads(self.spark.read.text(f"{self.path}/_manifest/{n}", wholetext=True).first()[0]) for n in names[-keep:]]
        listed = {f for m in kept for v in m["tables"].values() for _, f in v}
        for table in self.schemas:
            at = self.jvm_path(f"{self.path}/{table}")
            for f in self.fs.listStatus(at) if self.fs.exists(at) else []:
                if f"{table}/{f.getPath().getName()}" not in listed:
                    self.fs.delete(f.getPath(), True)
        for n in names[:-keep]:
            self.fs.delete(self.jvm_path(f"{self.path}/_manifest/{n}"), False)
