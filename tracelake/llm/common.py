"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: space and bytes 9 to 13.
SPACE = r"[ \x09-\x0D]+"
#: Text bytes that a numpy helper handles at once.
CHUNK_BYTES = 1 << 21
_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; an own temporary one only in a local session that sets none."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-tracelake-"))
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unclashed(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == rest


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about `most` text bytes each, with the UTF-8 bytes and the offsets of their rows. Null is empty. One row is never cut."""
    col = batch.column(column).cast(pa.large_binary())
    col = pa.array(col.fill_null(b"")) if col.null_count else col
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def map_arrow(df: DataFrame, f, schema: str | T.StructType) -> DataFrame:
    """mapInArrow of a function from a batch to a batch or table."""

    def run(batches):
        for b in batches:
            out = f(b)
            yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)


def offsets(counts: DataFrame, key: str, n: str, within: str | None = None, block: int = 4096) -> DataFrame:
    """counts with the column `start`: the sum of n over all smaller keys (long, unique; inside equal `within`).

    Two levels: sums of blocks of keys first, so that one task orders only the blocks, and each other task one block.
    """
    from pyspark.sql import Window as W

    part = [within] if within else [F.lit(0)]
    blocked = counts.withColumn("_b", F.floor(F.col(key) / block))
    sums = blocked.groupBy(*([within] if within else []), "_b").agg(F.sum(n).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("_n")
    inside = blocked.withColumn("_in", F.coalesce(F.sum(n).over(W.partitionBy(*([within] if within else []), "_b").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return inside.join(before, [*([within] if within else []), "_b"]).withColumn("start", F.col("_before") + F.col("_in")).drop("_b", "_before", "_in")
