"""Token counts by a digest cache (operator 3)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty, written
from .token_chunks import PieceCounter, file_digest

#: Digests that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 400_000


def count_tokens(docs: DataFrame, model: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row of `docs`, by a sentencepiece model, with counts kept in the table at `cache`.

    The cache holds (digest, version, n_tokens): SHA-256 of the normalised text and of the model file. Normalising turns
    null into the empty text and nothing else, as anything more could change a count. Digests are joined to the stored
    counts; of each distinct missing digest one row is encoded, and its count is appended. A cache that does not exist
    is begun. Shuffled are digests and ids, and one text of each digest that several rows have. As long as the digests
    that several rows have or that are stored fit a broadcast of BROADCAST_DIGESTS rows, that is all; beyond it the texts
    are shuffled to them, once.

    Nulls and empty texts have 0 bytes. Repeated rows give a row each. An empty table gives no rows and appends none.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    version = file_digest(model)
    text = text_or_empty(text_col)
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))

    def stored() -> DataFrame:
        return spark.read.schema("digest binary, version string, n_tokens long").parquet(cache).filter(F.col("version") == version)

    spark.createDataFrame([], "digest binary, version string, n_tokens long").write.mode("append").parquet(cache)
    known = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    seen = docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).join(known, "digest", "left")
    # What a row can't tell by itself: its text is stored already, or another row may stand for it.
    special = written(seen.filter((F.col("n") > 1) | F.col("n_tokens").isNotNull()).select(F.col("digest").alias("d"), "first", F.col("n_tokens").isNotNull().alias("is_stored")), "special")
    side = F.broadcast(special) if special.count() <= BROADCAST_DIGESTS else special
    marked = docs.join(side, F.col("digest") == F.col("d"), "left")
    # Rows that repeat under one id too are few texts, one of each digest.
    again = marked.filter(~F.col("is_stored") & F.col("id").eqNullSafe(F.col("first"))).select("digest", "text").dropDuplicates(["digest"])
    misses = marked.filter("d IS NULL").select("digest", "text").union(again)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = PieceCounter.of(model)
        counts = [counter.count(x) for x in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    map_arrow(misses, encode, "digest binary, version string, n_tokens long").write.mode("append").option("compression", "zstd").parquet(cache)
    counts = written(stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    slim = docs.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return slim.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
