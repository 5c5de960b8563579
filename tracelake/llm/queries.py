"""Registered queries of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, prefix_trie, word_bpe
from .common import held_out, new_path, table
from .decontam import leaks
from .langid import identify, learn
from .lattice import score
from .media import store_and_tile
from .packing import pack
from .sharding import shuffle_into_shards
from .simhash import near_duplicates
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .warc import page_captures, write_archives


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def words(col: str = "text"):
    """Number of words between white space (space, bytes 9 to 13)."""
    return F.regexp_count(F.coalesce(F.col(col), F.lit("")), F.lit(r"[^ \x09-\x0D]+"))


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return page_captures(spark, path)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), new_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = store_and_tile(table(spark, sf_dir, "documents"))
    return tiles.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), words())


def op6_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, ~held_out("doc_id", 5, 1), tokenizer("piece_bpe_32k.model"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), new_path(spark, "token-files"), end_id=2)
    return read_token_files(manifest).withColumnRenamed("id", "doc_id")


def op9_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs, ~held_out("doc_id", 4, 2))
    return identify(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), profiles, keep=["doc_id", "held_out"])


def op10_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 1
    shards = shuffle_into_shards(table(spark, sf_dir, "documents"), new_path(spark, "shards"), 16, size("text"))
    *_, shard, slot = shards.columns
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return shards.select("doc_id", size("text").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.digests(conversations.repair(damaged, times=F.col("times")))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer("word_bpe_49k.json")
    coded = word_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return word_bpe.decode(coded, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversations(table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (op1_warc_transactions, op2_benchmark_leaks, op3_token_counts, op4_media_tiles, op5_length_buckets, op6_subword_lattice, op7_simhash_components, op8_token_files, op9_language_profiles, op10_two_pass_shuffle, op11_conversation_repair, op12_word_bpe, op13_prefix_trie)
}

ORACLE_SQL = {
    "op1_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
}
