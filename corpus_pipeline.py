"""A corpus pipeline in four stages: language identification, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet in the
shared folder and gives the next one the table read back. All but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import held_out, table, written
from tracelake.llm.decontam import leaks
from tracelake.llm.langid import UNKNOWN, identify, learn, least_scores
from tracelake.llm.packing import pack
from tracelake.llm.queries import words
from tracelake.llm.simhash import one_of_each

#: Documents below this share of rank agreement with every language are rejected, whatever the labelled documents score.
LEAST_SCORE = 0.05
#: Word fingerprints of a document, for candidates; with eight, nearly all pairs at a five-word similarity of 0.8 are candidates.
WORD_PRINTS = 8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose n-grams agree with no learned language as its labelled documents
    of the same length do."""
    train = ~held_out("doc_id", 4, 2)
    told = written(identify(docs, learn(docs, train), keep=docs.columns, lang="_lang_pred", score="_lang_score"), "told")
    least = least_scores(told, train, LEAST_SCORE, lang="_lang_pred", score="_lang_score")
    return told.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= least)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (the smallest id; a null one where there is no other): texts whose
    five-word shingles agree to 0.8, each link checked, and what such links reach."""
    return one_of_each(docs, prints=WORD_PRINTS)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    found = written(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, words())


STAGES = [("language", known_language), ("near_duplicates", one_of_each_group), ("benchmark", no_leaks), ("packing", length_buckets)]
#: SQL can't express SimHash components, profiles or edit distances of windows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
