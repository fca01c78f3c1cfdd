"""A training-corpus pipeline over `documents`: each stage is a Spark job whose result is written and read again.

Language ID drops what it rejects, line dedup drops lines of ten and more documents, the n-gram join keeps one of each
group of near copies, substring dedup cuts repeated passages, and packing lays the rest out in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import langid, lines, ngram_join, packing, substrings
from searchloom.llm._shared import Scratch, bound_batches, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: How much less likely than usual n-grams may be (mean log probability) in a text of FIT_CHARS code points or more.
LEAST_FIT, FIT_CHARS = -2.6, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a language that the labels teach. A text without letters, with a posterior under 0.5, or whose
    n-grams are unlike that language's own is rejected: texts in other languages, and junk."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)
    alike = (F.length("text") < FIT_CHARS) | (F.col("fit") >= LEAST_FIT)
    return langid.predict(docs, model).where(known & alike).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of ten and more documents; a document stays, with what is left of its text."""
    found = lines.drop_frequent_lines(docs.select(*COLUMNS), min_docs=10)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of texts linked at 0.8 of their five-word shingles, the row of the smallest doc_id.

    A missing id comes last, rows that share an id are told apart by what they hold, and of equal rows with words one stays.
    """
    docs = docs.select(*COLUMNS)
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(*COLUMNS).alias("row"))
    ranked = docs.withColumn("rank", rank)
    groups = stage(ngram_join.jaccard_groups(ranked, "rank", k=5, num=80, den=100), "near-groups")
    dropped = groups.where(F.col("rank") != F.col("component")).select("rank")
    twice = groups.where((F.col("rank") == F.col("component")) & (F.col("n_shingles") > 0)).groupBy("rank").count().where("count > 1").select("rank")
    if twice.isEmpty():
        return ranked.join(dropped, "rank", "left_anti").select(*COLUMNS)
    once = ranked.join(twice, "rank", "left_semi").dropDuplicates(["rank"])
    return ranked.join(dropped.union(twice), "rank", "left_anti").union(once).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in 20-word windows that start earlier too; a text that loses none keeps its white space."""
    found = substrings.drop_repeats(docs.select(*COLUMNS), window=20)
    found = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 ids: one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


def bounded(step):
    """The step with Arrow batches of a few megabytes. Its result is read later, so the session keeps that bound: else workers,
    which serve all stages, and their executors hold on to what batches of 10,000 texts took."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return step(spark, docs, sf_dir)

    return run


STAGES = [(s.__name__ if s is not pack else "packing", bounded(s)) for s in (language_id, line_dedup, near_dedup, substring_dedup, pack)]

#: The tokenizer of the last stage and the classifier of the first can't be put in SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what no later stage reads is dropped."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, step in STAGES[:-1]:
        docs = scratch.stage(step(spark, docs, sf_dir), name)
        scratch.close(name)
    docs = STAGES[-1][1](spark, docs, sf_dir)  # reads tables of its own
    scratch.close()
    return docs
