"""The registered queries of the corpus operators: each applies one to its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import alignment, chat, fingerprints, infilling, langid, lines, ngram_join, packing, pieces, quality, simhash, substrings, warc
from searchloom.llm._shared import new_path, small_batches, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(turns.select("conv_id", "turn", "role", "text").union(extra)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.withColumnRenamed("component", "component_id")


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_table(spark, sf_dir, "documents")).drop("classes", "common", "divergence")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "fit")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    ids_text = F.array_join("ids", " ")
    same = F.translate(F.coalesce("text", F.lit("")), pieces.BLANK, " ") == F.col("decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(ids_text.cast("binary")).alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("same"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = _table(spark, sf_dir, "pages")
    warc.write_archives(warc.resolve_revisits(pages), path)
    kind = pages.schema["page_id"].dataType
    found = warc.with_payload_size(warc.read_archives(spark, path))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), k=4, most=4).withColumnRenamed("component", "component_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), unit="line", seed=7, fim_percent=100, spm_percent=50)
    back = infilling.restored(F.col("fim_text"), F.col("form"))
    return found.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), public_tokenizers.path
    rows = alignment.align(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), with_ids=False)
    with small_batches(spark):
        rows = stage(rows.withColumn("groups", alignment.digest(F.col("groups"))).withColumnRenamed("groups", "groups_sha256"), "aligned")
    counts = stage(alignment.link_counts(rows), "link-counts")
    found = alignment.score_links(rows.withColumn("n_links", F.size("links").cast("long")), counts)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_fingerprints, op2_chat_formatting, op3_ngram_jaccard, op4_quality_divergence, op5_language_id, op6_sentencepiece, op7_substring_dedup, op8_line_dedup, op9_packing, op10_warc, op11_simhash, op12_fill_in_middle, op13_alignment]
    return {f.__name__: f for f in found}
