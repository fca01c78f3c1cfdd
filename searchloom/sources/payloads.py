"""Payloads of other systems as tables: inspections, sitemaps, answers; and what is written for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Coverage states that count as indexed.
INDEXED = ("Submitted and indexed", "Indexed, not submitted in sitemap")
RICH_CHARS, RAW_CHARS, DETAIL_CHARS = 4000, 8000, 2000


def inspections(payloads: DataFrame, checked_at) -> DataFrame:
    """Index status rows of payloads(url, payload JSON); what is missing is null, a missing state is empty."""
    of = lambda path: F.get_json_object("payload", f"$.inspectionResult.{path}")
    names = {"verdict": "verdict", "robots_state": "robotsTxtState", "canonical_user": "userCanonical", "canonical_google": "googleCanonical", "last_crawl_time": "lastCrawlTime"}
    state = F.coalesce(of("indexStatusResult.coverageState"), F.lit(""))
    rich = F.substring(F.coalesce(of("richResultsResult.detectedItems"), F.lit("[]")), 1, RICH_CHARS)
    raw = F.substring(F.coalesce(of("indexStatusResult"), F.lit("{}")), 1, RAW_CHARS)
    fields = [of(f"indexStatusResult.{source}").alias(name) for name, source in names.items()]
    return payloads.select("url", F.lit(checked_at).alias("checked_at"), state.alias("coverage_state"), state.isin(*INDEXED).cast("int").alias("indexed"), *fields, rich.alias("rich_results"), raw.alias("raw"))


def sitemap_entries(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(kind, url) of sitemap files, with a namespace or without: page for their URLs, sitemap for files they point to."""
    found = lambda path, kind: F.transform(F.xpath(xml, F.lit(path)), lambda u: F.struct(F.lit(kind).alias("kind"), F.trim(u).alias("url")))
    rows = files.select(F.explode(F.concat(found("//url/loc/text()", "page"), found("//sitemap/loc/text()", "sitemap"))).alias("e"))
    return rows.select("e.kind", "e.url").where("url <> ''")


def rewrite_sitemaps(files: DataFrame, targets: DataFrame, key: str = "file", xml: str = "xml") -> DataFrame:
    """(key, xml, removed) of the files that name a target url, without its blocks; a trailing slash makes no difference.

    A file's blocks are grouped again; a sitemap has at most 50,000.
    """
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    blocks = files.select(key, F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)[ \t]*<url>.*?</url>[ \t]*\n?"), F.lit(0))).alias("block"))
    blocks = blocks.withColumn("loc", F.regexp_extract("block", r"<loc>\s*([^<\s]+)\s*</loc>", 1))
    gone = blocks.join(targets.select(bare(F.col("url")).alias("__t")).distinct(), bare(F.col("loc")) == F.col("__t"), "left_semi")
    gone = gone.groupBy(key).agg(F.collect_list("block").alias("blocks"), F.sort_array(F.collect_list("loc")).alias("removed"))
    return files.join(gone, key).select(key, F.aggregate("blocks", F.col(xml), lambda x, b: F.replace(x, b, F.lit(""))).alias(xml), "removed")


def panel(questions: DataFrame, tier: str = "all") -> DataFrame:
    return questions.where((F.lit(tier) == "all") | (F.col("tier") == tier))


def answers(payloads: DataFrame) -> DataFrame:
    """payloads(.., payload) with text, the parts of the first answer joined, and citations (uri, title) with a uri."""
    first = lambda path, kind: F.from_json(F.get_json_object("payload", f"$.candidates[0].{path}"), kind)
    text = F.array_join(F.transform(first("content.parts", "array<struct<text:string>>"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    chunks = first("groundingMetadata.groundingChunks", "array<struct<web:struct<uri:string,title:string>>>")
    cited = F.transform(chunks, lambda c: F.struct(c["web"]["uri"].alias("uri"), F.coalesce(c["web"]["title"], F.lit("")).alias("title")))
    empty = F.array().cast("array<struct<uri:string,title:string>>")
    return payloads.withColumns({"text": F.coalesce(text, F.lit("")), "citations": F.coalesce(F.filter(cited, lambda c: F.coalesce(c["uri"], F.lit("")) != ""), empty)}).drop("payload")


def report_document(reports: dict[str, DataFrame]) -> DataFrame:
    """(report, document): each report as one JSON array of its rows. Reports are aggregates of a few hundred rows."""
    rows = [df.agg(F.to_json(F.sort_array(F.collect_list(F.struct("*")))).alias("document")).select(F.lit(name).alias("report"), "document") for name, df in reports.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def run_entries(runs: DataFrame) -> DataFrame:
    """Rows of the job log from runs(started, command, ok, detail): the detail is cut, a missing one is empty."""
    return runs.select("started", "command", F.col("ok").cast("int").alias("ok"), F.substring(F.coalesce("detail", F.lit("")), 1, DETAIL_CHARS).alias("detail"))
