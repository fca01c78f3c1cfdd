"""Checks of short texts: titles and descriptions, FAQ blocks and narrations, as arrays of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.functions.text import ascii_bounds, terms_in
from searchloom.operators import marks, quality, tells

TITLE_MOST, DESCRIPTION_LEAST, DESCRIPTION_MOST = 62, 60, 158
FAQ_QUESTIONS, FAQ_TELLS, NARRATION_WORDS = 3, 6, (70, 150)
ENDED = r"[.!?\"')\]]\s*\z"


def _problems(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def banned(text: Column) -> Column:
    """The listed words, brand rules and fingerprints that a short text breaks, in the order of their lists."""
    low = F.lower(text)
    listed = (*tells.TIER1, *tells.TIER2)
    words = F.array_intersect(F.array(*map(F.lit, listed)), terms_in(low, listed))
    return F.concat(words, _problems(*(F.when(text.rlike(ascii_bounds(p)), n) for n, p in (*tells.HARD_NOS, *tells.FINGERPRINTS))))


def meta_problems(title: Column, description: Column, query: Column, old_title: Column, old_description: Column) -> Column:
    """What is wrong with a new title and description of a page that is to answer a query."""
    t, d = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    same = lambda a, b: F.lower(F.trim(a)) == F.lower(F.trim(F.coalesce(b, F.lit(""))))
    marked = lambda c: marks.cleaned(c) != c
    terms = F.regexp_extract_all(F.lower(query), F.lit("[a-z]{4,}"), F.lit(0))
    carries = F.when(marked(t) | marked(d), "carries marks")
    checks = _problems(
        carries,
        F.when(F.length(t) > TITLE_MOST, "title too long"),
        F.when(F.length(d) > DESCRIPTION_MOST, "description too long"),
        F.when(F.length(d) < DESCRIPTION_LEAST, "description too short"),
        F.when(same(t, old_title) & same(d, old_description), "identical to what is live"),
        F.when(F.size(banned(F.concat_ws(" ", t, d))) > 0, "banned vocabulary"),
        F.when((F.size(terms) > 0) & ~F.exists(terms, lambda w: F.contains(F.lower(t), w)), "title drops the query"),
        F.when(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) > 1, "more than one separator"),
    )
    return F.when((t == "") | (d == ""), _problems(carries, F.lit("missing"))).otherwise(checks)


def faq_problems(blocks: DataFrame, corpus: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, problems) of markdown FAQ blocks: their shape, and what the gate says of them as sections."""
    b = F.col(text)
    shape = _problems(
        F.when(F.regexp_count(b, F.lit(r"(?m)^###\s+.+$")) != FAQ_QUESTIONS, f"not {FAQ_QUESTIONS} questions"),
        F.when(~F.ltrim(b).startswith("##"), "no section heading"),
        F.when(~b.rlike(ENDED), "ends in mid-sentence"),
    )
    judged = quality.evaluate(blocks, corpus, "section", key, text)
    rows = blocks.select(key, shape.alias("shape")).join(judged.select(key, "reasons", "tells"), key)
    # Six warnings in a short block are denser than as many in a whole piece.
    dense = _problems(F.when(F.col("tells") >= FAQ_TELLS, F.concat(F.col("tells").cast("string"), F.lit(" tells in a short block"))))
    return rows.select(key, F.concat("shape", "reasons", dense).alias("problems"))


def narration(raw: Column) -> Column:
    """The spoken text of a script: without code fences, labels, bullets and marks of markdown, in one line."""
    bare = F.when(F.contains(raw, F.lit("```")), F.regexp_replace(F.trim(raw), r"\A```\w*\s*|\s*```\z", "")).otherwise(F.trim(raw))
    bare = F.regexp_replace(bare, r"(?i)\A(?:narration|script|voiceover)\s*:\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?m)^\s*[-*]\s+", ""), "[*_#]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def narration_problems(scripts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, script, words, problems): length, and what the gate says of the text as a social post, without duplication."""
    spoken = scripts.select(key, narration(F.col(text)).alias("script"))
    words = F.when(F.col("script") == "", 0).otherwise(F.size(F.split("script", " ")))
    rides = spoken.select(F.struct(F.col(key).alias("key"), "script", words.cast("long").alias("words")).alias("row"), "script")
    rows = quality.evaluate(rides, None, "social", "row", "script").select(F.col("row.key").alias(key), "row.script", "row.words", "reasons")
    return rows.select(key, "script", "words", F.concat(_problems(F.when(~F.col("words").between(*NARRATION_WORDS), "length")), "reasons").alias("problems"))
