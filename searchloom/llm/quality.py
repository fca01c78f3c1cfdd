"""Quality rules by distribution divergence, in DataFrame functions alone.

Each language's common words are those that most of its texts hold, counted over the whole corpus. A text's histograms
of character classes and of common words are compared, by Jensen-Shannon distance, to those of each language over the
whole corpus. A text stays if its mean distance to the nearest language is small enough, or if it is too short for its
histograms to tell. Features are computed once, in one pass without a shuffle of texts; histograms are sparse, and
references are a table of shares by language and item, joined to them, so that any number of languages takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchloom.llm._shared import Scratch

BLANKS = " \t\n\x0b\x0c\r"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
PROSE, SYMBOLS = ".,;:!?'\"()-", "#*$%&|<>"
OTHER_ASCII = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in PROSE + SYMBOLS)
MAX_DISTANCE, MIN_WORDS = 0.28, 75
TOP_WORDS, MAX_LANGUAGES = 25, 10_000
LONG = 200


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _low(text: Column) -> Column:
    """text with A-Z lowered: by lower() where that changes nothing else, by the much slower translate() where it does."""
    rest = F.regexp_replace(text, "[A-Z]+", "")
    return F.when(F.lower(rest) == rest, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _any_of(chars: str) -> str:
    """A pattern for one of some ASCII characters; each is escaped by its code."""
    return "[" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]"


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP_WORDS, most: int = MAX_LANGUAGES) -> dict[str, tuple[str, ...]]:
    """The words, lowered in A-Z, that most rows of each language hold; ties by word.

    All rows with a language count, and all languages. More than `most` of them, which no language column holds, raise
    ValueError, so that at most `most` x `top` words come to the driver. Words are counted in every task before they are dealt.
    """
    languages = sorted(r[0] for r in docs.where(F.col(lang).isNotNull()).select(lang).distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"{lang} holds more than {most} languages")
    if not languages:
        return {}
    low = _low(F.coalesce(F.col(text), F.lit("")))
    held = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.array_distinct(_words(low))).alias("word"))
    counts = held.groupBy("lang", "word").count()
    first = counts.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("n") <= top)
    found: dict[str, list[str]] = {name: [] for name in languages}
    for r in first.orderBy("lang", "n").collect():
        found[r["lang"]].append(r["word"])
    return {name: tuple(words) for name, words in found.items()}


def features(docs: DataFrame, common: dict[str, tuple[str, ...]], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common) of each row.

    Words are runs of characters other than ASCII white space. classes counts the characters of words by class:
    lower and upper case A-Z, digits, prose marks, symbols, other ASCII, all else. common holds (word, n) of each common
    word in the text, A-Z lowered, and last the empty word with the words that are none. A null text has no words.
    """
    listed = list(dict.fromkeys(w for ws in common.values() for w in ws))
    whole = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(key, *keep, whole.alias("__text"))
    first = first.withColumn("__words", _words(F.col("__text"))).withColumn("__solid", F.array_join("__words", ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    step = first.withColumn("__lines", lines)
    hashed = F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    step = step.withColumn("__windows", F.when(F.size("__words") >= 3, F.slice(hashed, F.lit(1), F.size("__words") - 2)))
    # Most texts repeat no window, which a set of hashes tells; the others' windows are sorted.
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    step = step.withColumn("__sorted", F.when(some, F.sort_array("__windows")))
    step = step.withColumn("__again", F.array_distinct(F.filter("__sorted", lambda h, i: (i > 0) & (h == F.get("__sorted", F.greatest(i - 1, F.lit(0)))))))
    step = step.withColumn("__common", F.filter(_words(_low(F.col("__text"))), lambda w: w.isin(*listed) if listed else F.lit(False)))
    # Positions of repeated windows: looked up in a short list of their hashes, or by sorting all where that is long.
    spots = F.transform("__windows", lambda h, i: F.when(F.array_contains("__again", h), i))
    ranked = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    step = step.withColumn("__ranked", F.when(F.size("__again") > LONG, ranked))
    near = F.filter("__ranked", lambda x, i: (x["h"] == F.when(i > 0, F.get("__ranked", i - 1))["h"]) | (x["h"] == F.get("__ranked", i + 1)["h"]))
    step = step.withColumn("__twice", F.when(F.size("__again") > LONG, F.sort_array(F.transform(near, lambda x: x["p"]))).when(F.size("__again") > 0, F.filter(spots, lambda p: p.isNotNull())))
    # Equal common words lie together once sorted: each one's count is the way to the start of the next.
    step = step.withColumn("__placed", F.sort_array("__common"))
    marks = F.transform("__placed", lambda w, i: F.when((i == 0) | (w != F.get("__placed", F.greatest(i - 1, F.lit(0)))), F.struct(w.alias("word"), i.alias("at"))))
    step = step.withColumn("__starts", F.filter(marks, lambda x: x.isNotNull()))
    said = F.transform("__starts", lambda x, i: F.struct(x["word"].alias("word"), (F.coalesce(F.get("__starts", i + 1)["at"], F.size("__placed")) - x["at"]).cast("long").alias("n")))
    rest_words = F.array(F.struct(F.lit("").alias("word"), (F.size("__words") - F.size("__common")).cast("long").alias("n")))
    covered = F.aggregate(F.transform("__twice", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__twice", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counts, rest = [], F.col("__solid")
    for group in (LOWER, UPPER, DIGITS, PROSE, SYMBOLS, OTHER_ASCII):
        name = f"__left{len(counts)}"
        step = step.withColumn(name, F.regexp_replace(rest, _any_of(group) + "+", ""))
        counts.append(F.length(rest) - F.length(name))
        rest = F.col(name)
    counts.append(F.length(rest))
    return step.select(
        key,
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length("__solid").cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", _any_of(SYMBOLS), ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*(c.cast("long") for c in counts)).alias("classes"),
        F.concat(said, rest_words).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _items(found: DataFrame, *keep: str) -> DataFrame:
    """(*keep, kind, item, n, total): the entries of both histograms that are not 0, by character class or common word."""
    entry = lambda kind, item, n, total: F.struct(F.lit(kind).alias("kind"), item.alias("item"), n.alias("n"), total.alias("total"))
    classes = F.transform("classes", lambda n, i: entry("classes", i.cast("string"), n, F.col("word_chars")))
    words = F.transform("common", lambda x: entry("common", x["word"], x["n"], F.col("n_words")))
    return found.select(*keep, F.inline(F.filter(F.concat(classes, words), lambda x: x["n"] > 0)))


def references(found: DataFrame, lang: str = "lang") -> DataFrame:
    """(kind, item, language, share): each language's shares of character classes and of common words over all its rows
    that pass the base rules."""
    sums = _items(found.where(F.col(lang).isNotNull() & ~base_failed()), lang).groupBy(F.col(lang).alias("language"), "kind", "item").agg(F.sum("n").alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("language", "kind"))).drop("n")


def nearest(found: DataFrame, shares: DataFrame, row: str) -> DataFrame:
    """(row, near): the mean of the Jensen-Shannon distances (base 2, 0 to 1) of both histograms to the nearest language.

    With shares p and q and their mean m, half of p log2(p / m) + q log2(q / m) is added up. An entry that only one of
    the two has adds half its share, so that 1 and what common entries change, (p log2(p / m) + q log2(q / m) - p - q) / 2,
    is the whole sum: entries meet by a join, and languages without common ones lie at distance 1.
    """
    p, q = F.col("n") / F.col("total"), F.col("share")
    change = (p * F.log2(p / ((p + q) / 2)) + q * F.log2(q / ((p + q) / 2)) - p - q) / 2
    met = _items(found, row).join(shares, ["kind", "item"]).select(row, "language", "kind", change.alias("change"))
    part = lambda kind: F.sqrt(F.greatest(1 + F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("change"))), F.lit(0.0)), F.lit(0.0)))
    each = met.groupBy(row, "language").agg(((part("classes") + part("common")) / 2).alias("near"))
    return each.groupBy(row).agg(F.min("near").alias("near"))


def judge(found: DataFrame, shares: DataFrame, row: str, max_distance: float = MAX_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """found with base_failed, divergence and kept: divergence is the mean distance to the nearest language.

    It is null, and the text stays if its base rules pass, for fewer than min_words words or without references. row tells
    the rows of found apart. The shares are one row for each item of a language; Spark broadcasts them if they are small.
    """
    told = F.col("n_words") >= min_words
    near = nearest(found.where(told), shares, row)
    none_met = F.lit(None).cast("double") if shares.isEmpty() else F.lit(1.0)
    out = found.join(near, row, "left").withColumn("base_failed", base_failed()).withColumn("divergence", F.when(told, F.coalesce("near", none_met))).drop("near")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("divergence") <= max_distance, F.lit(True)))


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_distance: float = MAX_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """Features and verdict of every row of docs; common words and references come from all of its rows with a language.

    Nulls: no text is no words and fails the base rules; no language only keeps a row out of the references. Repeated
    rows are judged alike. Empty input gives an empty result. Columns other than key are not carried.
    """
    docs = docs.select(key, text, F.col(lang).alias("__lang"))
    common = common_words(docs, text, "__lang")
    scratch = Scratch(docs.sparkSession)
    found = scratch.stage(features(docs, common, key, text, ("__lang",)).withColumn("__row", F.monotonically_increasing_id()), "quality")
    shares = scratch.stage(references(found, "__lang").coalesce(1), "quality-shares")
    return judge(found, shares, "__row", max_distance, min_words).drop("__lang", "__row")
