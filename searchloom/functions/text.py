"""Scalar functions on URLs, queries, dates and markup, as Column expressions."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from searchloom.params import CTR_CURVE, DEFAULT, Params


def contains_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms), F.lit(False))


def ascii_bounds(pattern: str) -> str:
    """The pattern with a \\b that knows ASCII letters alone, as \\w does: that of Java before 19 knows all letters.

    Each \\b must stand before or after what matches a word character.
    """
    return re.sub(r"\\b(?=([A-Za-z0-9(]|\\[wd])?)", lambda m: r"(?<!\w)" if m[1] else r"(?!\w)", pattern)


def tokens(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))


def vocabulary(words: Column) -> Column:
    """The distinct tokens() of a text in one string, which is much shorter than the text."""
    return F.array_join(F.array_distinct(words), " ")


def holds_any(low: Column, vocab: Column, terms) -> Column:
    """contains_any(low, terms), where the text itself is searched only if its vocabulary holds a term's longest word."""
    def holds(t):
        word = max(re.findall("[a-z0-9_]+", t), key=len, default="")
        return F.contains(vocab, F.lit(word)) if word == t else F.contains(vocab, F.lit(word)) & F.contains(low, F.lit(t))

    return reduce(lambda a, b: a | b, map(holds, terms), F.lit(False))


def terms_in(low: Column, terms, words: Column | None = None, vocab: Column | None = None) -> Column:
    """The listed terms that stand in a lower-cased text as whole words, repeats included, single words first.

    The words of the text are taken once and looked up in a set. Only a text that holds a term of several words at all
    is cut into words and what lies between them; grams are made where such a term may begin, and looked up likewise.
    Where tokens() and vocabulary() of the text are there, they are given.
    """
    pieces = "[a-z0-9_]+|[^a-z0-9_]+"
    cut = {t: re.findall(pieces, t) for t in terms}
    single, several = [t for t in cut if len(cut[t]) == 1], [t for t in cut if len(cut[t]) > 1]
    firsts, lengths = sorted({cut[t][0] for t in several}), sorted({len(cut[t]) for t in several})
    every = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    found = F.filter(tokens(low) if words is None else words, lambda x: x.isin(*single)) if single else F.array().cast("array<string>")
    if not several:
        return found

    def grams(parts, at, n):
        listed = [t for t in several if len(cut[t]) == n]
        return F.filter(F.transform(at, lambda i: F.array_join(F.slice(parts, i + 1, n), "")), lambda g: g.isin(*listed))

    def of(parts):
        at = F.filter(F.transform(parts, lambda x, i: F.when(x.isin(*firsts), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(F.array(at), lambda at: F.concat(*(grams(parts, at, n) for n in lengths))))

    longer = F.flatten(F.transform(F.array(every(pieces)), of))  # the parts are bound once
    return F.concat(found, F.when(contains_any(low, several) if vocab is None else holds_any(low, vocab, several), longer).otherwise(F.array().cast("array<string>")))


def names_any(text: Column, terms) -> Column:
    """contains_any for short strings and many terms: one pattern keeps generated code small."""
    return text.rlike("|".join(map(re.escape, terms))) if terms else F.lit(False)


def is_brand(query: Column, params: Params = DEFAULT) -> Column:
    squashed = F.regexp_replace(F.lower(query), "[^a-z0-9]", "")
    return names_any(squashed, [t.replace(" ", "") for t in params.brand_terms])


def is_irrelevant(query: Column, params: Params = DEFAULT) -> Column:
    low = F.lower(query)
    return names_any(low, params.irrelevant_terms) | low.rlike(params.irrelevant_pattern)


def is_competitor_internal(query: Column, params: Params = DEFAULT) -> Column:
    low = F.lower(query)
    return names_any(low, params.competitors) & ~names_any(low, params.comparative) & names_any(low, params.internal_markers)


def intent(query: Column, params: Params = DEFAULT) -> Column:
    """brand, irrelevant, competitor-internal or acquisition; the first that holds."""
    return F.when(is_brand(query, params), "brand").when(is_irrelevant(query, params), "irrelevant").when(is_competitor_internal(query, params), "competitor-internal").otherwise("acquisition")


def curve_at(place: Column) -> Column:
    """The click-through rate at a whole position of 1 to 10, else null."""
    return F.get(F.array(*map(F.lit, CTR_CURVE)), place.cast("int") - 1)


def expected_ctr(position: Column) -> Column:
    """By half-even rounded position up to 10 (0 counts as 1), 0.008 up to 20, 0.002 beyond."""
    return F.when(position <= 10, curve_at(F.greatest(F.bround(position), F.lit(1.0)))).when(position <= 20, 0.008).otherwise(0.002)


def expected_ctr_flat(position: Column) -> Column:
    """By half-even rounded position of 1 to 10, else 0.02."""
    return F.coalesce(curve_at(F.bround(position)), F.lit(0.02))


def ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))


def cluster(url: Column, params: Params = DEFAULT) -> Column:
    """The first path segment if it is a known one, core for files of the site itself, else other."""
    head = F.lower(F.regexp_extract(F.regexp_replace(url, "^.*?//", ""), "^[^/]*/([^/]*)", 1))
    core = (head == "") | head.endswith(".xml") | head.endswith(".txt")
    return F.when(core, "core").when(head.isin(*params.known_clusters), head).when(~F.contains(head, F.lit(".")), "core").otherwise("other")


def citation_domain(url: Column, title: Column, redirect_host: str = "redirect.example.net") -> Column:
    """A title that looks like a host, else the URL's host unless that only redirects; without www."""
    named = F.lower(F.trim(title))
    is_host = (named != "") & F.contains(named, F.lit(".")) & ~F.contains(named, F.lit(" ")) & ~F.contains(named, F.lit("/"))
    host = F.lower(F.regexp_extract(url, r"^[^/]*//([^/?#]*)", 1))
    return F.when(F.coalesce(is_host, F.lit(False)), F.regexp_replace(named, r"^www\.", "")).when(F.contains(host, F.lit(redirect_host)), "").otherwise(F.regexp_replace(host, r"^www\.", ""))


def is_skipped_domain(domain: Column, params: Params = DEFAULT) -> Column:
    return domain.isin(*params.skip_domains) | reduce(lambda a, b: a | b, (domain.endswith("." + s) for s in params.skip_domains))


def is_listicle(title: Column, url: Column, params: Params = DEFAULT) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", title, url)), params.listicle_hints)


def slug(page: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.regexp_replace(page, "/+$", ""), "/", -1), r"\.html$", "")


def slug_prefix(url: Column) -> Column:
    """The first two parts of the last segment, three where the third joins; empty below three parts."""

    def of(parts):
        n = F.when(F.get(parts, F.lit(2)).isin("for", "vs", "to", "of"), 3).otherwise(2)
        return F.when(F.size(parts) < 3, "").otherwise(F.array_join(F.slice(parts, F.lit(1), n), "-"))

    return F.get(F.transform(F.array(F.split(slug(url), "-")), of), F.lit(0))  # the parts are bound once


def slugify(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)


def topic(query: Column) -> Column:
    # Substrings that decide a topic, in order.
    low, rules = F.lower(query), {"compare": ("vs", "alternative", "compare"), "privacy": ("private", "privacy", "offline", "secure", "encrypt"), "twin": ("twin", "personality", "predict"), "howto": ("how", "start", "prompt")}
    return F.coalesce(*(F.when(contains_any(low, terms), name) for name, terms in rules.items()), F.lit("voice"))


def engine_date(value: Column) -> Column:
    millis = F.regexp_extract(value, r"/Date\((\d+)", 1)
    return F.to_date(F.timestamp_millis(F.when(millis != "", millis.cast("long"))))


def is_pagination(url: Column) -> Column:
    return url.rlike(r"/page/\d+/?$")


def search_page(position: Column) -> Column:
    return (F.floor(position / 10) + 1).cast("long")


# Credentials that must not be logged, in order.
SECRETS = (r"AIza[0-9A-Za-z_\-]{20,}", r"AQ\.[0-9A-Za-z_\-]{20,}", r"gh[pousr]_[0-9A-Za-z]{20,}", r"github_pat_[0-9A-Za-z_]{20,}", r"sk-[0-9A-Za-z\-_]{20,}", r"IGA[0-9A-Za-z]{20,}", r"\d{8,10}:AA[0-9A-Za-z_\-]{30,}", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", r'"private_key"\s*:\s*"[^"]+"')


def redact(text: Column, patterns=SECRETS) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "[REDACTED]"), patterns, text)


@F.pandas_udf(StringType())
def _all_entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _ended_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: re.sub("&[#0-9A-Za-z]+;", lambda m: html.unescape(m[0]), t), na_action="ignore")


def unescape(text: Column, ended: bool = False) -> Column:
    """text with its character references replaced: all named ones, with or without a semicolon, and numbers of both bases.

    `ended` leaves those alone that no semicolon ends. References are decoded in Arrow batches, the one thing here that
    the JVM has no table for.
    """
    return _ended_entities(text) if ended else _all_entities(text)


def page_title(page: Column, ended: bool = False) -> Column:
    return F.trim(unescape(F.regexp_extract(page, "(?is)<title>(.*?)</title>", 1), ended))


def page_description(page: Column, ended: bool = False) -> Column:
    return F.trim(unescape(F.regexp_extract(page, r'(?is)<meta\s+name="description"\s+content="(.*?)"', 1), ended))


def page_text(html: Column, most: int = 6000, ended: bool = False) -> Column:
    """The text of a page outside its frame. The cut may take the semicolon of the last reference, which is decoded all the same."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header)\b.*?</\1>", " ")
    text = F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]+>", " "), r"\s+", " ")), 1, most)
    return unescape(F.regexp_replace(text, r"&(amp|lt|gt|quot|nbsp)\z", "&$1;") if ended else text, ended)


def has_faq(html: Column) -> Column:
    return html.rlike(r"(?i)frequently asked") | html.rlike(r"\bFAQ\b") | F.contains(html, F.lit("FAQPage"))


def front_value(markdown: Column, name: str) -> Column:
    """The value of a frontmatter line, without quotes; empty if there is none."""
    return F.regexp_extract(markdown, rf'(?m)^{name}:[ \t]*"?([^"\n]*)"?[ \t]*$', 1)


def article_cluster(markdown: Column, default: str = "voice") -> Column:
    """The topic that an article's frontmatter names."""
    found = F.regexp_extract(markdown, r"(?m)^cluster:\s*(\S+)", 1)
    return F.when(found != "", found).otherwise(default)


def article_fields(raw: Column) -> list[Column]:
    """slug, title, description and valid of an article: code fences are stripped, description falls back on its short
    name, and an article without a slug is not valid."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\A```\w*\s*", ""), r"\s*```\z", "")
    long, short = front_value(bare, "meta_description"), front_value(bare, "description")
    slug_ = front_value(bare, "slug")
    return [slug_.alias("slug"), front_value(bare, "title").alias("title"), F.when(long != "", long).otherwise(short).alias("description"), (slug_ != "").alias("valid")]


def brand_tokens(host: str, *extra: str) -> tuple[str, ...]:
    """What names a site in a query: its host's first part, without www. and a leading get, and further terms."""
    root = host.removeprefix("www.").removeprefix("get").split(".")[0]
    return tuple(dict.fromkeys(t.lower().replace(" ", "") for t in (root, *extra) if t))
