"""Bulk operations on a table of HTML pages, as native string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import text as X


def facts(pages: DataFrame, ended: bool = False) -> DataFrame:
    """Title, description, text and FAQ of pages; `ended`: only character references with a semicolon are decoded."""
    h = F.col("html")
    return pages.select("page_id", "url", X.page_title(h, ended).alias("title"), X.page_description(h, ended).alias("description"), X.page_text(h, ended=ended).alias("text"), X.has_faq(h).alias("has_faq"))


def coverage(pages: DataFrame, marker: str) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.contains("html", F.lit(marker))).alias("marked"))


def _literal(text: Column) -> Column:
    """text as it stands in a regular expression's replacement."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def insert_block(pages: DataFrame, block: str, marker: str, anchor: str = "</footer>") -> DataFrame:
    """pages with the block before the first anchor, indented as it is, replacing an older one between marker comments.

    outcome tells which: changed, unchanged, skipped (no anchor and no older block), or broken where a start mark has no
    end; such a page is left as it is.
    """
    start, end = f"<!-- {marker} -->", f"<!-- /{marker} -->"
    whole = F.lit(f"{start}{block}{end}")
    at, a, b = F.instr("html", anchor), F.instr("html", start), F.instr("html", end)
    indent = F.regexp_extract(F.substring(F.col("html"), F.lit(1), at - 1), r"([ \t]*)\z", 1)
    line = F.when(indent == "", whole).otherwise(F.concat(whole, F.lit("\n"), indent))
    fresh = F.concat(F.substring(F.col("html"), F.lit(1), at - 1), line, F.substr(F.col("html"), at))
    replaced = F.concat(F.substring(F.col("html"), F.lit(1), a - 1), whole, F.substr(F.col("html"), b + len(end)))
    broken = (a > 0) & (b <= a)
    out = F.when(broken, F.col("html")).when(a > 0, replaced).when(at > 0, fresh).otherwise(F.col("html"))
    outcome = F.when(broken, "broken").when((a == 0) & (at == 0), "skipped").when(F.col("html") == out, "unchanged").otherwise("changed")
    return pages.select("page_id", "url", out.alias("html"), outcome.alias("outcome"))


# The tags of a head that carry the title (t) or the description (d).
HEAD_TAGS = (("t", r"(?i)^((?s:.*?)<title>)(?s:.*?)(</title>)"), *((v, rf'(?i)^((?s:.*?)<meta\s+{n}"\s+content=").*?(")') for v, n in (("d", 'name="description'), ("t", 'property="og:title'), ("d", 'property="og:description'), ("t", 'name="twitter:title'), ("d", 'name="twitter:description'))))


def retitle(pages: DataFrame, changes: DataFrame, key: str = "url") -> DataFrame:
    """Sets the title and description of pages named by changes(key, title, description), escaped, in the first of each
    head tag that is there and in the article's JSON-LD; pages in which nothing changes are rejected. Where pages share a
    URL, changes name them by page_id."""
    rows = pages.join(changes, key)
    new = F.col("html")
    for value, pattern in HEAD_TAGS:
        text = _escape(F.col("title" if value == "t" else "description"))
        new = F.regexp_replace(new, pattern, F.concat(F.lit("$1"), _literal(text), F.lit("$2")))
    rows = rows.withColumn("new", sync_jsonld(new, F.col("title"), F.col("description")))
    return rows.select("page_id", "url", F.col("new").alias("html"), F.when(F.col("new") == F.col("html"), "rejected").otherwise("changed").alias("outcome"))


JSONLD = r'(?is)(<script type="application/ld\+json">)(.*?)(</script>)'


def sync_jsonld(html: Column, title: Column, description: Column, today: Column | None = None) -> Column:
    """html with headline and description (and dateModified) of its first BlogPosting block; broken JSON is left alone.

    Keys come out in the order of the map, as JSON objects have none.
    """
    kind = "map<string,variant>"
    raw = F.regexp_extract(html, JSONLD, 2)
    known = F.from_json(raw, kind)
    text = lambda c: F.parse_json(F.to_json(c.cast("variant")))
    fields = {"headline": title, "description": description} | ({"dateModified": today.cast("string")} if today is not None else {})
    patch = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), text(v))))
    merged = F.map_concat(F.map_filter(known, lambda k, _: ~k.isin(*fields)), patch)
    is_post = F.coalesce(F.get_json_object(raw, "$.@type") == "BlogPosting", F.lit(False)) & known.isNotNull()
    at = F.instr(html, raw)
    done = F.concat(F.substring(html, F.lit(1), at - 1), F.lit("\n"), F.to_json(merged), F.lit("\n"), F.substr(html, at + F.length(raw)))
    return F.when(is_post & (raw != ""), done).otherwise(html)


def parse_faq(block: Column) -> Column:
    """The (question, answer) pairs of a markdown block: a third-level heading and the text below it, in one line."""
    parts = F.slice(F.split(block, r"(?m)^###\s+"), F.lit(2), F.lit(1_000_000))
    pair = lambda c: F.struct(F.trim(F.regexp_extract(c, r"\A\s*([^\n]*)", 1)).alias("question"), F.trim(F.regexp_replace(F.regexp_extract(c, r"(?s)\A\s*[^\n]*\n(.*)", 1), r"\s+", " ")).alias("answer"))
    return F.filter(F.transform(parts, pair), lambda p: (p["question"] != "") & (p["answer"] != ""))


def _json_text(text: Column) -> Column:
    """A text as a JSON string."""
    held = F.to_json(F.array(text))
    return F.substring(held, F.lit(2), F.length(held) - 2)


def faq_html(pairs: Column, indent: Column) -> Column:
    """The visible block, a heading or paragraph a line, each behind the indentation of the place where it goes."""
    lines = F.transform(pairs, lambda p: F.concat(indent, F.lit("<h3>"), _escape(p["question"]), F.lit("</h3>\n"), indent, F.lit("<p>"), _escape(p["answer"]), F.lit("</p>")))
    return F.concat(indent, F.lit("<h2>Frequently asked questions</h2>\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def faq_json(pairs: Column, indent: Column) -> Column:
    """The same questions as JSON-LD, written with two blanks a level."""
    item = lambda p: F.concat(F.lit('    {\n      "@type": "Question",\n      "name": '), _json_text(p["question"]), F.lit(',\n      "acceptedAnswer": {\n        "@type": "Answer",\n        "text": '), _json_text(p["answer"]), F.lit("\n      }\n    }"))
    body = F.concat(F.lit('{\n  "@context": "https://schema.org",\n  "@type": "FAQPage",\n  "mainEntity": [\n'), F.array_join(F.transform(pairs, item), ",\n"), F.lit("\n  ]\n}"))
    return F.concat(indent, F.lit('<script type="application/ld+json">\n'), body, F.lit("\n"), indent, F.lit("</script>\n"))


def _before(html: Column, at: Column, made) -> Column:
    """html with made(indentation) in front of the place `at` and the blanks that indent it."""
    indent = F.regexp_extract(F.substring(html, F.lit(1), at - 1), r"(?:\A|[^ \t])([ \t]*)\z", 1)
    return F.concat(F.substring(html, F.lit(1), at - 1 - F.length(indent)), made(indent), F.substr(html, at - F.length(indent)))


def append_faq(pages: DataFrame, blocks: DataFrame, key: str = "url") -> DataFrame:
    """pages with the FAQ of blocks(key, block) before the call to action or the end of the article, and its JSON-LD at the
    end of the head, both indented as what follows them. outcome: empty (the block has no pairs), present (FAQ data is
    there already), rejected (no place) or changed; a page without a head gets the visible block alone.
    Where pages share a URL, blocks name them by page_id."""
    rows = pages.join(blocks, key).withColumn("pairs", parse_faq(F.col("block")))
    html = F.col("html")
    cta, end = F.instr(html, '<div class="article-cta">'), F.instr(html, "</article>")
    rows = rows.withColumn("at", F.when(cta > 0, cta).otherwise(end))
    rows = rows.withColumn("new", _before(html, F.col("at"), lambda indent: faq_html(F.col("pairs"), indent))).withColumn("head", F.instr("new", "</head>"))
    whole = F.when(F.col("head") > 0, _before(F.col("new"), F.col("head"), lambda indent: faq_json(F.col("pairs"), indent))).otherwise(F.col("new"))
    outcome = F.when(F.size("pairs") == 0, "empty").when(html.rlike(r'"@type":\s*"FAQPage"'), "present").when(F.col("at") == 0, "rejected").otherwise("changed")
    return rows.select("page_id", "url", F.when(outcome == "changed", whole).otherwise(html).alias("html"), outcome.alias("outcome"))


def set_front_value(markdown: Column, name: str, value: Column) -> Column:
    """markdown with a frontmatter key set, replaced where it stands or added at the end; null without frontmatter."""
    block = r"(?s)\A(---\s*\n)(.*?)(\n---\s*\n)"
    front = F.regexp_extract(markdown, block, 2)
    line = F.concat(F.lit(f'{name}: "'), F.replace(value, F.lit('"'), F.lit("'")), F.lit('"'))
    own = rf"(?m)\A((?s:.*?))^{name}:.*$"
    new = F.when(front.rlike(rf"(?m)^{name}:"), F.regexp_replace(front, own, F.concat(F.lit("$1"), _literal(line)))).otherwise(F.concat(front, F.lit("\n"), line))
    out = F.concat(F.lit("---\n"), new, F.lit("\n---\n"), F.regexp_replace(markdown, block, ""))
    return F.when(markdown.rlike(block), out)


def version_drift(profile: Column, changelog: Column) -> Column:
    """What is wrong between the version a profile declares and the changelog's first: null if they agree."""
    declared, dated = (F.regexp_extract(profile, r"(?m)^-\s*Latest version \(as of ([\d-]+)\):\s*([\d.]+)", i) for i in (2, 1))
    shipped, on = (F.regexp_extract(changelog, r"(?m)^##\s*\[([\d.]+)\]\s*—\s*([\d-]+)", i) for i in (1, 2))
    said = F.concat(F.lit("declares "), declared, F.lit(" as of "), dated, F.lit(", shipped "), shipped, F.lit(" on "), on)
    return F.when((declared == "") | (shipped == ""), "unreadable").when(declared != shipped, said)


def only_changed(files: DataFrame, current: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The files that are new or unlike what is there, each once, however many a path has."""
    now = current.select(F.col(path).alias("__path"), F.col(content).alias("__now"))
    return files.join(now, (F.col(path) == F.col("__path")) & F.col(content).eqNullSafe(F.col("__now")), "left_anti")


def routes(changes: DataFrame, articles: DataFrame, pages: DataFrame) -> DataFrame:
    """changes(slug, ...) with where each is to be made: markdown if the slug has an article, else html, else rejected."""
    has = lambda df, name: df.select("slug").distinct().withColumn(name, F.lit(True))
    rows = changes.join(has(articles, "__a"), "slug", "left").join(has(pages, "__p"), "slug", "left")
    return rows.withColumn("route", F.when(F.col("__a"), "markdown").when(F.col("__p"), "html").otherwise("rejected")).drop("__a", "__p")


def listing(spark: SparkSession, path: str, site: str) -> DataFrame:
    """(path, url) of the HTML files under a folder, at any depth, as they are served: no .html, index pages as folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(path)
    below = F.element_at(F.split("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", 2), -1)
    return files.select(below.alias("path"), clean_url(below, site).alias("url")).orderBy("path")


def clean_url(path: Column, site: str) -> Column:
    """The URL at which an HTML file is served."""
    bare = F.when(path == "index.html", "").when(path.endswith("/index.html"), F.regexp_replace(path, "/index\\.html$", "")).otherwise(F.regexp_replace(path, "\\.html$", ""))
    return F.concat(F.lit(site + "/"), bare)


def orphans(pages: DataFrame, index_pages: DataFrame, prefix: str = "/blog/") -> DataFrame:
    """(slug, title, description) of pages(slug, html) that no index page links to; without a title, the slug's words."""
    linked = index_pages.select(F.explode(F.regexp_extract_all("html", F.lit(f'href="{prefix}([a-z0-9-]+)"'), F.lit(1))).alias("slug")).distinct()
    title = X.page_title(F.col("html"))
    rows = pages.join(linked, "slug", "left_anti")
    return rows.select("slug", F.when(title != "", title).otherwise(F.initcap(F.replace("slug", F.lit("-"), F.lit(" ")))).alias("title"), X.page_description(F.col("html")).alias("description"))


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


def unlinked(pages: DataFrame) -> DataFrame:
    """Pages that no page links to by URL."""
    return pages.select("page_id", "url").join(links(pages).select(F.col("href").alias("url")).distinct(), "url", "left_anti")
