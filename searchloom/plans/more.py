"""Queries of sources, merges, probes, outreach, page edits, checks and planning, each with its SQL where there is one."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import functions as F

from searchloom.functions import text as X
from searchloom.operators import checks, marks, merge, outreach, pages, planning, quality, search, tells
from searchloom.params import DEFAULT
from searchloom.plans.content import _AS_OF, _DAY, decoded
from searchloom.plans.rules import _re
from searchloom.plans.search import _PD, _SLUG, RECENT, SQL, query
from searchloom.sources import feeds, payloads

_NOW = datetime.datetime(2001, 12, 1)
_STAMP = "TIMESTAMP '2001-12-01 00:00:00'"


# Sources
@query("conform_rows", "page_query", "SELECT date, page, query, CASE WHEN clicks = 0 THEN 0 ELSE clicks END AS clicks, impressions, position FROM page_query", "clicks impressions position")
def conform_rows(facts):
    rows = facts.select(F.array(F.col("date").cast("string"), "page", "query").alias("keys"), F.when(F.col("clicks") != 0, F.col("clicks")).alias("clicks"), "impressions", F.lit(0.5).alias("ctr"), "position")
    return feeds.conform(rows, "date", "page", "query").withColumn("date", F.to_date("date"))


query("ingest_window", "page_daily", "SELECT date, page, impressions FROM page_daily WHERE date BETWEEN (SELECT max(date) FROM page_daily) - 13 AND (SELECT max(date) FROM page_daily) - 3", "impressions", _PD)(lambda facts, as_of: feeds.ingest_window(facts, as_of).select("date", "page", "impressions"))


@query("backfill_chunks", "action_ledger", """WITH s AS (SELECT kind, min(created)::DATE AS a, max(created)::DATE AS b FROM action_ledger GROUP BY kind)
SELECT kind, n::INT AS n, greatest(a, b - (n * 31 + 30)::INT) AS chunk_start, b - (n * 31)::INT AS chunk_end FROM (SELECT *, unnest(range((b - a) // 31 + 1)) AS n FROM s)""")
def backfill_chunks(ledger):
    return feeds.backfill_chunks(ledger.groupBy("kind").agg(F.to_date(F.min("created")).alias("start"), F.to_date(F.max("created")).alias("end")))


@query("metrics_long", "page_daily", "SELECT date, 'Clicks' AS metric, sum(clicks) AS value FROM page_daily GROUP BY date UNION ALL SELECT date, 'Impressions', sum(impressions) FROM page_daily GROUP BY date", "value")
def metrics_long(facts):
    daily = facts.groupBy("date").agg(F.sum("clicks").alias("Clicks"), F.sum("impressions").alias("Impressions"), F.max("position").alias("Other"))
    return feeds.metrics_long(daily)


_INSPECT = "'$.inspectionResult.{}'"
query("inspection_status", "inspection_json", f"""SELECT url, {_STAMP} AS checked_at, json_extract_string(payload, {_INSPECT.format('indexStatusResult.coverageState')}) AS coverage_state, (json_extract_string(payload, {_INSPECT.format('indexStatusResult.coverageState')}) IN {payloads.INDEXED})::INT AS indexed,
json_extract_string(payload, {_INSPECT.format('indexStatusResult.verdict')}) AS verdict, json_extract_string(payload, {_INSPECT.format('indexStatusResult.robotsTxtState')}) AS robots_state, json_extract_string(payload, {_INSPECT.format('indexStatusResult.userCanonical')}) AS canonical_user, json_extract_string(payload, {_INSPECT.format('indexStatusResult.googleCanonical')}) AS canonical_google,
json_extract_string(payload, {_INSPECT.format('indexStatusResult.lastCrawlTime')}) AS last_crawl_time, json_extract(payload, {_INSPECT.format('richResultsResult.detectedItems')})::VARCHAR AS rich_results, json_extract(payload, {_INSPECT.format('indexStatusResult')})::VARCHAR AS raw FROM inspection_json""")(lambda p: payloads.inspections(p, _NOW))
query("sitemap_entries", "sitemap_xml", "SELECT 'page' AS kind, trim(unnest(regexp_extract_all(xml, '<loc>([^<]*)</loc>', 1))) AS url FROM sitemap_xml")(payloads.sitemap_entries)
query("sitemap_locs", "sitemap_xml", "SELECT unnest(regexp_extract_all(xml, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS url FROM sitemap_xml")(feeds.sitemap_urls)


@query("sitemap_rewrite", "sitemap_xml url_index_status", """WITH t AS (SELECT DISTINCT url FROM url_index_status WHERE indexed = 0), b AS (SELECT file, unnest(regexp_extract_all(xml, '<url>.*?</url>')) AS block FROM sitemap_xml),
l AS (SELECT file, block, trim(regexp_extract(block, '<loc>([^<]*)</loc>', 1)) AS loc FROM b), k AS (SELECT l.*, t.url IS NOT NULL AS gone FROM l LEFT JOIN t ON t.url = rtrim(loc, '/'))
SELECT file, '<urlset>' || coalesce(string_agg(block, '' ORDER BY loc) FILTER (NOT gone), '') || '</urlset>' AS xml, array_to_string(list_sort(list(loc) FILTER (gone)), ' ') AS removed FROM k GROUP BY file HAVING bool_or(gone)""")
def sitemap_rewrite(files, status):
    return payloads.rewrite_sitemaps(files, status.where("indexed = 0")).withColumn("removed", F.array_join("removed", " "))


@query("clean_urls", "url_inventory", "SELECT path, CASE WHEN path = 'index.html' THEN 'https://s/' ELSE 'https://s/' || regexp_replace(regexp_replace(path, '/index\\.html$', ''), '\\.html$', '') END AS url FROM (SELECT substr(replace(url, 'https://shop.example.com', ''), 2) || '.html' AS path FROM url_inventory UNION ALL SELECT cluster || '/index.html' FROM url_inventory UNION ALL SELECT 'index.html')")
def clean_urls(inventory):
    paths = inventory.select(F.concat(F.substr(F.replace("url", F.lit(DEFAULT.site), F.lit("")), F.lit(2)), F.lit(".html")).alias("path"))
    paths = paths.union(inventory.select(F.concat("cluster", F.lit("/index.html")))).union(inventory.select(F.lit("index.html")).limit(1))
    return paths.select("path", pages.clean_url(F.col("path"), "https://s").alias("url"))


_TIERED = "SELECT DISTINCT question_id AS id, question AS text, CASE WHEN right(question_id, 1) IN ('0', '5') THEN 'core' ELSE 'extended' END AS tier FROM aeo_probe"
_tiered = lambda p: p.select(F.col("question_id").alias("id"), F.col("question").alias("text"), F.when(F.right("question_id", F.lit(1)).isin("0", "5"), "core").otherwise("extended").alias("tier")).distinct()
query("panel_selection", "aeo_probe", f"SELECT * FROM ({_TIERED}) WHERE tier = 'core'")(lambda p: payloads.panel(_tiered(p), "core"))
query("run_log", "documents", "SELECT doc_id AS started, lang AS command, (n_chars > 500)::INT AS ok, left(coalesce(text, ''), 2000) AS detail FROM documents")(lambda d: payloads.run_entries(d.select(F.col("doc_id").alias("started"), F.col("lang").alias("command"), (F.col("n_chars") > 500).alias("ok"), F.col("text").alias("detail"))))
query("report_document", "page_daily action_ledger")(lambda p, ledger: payloads.report_document({"months": search.monthly(p).drop("position"), "ledger": ledger.groupBy("kind", "status").count()}))

# Probes
_TEXT = "array_to_string(from_json(json_extract(payload, '$.candidates[0].content.parts'), '[{\"text\":\"VARCHAR\"}]').list_transform(lambda p: p.text), '')"
_CITED = "SELECT id, ts, question_id, payload, unnest(from_json(json_extract(payload, '$.candidates[0].groundingMetadata.groundingChunks'), '[{\"web\":{\"uri\":\"VARCHAR\",\"title\":\"VARCHAR\"}}]')).web AS w FROM answer_json"
_HOST = "CASE WHEN contains(lower(trim(w.title)), '.') AND NOT contains(trim(w.title), ' ') AND NOT contains(w.title, '/') THEN regexp_replace(lower(trim(w.title)), '^www\\.', '') ELSE regexp_replace(lower(regexp_extract(w.uri, '^[^/]*//([^/?#]*)', 1)), '^www\\.', '') END"
_NAMED = " || ".join(f"CASE WHEN contains(lower(t), '{c.lower()}') THEN ',\"{c}\"' ELSE '' END" for c in ("Day One", "Journey", "Daylio"))
_FLAGGED = f"""WITH a AS (SELECT id, ts, question_id, {_TEXT} AS t FROM answer_json), c AS (SELECT id, bool_or(contains({_HOST}, 'shop.example.com') OR contains(lower(w.title), 'shop.example.com')) AS cited FROM ({_CITED}) WHERE w.uri <> '' GROUP BY id)
SELECT id, ts, question_id, contains(lower(t), 'shopvox')::INT AS mentioned, coalesce(cited, false)::INT AS cited, '[' || ltrim({_NAMED}, ',') || ']' AS competitors, left(t, 8000) AS answer FROM a LEFT JOIN c USING (id)"""
_flagged = lambda a: outreach.answer_flags(payloads.answers(a), "ShopVox", "shop.example.com", ("Day One", "Journey", "Daylio"))
query("probe_facts", "answer_json", _FLAGGED)(lambda a: outreach.probe_facts(_flagged(a)))
query("citation_facts", "answer_json", f"SELECT ts, question_id, w.uri AS url, {_HOST} AS domain, left(w.title, 300) AS title FROM ({_CITED}) WHERE w.uri <> ''")(lambda a: outreach.citation_facts(payloads.answers(a)))
query("panel_check", "aeo_probe", f"SELECT *, attempted = 0 OR returned >= attempted * 0.75 AS trusted FROM (SELECT count(*) AS returned FROM aeo_probe), (SELECT count(*) * 9 AS attempted FROM ({_TIERED}))")(lambda p: outreach.panel_check(p, _tiered(p), 9))
query("answer_summary", "aeo_probe", "SELECT count(*) AS probes, sum(mentioned)::BIGINT AS mentioned, sum(cited)::BIGINT AS cited FROM aeo_probe")(outreach.answer_summary)
_REDIRECTED = "SELECT id, CASE WHEN id % 3 = 0 THEN 'redirect.example.net' ELSE domain END AS domain, CASE WHEN id % 6 = 0 THEN 'WWW.Site' || id % 37 || '.org ' ELSE title END AS title FROM aeo_citation"


@query("citation_repair", "aeo_citation", f"SELECT id, title, CASE WHEN domain = 'redirect.example.net' AND contains(title, '.') THEN regexp_replace(lower(trim(title)), '^www\\.', '') ELSE domain END AS domain FROM ({_REDIRECTED})")
def citation_repair(citations):
    n = F.col("id")
    rows = citations.select("id", F.when(n % 3 == 0, "redirect.example.net").otherwise(F.col("domain")).alias("domain"), F.when(n % 6 == 0, F.concat(F.lit("WWW.Site"), (n % 37).cast("string"), F.lit(".org "))).otherwise(F.col("title")).alias("title"))
    return merge.repair_domains(rows).select("id", "title", "domain")


query("citation_domains", "aeo_citation", "SELECT url, title, CASE WHEN contains(title, '.') THEN lower(title) ELSE regexp_replace(regexp_extract(url, '^[^/]*//([^/]*)', 1), '^www\\.', '') END AS domain FROM (SELECT DISTINCT url, title FROM aeo_citation)")(lambda c: c.select("url", "title").distinct().select("url", "title", X.citation_domain(F.col("url"), F.col("title")).alias("domain")))

# Outreach
_FOUND = f"SELECT url, domain, title, hits AS citations, score, competitors, contains(domain, 'site1') AS listed FROM ({SQL['outreach_targets']})"
_TARGETS = "SELECT DISTINCT url, domain, title, TIMESTAMP '2024-01-01 00:00:00' AS first_seen, TIMESTAMP '2024-01-02 00:00:00' AS last_seen, 1::BIGINT AS citations, 1.0::DOUBLE AS score, '' AS competitors, CASE WHEN hash_ % 4 = 0 THEN 'listed' WHEN hash_ % 4 = 1 THEN 'contacted' ELSE 'new' END AS state, TIMESTAMP '2024-01-01 00:00:00' AS state_changed, CASE WHEN hash_ % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS listed_at FROM (SELECT url, domain, title, length(url) + id % 37 AS hash_ FROM aeo_citation WHERE id % 37 < 25 AND domain = 'site' || id % 37 || '.example.org')"
_MERGED = f"""WITH f AS ({_FOUND}), o AS ({_TARGETS}) SELECT url, coalesce(o.domain, f.domain) AS domain, CASE WHEN f.url IS NOT NULL THEN f.citations ELSE o.citations END AS citations,
CASE WHEN coalesce(f.listed, false) AND coalesce(o.state, '') <> 'listed' THEN 'listed' ELSE coalesce(o.state, 'new') END AS state,
CASE WHEN coalesce(f.listed, false) AND coalesce(o.state, '') <> 'listed' THEN coalesce(o.listed_at, {_STAMP}) ELSE o.listed_at END AS listed_at,
CASE WHEN o.url IS NULL THEN 'added' WHEN coalesce(f.listed, false) AND o.state <> 'listed' THEN 'newly_listed' WHEN f.url IS NOT NULL THEN 'seen' END AS outcome FROM o FULL JOIN f USING (url)"""


def _targets(citations):
    n, day = (F.length("url") + F.col("id") % 37) % 4, lambda d: F.lit(datetime.datetime(2024, 1, d))
    rows = citations.where((F.col("id") % 37 < 25) & (F.col("domain") == F.concat(F.lit("site"), (F.col("id") % 37).cast("string"), F.lit(".example.org"))))
    return rows.select("url", "domain", "title", day(1).alias("first_seen"), day(2).alias("last_seen"), F.lit(1).cast("long").alias("citations"), F.lit(1.0).alias("score"), F.lit("").alias("competitors"), F.when(n == 0, "listed").when(n == 1, "contacted").otherwise("new").alias("state"), day(1).alias("state_changed"), F.when(n == 0, day(1)).alias("listed_at")).distinct()


def _merged(citations, probes, as_of):
    found = outreach.outreach_targets(citations, probes, as_of).withColumnRenamed("hits", "citations").withColumn("listed", F.contains("domain", F.lit("site1")))
    return merge.merge_targets(_targets(citations), found, _NOW)


query("outreach_merge", "aeo_citation aeo_probe", _MERGED, dated="aeo_probe.ts")(lambda c, p, as_of: _merged(c, p, as_of).select("url", "domain", "citations", "state", "listed_at", "outcome"))
query("outreach_counts", "aeo_citation aeo_probe", f"SELECT count(outcome) AS seen, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'newly_listed') AS newly_listed FROM ({_MERGED})", dated="aeo_probe.ts")(lambda c, p, as_of: merge.target_counts(_merged(c, p, as_of)))
query("outreach_funnel", "aeo_citation", f"SELECT state, count(*) AS targets, count(listed_at) AS ever_listed FROM ({_TARGETS}) GROUP BY ROLLUP (state)")(lambda c: outreach.funnel(_targets(c)))
query("outreach_listed", "aeo_citation", f"SELECT url, contains(domain, 'site1') AS listed FROM ({_TARGETS})")(lambda c: outreach.mark_listed(_targets(c), c, "site1").select("url", "listed"))
query("outreach_stored", "aeo_citation", f"SELECT url, state FROM ({_TARGETS}) WHERE state = 'new' ORDER BY score DESC, citations DESC, url")(lambda c: outreach.stored(_targets(c), "new").select("url", "state"))
query("outreach_unhandled", "aeo_citation aeo_probe", f"SELECT url FROM ({SQL['outreach_targets']}) WHERE url NOT IN (SELECT url FROM ({_TARGETS}) WHERE state <> 'new')", dated="aeo_probe.ts")(lambda c, p, as_of: outreach.unhandled(outreach.outreach_targets(c, p, as_of), _targets(c)).select("url"))
query("outreach_states", "aeo_citation", f"SELECT url, CASE WHEN starts_with(url, 'https://www.') THEN 'declined' ELSE state END AS state FROM ({_TARGETS})")(lambda c: merge.set_state(_targets(c), _targets(c).select("url", F.when(F.col("url").startswith("https://www."), "declined").otherwise("listed").alias("state")))[0].select("url", "state"))
query("outreach_angles", "aeo_citation aeo_probe", f"SELECT domain, CASE WHEN competitors = '' THEN 'Lead with the claim: x.' ELSE 'The page covers ' || array_to_string(string_split(competitors, ', ')[1:3], ', ') || ' but nothing that offers x.' END AS angle FROM ({SQL['outreach_targets']})", dated="aeo_probe.ts")(lambda c, p, as_of: outreach.outreach_targets(c, p, as_of).select("domain", outreach.pitch(F.col("competitors"), "x").alias("angle")))

# Merges
query("inventory_upsert", "url_inventory", "SELECT url, CASE WHEN cluster = 'for' THEN 'blog' ELSE cluster END AS cluster, CASE WHEN cluster = 'for' THEN 1 ELSE in_sitemap END AS in_sitemap, CASE WHEN cluster = 'in' THEN 'new' ELSE 'old' END AS first_seen FROM url_inventory")(
    lambda v: merge.merge_into(v.where("cluster <> 'in'").withColumn("first_seen", F.lit("old")), v.where("cluster in ('for', 'in')").select("url", F.when(F.col("cluster") == "for", "blog").otherwise(F.col("cluster")).alias("cluster"), F.when(F.col("cluster") == "for", 1).otherwise(F.col("in_sitemap")).alias("in_sitemap"), F.lit("new").alias("first_seen")), ["url"], {"first_seen": "keep"})
)
query("health_rerun", "url_inventory url_index_status", "SELECT checked_at::DATE AS date, cluster, count(*) + CASE WHEN day(checked_at::DATE) > 15 THEN 100 ELSE 0 END AS checked FROM url_inventory JOIN url_index_status USING (url) GROUP BY 1, 2")(
    lambda v, s: (lambda h: merge.replace_days(h, h.where("day(date) > 15").withColumn("checked", F.col("checked") + 100)))(v.join(s, "url").groupBy(F.to_date("checked_at").alias("date"), "cluster").agg(F.count("*").alias("checked")))
)
query("ledger_insert", "action_ledger", "SELECT id, kind, status FROM action_ledger UNION ALL SELECT (SELECT max(id) FROM action_ledger) + row_number() OVER (ORDER BY title, kind), kind, 'planned' FROM (SELECT kind, 'redo ' || status AS title FROM action_ledger GROUP BY kind, status)")(
    lambda ledger: merge.insert_planned(ledger, ledger.groupBy("kind", "status").count().select("kind", F.concat(F.lit("redo "), "status").alias("title")), _NOW).select("id", "kind", "status")
)

# Articles: documents as markdown with front matter.
_ARTICLE = "'---' || chr(10) || 'slug: \"d' || doc_id || '\"' || chr(10) || 'title: \"T ' || lang || '\"' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'meta_description: \"long\"' || chr(10) ELSE '' END || 'description: \"short\"' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'cluster: privacy' ELSE '' END || chr(10) || '---' || chr(10) || coalesce(text, '')"


def _articles(docs):
    n, line = F.col("doc_id"), F.lit("\n")
    parts = [F.lit('---\nslug: "d'), n.cast("string"), F.lit('"\ntitle: "T '), F.col("lang"), F.lit('"\n'), F.when(n % 3 == 0, 'meta_description: "long"\n').otherwise(""), F.lit('description: "short"'), F.when(n % 2 == 0, "\ncluster: privacy").otherwise(""), F.lit("\n---"), line, F.coalesce("text", F.lit(""))]
    return docs.select("doc_id", F.concat(*parts).alias("raw"))


query("article_fields", "documents", "SELECT doc_id, 'd' || doc_id AS slug, 'T ' || lang AS title, CASE WHEN doc_id % 3 = 0 THEN 'long' ELSE 'short' END AS description, true AS valid, CASE WHEN doc_id % 2 = 0 THEN 'privacy' ELSE 'voice' END AS cluster FROM documents WHERE lang IS NOT NULL")(lambda d: _articles(d).where("raw is not null").select("doc_id", *X.article_fields(F.col("raw")), X.article_cluster(F.col("raw")).alias("cluster")))
query("article_front", "documents", f"SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN replace(raw, 'meta_description: \"long\"', 'meta_description: \"it''s $1\"') ELSE replace(raw, 'description: \"short\"' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'cluster: privacy' ELSE '' END, 'description: \"short\"' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'cluster: privacy' ELSE '' END || chr(10) || 'meta_description: \"it''s $1\"') END) AS sha FROM (SELECT doc_id, {_ARTICLE} AS raw FROM documents WHERE lang IS NOT NULL)")(
    lambda d: _articles(d).where("raw is not null").select("doc_id", F.sha2(pages.set_front_value(F.col("raw"), "meta_description", F.lit('it"s $1')), 256).alias("sha"))
)


query("engine_dates", "action_ledger", "SELECT id, CASE WHEN id % 7 <> 0 THEN decided_at::DATE END AS day FROM action_ledger")(lambda ledger: ledger.select("id", X.engine_date(F.when(F.col("id") % 7 != 0, F.concat(F.lit("/Date("), F.unix_millis(F.col("decided_at").cast("timestamp")).cast("string"), F.lit(")/"))).otherwise("never")).alias("day")))

# Pages
_TAGS = reduce(lambda t, n: f"regexp_replace({t}, '<{n}\\b.*?</{n}>', ' ', 'gsi')", ("script", "style", "nav", "footer", "header"), "html")
_BARE = f"substr(trim(regexp_replace(regexp_replace({_TAGS}, '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g')), 1, 6000)"
# The cut may take the semicolon of the last reference, which is decoded all the same.
query("page_texts", "pages", f"SELECT page_id, sha256({decoded("regexp_replace(" + _BARE + ", '&(amp|lt|gt|quot|nbsp)$', '&\\1;')")}) AS sha FROM pages")(lambda p: pages.facts(p, ended=True).select("page_id", F.sha2("text", 256).alias("sha")))
query("page_retitle", "pages", "SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN 'changed' ELSE 'rejected' END AS outcome, sha256(regexp_replace(html, '(?is)(<title>)(.*?)(</title>)', '\\1A &amp; &quot;b&quot; &lt;' || page_id || '\\3')) AS sha FROM pages")(lambda p: pages.retitle(p, p.select("page_id", F.concat(F.lit('A & "b" <'), F.col("page_id").cast("string")).alias("title"), F.lit("d").alias("description")), "page_id").select("page_id", "outcome", F.sha2("html", 256).alias("sha")))
query("page_changes", "pages", "SELECT url FROM pages WHERE page_id % 3 = 0")(lambda p: pages.only_changed(p.select(F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")).alias("content")), p.select(F.col("url").alias("path"), F.col("html").alias("content"))).select(F.col("path").alias("url")))
query("page_routes", "url_inventory", f"SELECT {_SLUG} AS slug, CASE WHEN cluster = 'blog' THEN 'markdown' WHEN cluster = 'for' THEN 'html' ELSE 'rejected' END AS route FROM url_inventory")(lambda v: (lambda s: pages.routes(s.select("slug"), s.where("cluster = 'blog'"), s.where("cluster in ('for', 'blog')")))(v.select(X.slug(F.col("url")).alias("slug"), "cluster")))
_ANCHOR = "CASE WHEN contains(html, '<div class=\"article-cta\">') THEN strpos(html, '<div class=\"article-cta\">') ELSE strpos(html, '</article>') END"
_INDENT = lambda text, at: f"regexp_extract(left({text}, ({at} - 1)::INT), '([ \\t]*)$', 1)"
_SHOWN = "i || '<h2>Frequently asked questions</h2>' || n || i || '<h3>Is it &lt;b&gt;?</h3>' || n || i || '<p>Yes, it is.</p>' || n || i || '<h3>Why?</h3>' || n || i || '<p>So.</p>' || n || n"
_ITEM = "'    {{' || n || '      \"@type\": \"Question\",' || n || '      \"name\": \"{q}\",' || n || '      \"acceptedAnswer\": {{' || n || '        \"@type\": \"Answer\",' || n || '        \"text\": \"{a}\"' || n || '      }}' || n || '    }}'"
_DATA = "j || '<script type=\"application/ld+json\">' || n || '{' || n || '  \"@context\": \"https://schema.org\",' || n || '  \"@type\": \"FAQPage\",' || n || '  \"mainEntity\": [' || n || " + _ITEM.format(q="Is it <b>?", a="Yes, it is.") + " || ',' || n || " + _ITEM.format(q="Why?", a="So.") + " || n || '  ]' || n || '}' || n || j || '</script>' || n"
query("faq_append", "pages", f"""WITH p AS (SELECT *, chr(10) AS n, {_ANCHOR} AS place, regexp_matches(html, '"@type":\\s*"FAQPage"') AS present FROM pages),
a AS (SELECT *, {_INDENT("html", "place")} AS i FROM p), b AS (SELECT *, left(html, (place - 1 - length(i))::INT) || {_SHOWN} || substr(html, place - length(i)) AS new FROM a),
h AS (SELECT *, strpos(new, '</head>') AS head, {_INDENT("new", "strpos(new, '</head>')")} AS j FROM b),
w AS (SELECT page_id, url, html, CASE WHEN page_id % 7 = 0 THEN 'empty' WHEN present THEN 'present' WHEN place = 0 THEN 'rejected' ELSE 'changed' END AS outcome, CASE WHEN head > 0 THEN left(new, (head - 1 - length(j))::INT) || {_DATA} || substr(new, head - length(j)) ELSE new END AS whole FROM h)
SELECT page_id, url, outcome, sha256(CASE WHEN outcome = 'changed' THEN whole ELSE html END) AS sha FROM w""")(
    lambda p: pages.append_faq(p, p.select("page_id", F.when(F.col("page_id") % 7 == 0, "## FAQ\n### Empty").otherwise("## FAQ\n### Is it <b>?\nYes,\nit is.\n### Empty\n### Why?\nSo.").alias("block")), "page_id").select("page_id", "url", "outcome", F.sha2("html", 256).alias("sha"))
)

# Checks
_MARKED = "coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN chr(8203) || 'a' || chr(160) || 'b' WHEN 1 THEN ' citeturn0search1 ' || chr(57344) WHEN 2 THEN ' [Your name] ' ELSE '' END"
query("mark_sanitise", "documents", f"""WITH d AS (SELECT doc_id, {_MARKED} AS t FROM documents), c AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(t, {_re(marks.PASTED)}, '', 'g'), {_re(marks.REMOVED)}, '', 'g'), {_re(marks.BLANKS)}, ' ', 'g') AS clean FROM d)
SELECT doc_id, sha256(clean) AS sha, len(regexp_extract_all(t, {_re(marks.REMOVED)})) AS removed, len(regexp_extract_all(t, {_re(marks.BLANKS)})) AS replaced, len(regexp_extract_all(t, {_re(marks.PASTED)})) AS pasted, CASE WHEN regexp_matches(clean, {_re(marks.PLACEHOLDERS[0])}) OR regexp_matches(clean, {_re(marks.PLACEHOLDERS[1])}) THEN 'unfilled placeholder' ELSE '' END AS blocks FROM c""")(
    lambda d: marks.sanitise(d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "\u200ba\u00a0b").when(F.col("doc_id") % 5 == 1, " citeturn0search1 \ue000").when(F.col("doc_id") % 5 == 2, " [Your name] ").otherwise("")).alias("text"))).select("doc_id", F.sha2("clean", 256).alias("sha"), "removed", "replaced", "pasted", F.array_join("blocks", " ").alias("blocks"))
)
_WORDS = "(" + " OR ".join(f"regexp_matches(lower(t || ' ' || d), '\\b{w}\\b')" for w in (*tells.TIER1, *tells.TIER2)) + " OR " + " OR ".join(f"regexp_matches(t || ' ' || d, {_re(p)})" for _, p in (*tells.HARD_NOS, *tells.FINGERPRINTS)) + ")"
_PROBLEMS = {
    "carries marks": f"regexp_matches(t || d, {_re(marks.REMOVED)}) OR regexp_matches(t || d, {_re(marks.BLANKS)}) OR regexp_matches(t || d, {_re(marks.PASTED)})", "title too long": "length(t) > 62", "description too long": "length(d) > 158", "description too short": "length(d) < 60",
    "banned vocabulary": _WORDS, "title drops the query": "len(q) > 0 AND len(list_filter(q, lambda w: contains(lower(t), w))) = 0", "more than one separator": "length(t) - length(replace(t, '|', '')) > 1",
}
query("meta_checks", "documents", f"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Delve | a | b' ELSE substr(coalesce(text, ''), 1, 50 + doc_id % 20) END AS t, substr(coalesce(text, ''), 90, 40 + doc_id % 150) AS d, regexp_extract_all(lower(substr(coalesce(text, ''), 30, 40)), '[a-z]{{4,}}') AS q FROM documents)
SELECT doc_id, CASE WHEN t = '' OR d = '' THEN CASE WHEN {_PROBLEMS["carries marks"]} THEN 'carries marks; missing' ELSE 'missing' END ELSE array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PROBLEMS.items())}], lambda p: p IS NOT NULL), '; ') END AS problems FROM m""")(
    lambda d: d.select("doc_id", F.array_join(checks.meta_problems(F.when(F.col("doc_id") % 4 == 0, "Delve | a | b").otherwise(F.substr(F.coalesce("text", F.lit("")), F.lit(1), (50 + F.col("doc_id") % 20).cast("int"))), F.substr(F.coalesce("text", F.lit("")), F.lit(90), (40 + F.col("doc_id") % 150).cast("int")), F.substr(F.coalesce("text", F.lit("")), F.lit(30), F.lit(40)), F.lit("-"), F.lit("-")), "; ").alias("problems"))
)
query("gate_evaluate", "documents pages")(lambda d, p: quality.evaluate(d.select("doc_id", "text"), p.select(F.col("page_id").cast("string").alias("url"), F.col("html").alias("text"))).drop("clean"))
query("faq_checks", "documents pages")(lambda d, p: checks.faq_problems(d.select(F.col("doc_id").alias("id"), F.concat(F.lit("## FAQ\n### A?\n"), F.coalesce("text", F.lit(""))).alias("text")), p.select("url", F.col("html").alias("text"))))
query("narration_checks", "documents")(lambda d: checks.narration_problems(d.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))))
query("corpus_state", "pages", "SELECT count(DISTINCT url) AS pages, TIMESTAMP '2001-12-01 00:00:00' AS indexed_at, false AS fresh FROM pages")(lambda p: quality.corpus_state(p, _NOW, _NOW + datetime.timedelta(days=7)))
_SETS = SQL["corpus_index"].split("SELECT doc_id, count(*)", 1)[0]
query("cluster_similarity", "documents", f"""{_SETS.rstrip()}, g AS (SELECT doc_id, source || lang AS cluster FROM documents), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.cluster, a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.cluster = b.cluster AND a.doc_id < b.doc_id), m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id JOIN g gx ON gx.doc_id = x.doc_id JOIN g gy ON gy.doc_id = y.doc_id AND gx.cluster = gy.cluster GROUP BY ALL),
z AS (SELECT cluster, coalesce(m / (na.n + nb.n - m), 0) AS s FROM p LEFT JOIN m USING (a, b) LEFT JOIN n na ON na.doc_id = a LEFT JOIN n nb ON nb.doc_id = b)
SELECT cluster, pages, pages * (pages - 1) // 2 AS pairs, coalesce(median, 0) AS median FROM (SELECT cluster, count(*) AS pages FROM g WHERE cluster IS NOT NULL GROUP BY cluster) LEFT JOIN (SELECT cluster, median(s) AS median FROM z GROUP BY cluster) USING (cluster)""", "median")(lambda d: quality.cluster_similarity(d.select(F.concat("source", "lang").alias("cluster"), F.col("doc_id").alias("url"), "text").where("cluster is not null"), "cluster"))

# Planning
query("planned_items", "action_ledger", "SELECT id, kind FROM action_ledger WHERE status = 'planned' AND kind = 'meta' ORDER BY id")(lambda ledger: planning.planned(ledger, "meta").select("id", "kind"))
query("corpus_urls", "url_inventory", "SELECT url FROM url_inventory WHERE cluster IN ('blog', 'for') ORDER BY url LIMIT 200")(lambda v: planning.in_clusters(v, ("blog", "for")))
query("freshness", "page_daily query_daily", "SELECT 'pages' AS name, max(date) AS newest FROM page_daily UNION ALL SELECT 'queries', max(date) FROM query_daily")(lambda p, q: planning.freshness(("pages", p), ("queries", q)))
_POST_BUDGET = 40
_POSTS = f"""WITH w AS (SELECT 'gsc' AS source, query, gain FROM ({SQL['brief']}) WHERE kind = 'too-far' OR NOT contains(target, '/blog/') UNION ALL SELECT 'aeo', question, gain FROM ({SQL['aeo_gaps']})),
s AS (SELECT *, left(trim(regexp_replace(lower(query), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM w), l AS (SELECT count(*) FILTER (source = 'gsc') = 2 AS aeo_first FROM (SELECT coalesce(json_extract_string(meta, '$.source'), 'gsc') AS source FROM action_ledger WHERE kind = 'post' AND status = 'shipped' ORDER BY id DESC LIMIT 2)),
k AS (SELECT s.*, (source = 'aeo') <> aeo_first AS channel FROM s, l WHERE slug NOT IN (SELECT json_extract_string(meta, '$.slug') FROM action_ledger WHERE kind = 'post' AND created >= {_AS_OF} - INTERVAL 3650 DAY) AND query NOT IN (SELECT query FROM query_daily WHERE impressions >= 45))
SELECT source, query, slug, gain, row_number() OVER (ORDER BY channel, gain DESC, query) AS place FROM k ORDER BY place LIMIT {_POST_BUDGET}"""


@query("post_selection", "search_fact query_daily page_query aeo_probe action_ledger pages", _POSTS, "gain")
def post_selection(facts, query_daily, page_query, probes, ledger, corpus):
    as_of, seen, latest = (df.agg(F.max(c)).first()[0] for df, c in ((facts, "date"), (probes, "ts"), (ledger, "created")))
    live = ledger.select(F.lit("none").alias("slug")).limit(0)
    ranking = query_daily.where("impressions >= 45")
    return planning.select_posts(search.actions(query_daily, page_query, as_of), outreach.aeo_gaps(probes, seen), ledger, live, ranking, latest, _POST_BUDGET, corpus)


_EMPTY_QUEUE = "SELECT * FROM action_ledger WHERE status <> 'planned'"
query("hygiene_selection", "url_inventory url_index_status search_fact sitemap_xml action_ledger", f"SELECT 'prune' AS kind, prefix AS target, pages::VARCHAR AS detail FROM ({SQL['dead_clusters']}) UNION ALL SELECT 'sitemap', url, min(why) FROM (SELECT url, 'dead' AS why FROM ({SQL['suspect_sitemap_urls']}) UNION ALL SELECT url, 'pagination' FROM ({SQL['sitemap_locs']}) WHERE regexp_matches(url, '/page/[0-9]+/?$')) GROUP BY url", dated=_PD)(
    lambda v, s, p, x, ledger, as_of: planning.select_hygiene(search.dead_clusters(v, s, p, as_of), v.select(F.col("url").alias("winner"), F.col("url").alias("loser"), F.lit(1.0).alias("shared_impressions")).limit(0), search.suspect_urls(v, s), feeds.sitemap_urls(x), ledger.where("status <> 'planned'"))
)
query("resolved_items", "action_ledger", "SELECT id, kind, json_extract_string(meta, '$.slug') AS slug, CASE WHEN (kind = 'post' AND json_extract_string(meta, '$.slug') IN (SELECT json_extract_string(meta, '$.slug') FROM action_ledger WHERE status = 'shipped')) OR (kind = 'faq' AND json_extract_string(meta, '$.slug') IN (SELECT json_extract_string(meta, '$.slug') FROM action_ledger WHERE status = 'failed')) THEN 'resolved' ELSE 'todo' END AS outcome FROM action_ledger WHERE status = 'planned'")(
    lambda ledger: (lambda s: planning.resolve(s.where("status = 'planned'"), s.where("status = 'shipped'"), s.where("status = 'failed'")))(ledger.select("id", "kind", "status", F.get_json_object("meta", "$.slug").alias("slug")))
)
query("noindex_rules", "url_inventory", "SELECT '/' || cluster || '/:path*' AS source FROM (SELECT DISTINCT cluster FROM url_inventory WHERE cluster <> 'core') UNION SELECT replace(url, 'https://shop.example.com', '') FROM url_inventory WHERE cluster = 'in'")(lambda v: search.noindex_rules(v.where("cluster <> 'core'").select("cluster").distinct(), v.where("cluster = 'in'").select(F.replace("url", F.lit(DEFAULT.site), F.lit("")).alias("path")), v.where("cluster = 'core'").select(F.concat(F.lit("/"), "cluster", F.lit("/:path*")).alias("source"))))
_PATH = "replace(url, 'https://shop.example.com', '')"
query("redirect_rules", "url_inventory", f"SELECT source, destination, 301 AS status, CASE WHEN NOT starts_with(source, '/') OR NOT starts_with(destination, '/') THEN 'not absolute' WHEN source = destination THEN 'loop' WHEN there THEN 'exists' END AS rejected FROM (SELECT {_PATH} AS source, CASE cluster WHEN 'in' THEN 'home' WHEN 'for' THEN {_PATH} ELSE '/blog' END AS destination, cluster = 'core' AS there FROM url_inventory)")(lambda v: (lambda p: search.redirect_rules(p.select("source", F.when(F.col("cluster") == "in", "home").when(F.col("cluster") == "for", F.col("source")).otherwise("/blog").alias("destination")), p.where("cluster = 'core'").select("source")))(v.select(F.replace("url", F.lit(DEFAULT.site), F.lit("")).alias("source"), "cluster")))
assert RECENT and _DAY and _EMPTY_QUEUE
