"""Queries of the answer-engine, ledger, text, page, merge and stream operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from searchloom.functions import text as X
from searchloom.operators import merge, outreach, pages, quality
from searchloom.plans.search import QUERIES, SQL, any_of, query
from searchloom.params import DEFAULT
from searchloom.sources import feeds
from searchloom.streaming import events as stream

_TS, _DAY = "aeo_probe.ts", "action_ledger.created"
_SINCE = "ts >= date_trunc('day', (SELECT max(ts) FROM aeo_probe) - INTERVAL {} DAY)"
_NAMED = "unnest(from_json(competitors, '[\"VARCHAR\"]')) AS c"

query("panel_rates", "aeo_probe", "SELECT question_id, count(*) AS probes, sum(mentioned) * 100.0 / count(*) AS mentioned_pct, sum(cited) * 100.0 / count(*) AS cited_pct FROM aeo_probe GROUP BY question_id", "mentioned_pct cited_pct")(lambda p: outreach.panel_rates(p, "question_id"))
_GAPS = f"""WITH r AS (SELECT * FROM aeo_probe WHERE {_SINCE.format(90)}), n AS (SELECT question_id, list_sort(list(DISTINCT c)) AS names FROM (SELECT question_id, {_NAMED} FROM r) GROUP BY question_id)
SELECT question_id, question, runs, array_to_string(coalesce(names, []), ', ') AS competitors, len(coalesce(names, [])) AS gain FROM (SELECT question_id, any_value(question) AS question, count(*) AS runs FROM r GROUP BY question_id HAVING count(*) >= 2 AND sum(mentioned) = 0) LEFT JOIN n USING (question_id)"""
query("aeo_gaps", "aeo_probe", _GAPS, dated=_TS)(outreach.aeo_gaps)
_SKIP = " OR ".join(f"domain = '{s}' OR ends_with(domain, '.{s}')" for s in DEFAULT.skip_domains)
query("outreach_targets", "aeo_citation aeo_probe", f"""WITH r AS (SELECT * FROM aeo_citation WHERE {_SINCE.format(30)} AND domain <> '' AND NOT ({_SKIP})), n AS (SELECT DISTINCT question_id, {_NAMED} FROM aeo_probe WHERE {_SINCE.format(30)}),
k AS (SELECT domain, list_sort(list(DISTINCT c)) AS names FROM r JOIN n USING (question_id) GROUP BY domain)
SELECT domain, url, title, hits, array_to_string(coalesce(names, []), ', ') AS competitors, (hits * 2 + len(coalesce(names, [])) * 1.5 + CASE WHEN {any_of("lower(title || ' ' || url)", DEFAULT.listicle_hints)} THEN 4 ELSE 0 END)::DOUBLE AS score
FROM (SELECT domain, count(*) AS hits, min(url) AS url, max(title) AS title FROM r GROUP BY domain HAVING count(*) >= 2) LEFT JOIN k USING (domain)""", dated=_TS)(outreach.outreach_targets)
query("top_cited_domains", "aeo_citation", "SELECT domain, count(*) AS citations FROM aeo_citation GROUP BY domain ORDER BY citations DESC, domain LIMIT 10")(outreach.top_cited)
_AS_OF = "(SELECT max(created) FROM action_ledger)"
query("ledger_summary", "action_ledger", f"SELECT kind, status, count(*) AS n FROM action_ledger WHERE created >= date_trunc('day', {_AS_OF} - INTERVAL 30 DAY) GROUP BY ALL", dated=_DAY)(outreach.ledger_summary)
query("ledger_recent", "action_ledger", "SELECT kind, id, status, coalesce(json_extract_string(meta, '$.source'), 'gsc') AS source, row_number() OVER (PARTITION BY kind ORDER BY id DESC) AS n FROM action_ledger QUALIFY n <= 5")(outreach.recent)
query("cooling_down", "action_ledger", f"SELECT DISTINCT json_extract_string(meta, '$.slug') AS slug FROM action_ledger WHERE kind IN ('meta', 'faq', 'post') AND created >= {_AS_OF} - INTERVAL 30 DAY", dated=_DAY)(outreach.cooling_down)
query("ledger_budgets", "action_ledger", f"""WITH c AS (SELECT count(*) FILTER (kind = 'post' AND status = 'shipped' AND decided_at::DATE = {_AS_OF}::DATE) AS posts_today, count(*) FILTER (kind = 'post' AND status = 'shipped' AND decided_at >= {_AS_OF} - INTERVAL 7 DAY) AS posts_week, count(*) FILTER (kind = 'post' AND status = 'planned') AS posts_queued,
count(*) FILTER (kind IN ('meta', 'faq') AND status = 'shipped' AND decided_at >= {_AS_OF} - INTERVAL 7 DAY) AS edits_week, count(*) FILTER (kind IN ('meta', 'faq') AND status = 'planned') AS edits_queued FROM action_ledger)
SELECT *, greatest(0, least(1 - posts_today - posts_queued, 7 - posts_week - posts_queued)) AS post_budget, greatest(0, least(2 - edits_queued, 5 - edits_week - edits_queued)) AS edit_budget FROM c""", dated=_DAY)(outreach.budgets)
query("stale_plans", "action_ledger", f"SELECT id, kind, floor(epoch({_AS_OF} - created) / 86400)::BIGINT AS age FROM action_ledger WHERE status = 'planned' AND floor(epoch({_AS_OF} - created) / 86400) > 14", dated=_DAY)(outreach.stale)
query("changed_urls", "action_ledger", "SELECT DISTINCT '/blog/' || json_extract_string(meta, '$.slug') AS path FROM action_ledger WHERE status = 'shipped' AND kind IN ('post', 'meta', 'faq') UNION SELECT '/blog' FROM action_ledger WHERE status = 'shipped' AND kind = 'post'")(outreach.changed_urls)

_MARKED = "coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' We delve into a robust paradigm. Studies show it.' WHEN 1 THEN ' Moreover, it could potentially serve. I hope this helps' WHEN 2 THEN ' — a — b — c #a #b #c #d #e #f' ELSE '' END"


@query("text_gate", "documents", f"""WITH d AS (SELECT doc_id, {_MARKED} AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[a-z'']+') AS w FROM d),
p AS (SELECT doc_id, len(w) AS words,
 {" + ".join("len(regexp_extract_all(t, '" + r.replace("'", "''") + "'))" for _, s, r in quality.COUNTED if s == "P0")} + {" + ".join("regexp_matches(t, '" + r.replace("'", "''") + "')::INT" for _, s, r in quality.ONCE if s == "P0")} AS p0,
 {" + ".join("len(regexp_extract_all(t, '" + r.replace("'", "''") + "'))" for _, s, r in quality.COUNTED if s == "P1")} + {" + ".join(f"regexp_matches(lower(t), '\\b{x}\\b')::INT" for x in quality.TIER1)} + (len(w) > 0 AND len(regexp_extract_all(t, '—')) > greatest(1, len(w) // 1000))::INT AS p1,
 {" + ".join("len(regexp_extract_all(t, '" + r.replace("'", "''") + "'))" for _, s, r in quality.COUNTED if s == "P2")} + (len(regexp_extract_all(t, '#\\w+')) >= 6)::INT + (len(w) >= 200 AND len(list_distinct(w)) < 0.4 * len(w))::INT AS p2 FROM w)
SELECT doc_id, words, p0::BIGINT AS p0, p1::BIGINT AS p1, p2::BIGINT AS p2, (100 * p0 + 5 * p1 + p2)::BIGINT AS score, p0 = 0 AND p1 < 6 AS passed FROM p""")
def text_gate(docs):
    n = F.col("doc_id") % 5
    tail = F.when(n == 0, " We delve into a robust paradigm. Studies show it.").when(n == 1, " Moreover, it could potentially serve. I hope this helps").when(n == 2, " — a — b — c #a #b #c #d #e #f").otherwise("")
    return quality.report(docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text")))


@query("draft_check", "conversations documents", """WITH w AS (SELECT 'c' || conv_id || '-' || turn AS k, true AS draft, text FROM conversations UNION ALL SELECT doc_id::VARCHAR, false, text FROM documents),
v AS (SELECT k, draft, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' +'), lambda x: x <> '') AS w FROM w),
s AS (SELECT DISTINCT k, draft, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT k, draft, w, unnest(range(1, len(w) - 3)) AS i FROM v WHERE len(w) >= 5)),
n AS (SELECT k, draft, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT a.k AS draft, b.k AS url, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.draft AND NOT b.draft GROUP BY ALL),
f AS (SELECT m.draft, url, m / (a.n + b.n - m) AS similarity FROM m JOIN n a ON a.k = m.draft AND a.draft JOIN n b ON b.k = url AND NOT b.draft WHERE b.n >= 50)
SELECT draft, url, similarity, row_number() OVER (PARTITION BY draft ORDER BY similarity DESC, url) AS place, similarity >= 0.28 AS blocks FROM f WHERE similarity >= 0.18 QUALIFY place <= 3""", "similarity")
def draft_check(turns, docs):
    drafts = turns.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("draft"), "text")
    corpus = docs.select(F.col("doc_id").cast("string").alias("url"), "text")
    return quality.near_drafts(drafts, corpus, "draft", "url", "text")


_ENTITIES = {"&lt;": "'<'", "&gt;": "'>'", "&quot;": "'\"'", "&#39;": "chr(39)", "&#x27;": "chr(39)", "&nbsp;": "chr(160)", "&amp;": "'&'"}  # those of the given pages


def decoded(text: str) -> str:
    for entity, plain in _ENTITIES.items():
        text = f"replace({text}, '{entity}', {plain})"
    return text


_TITLE, _ABOUT = (f"trim({decoded(f"regexp_extract(html, '{p}', 1)")})" for p in ("(?is)<title>(.*?)</title>", '(?is)<meta\\s+name="description"\\s+content="(.*?)"'))
query("page_facts", "pages", f"SELECT page_id, url, {_TITLE} AS title, {_ABOUT} AS description, regexp_matches(html, '(?i)frequently asked') OR regexp_matches(html, '\\bFAQ\\b') OR contains(html, 'FAQPage') AS has_faq FROM pages")(lambda p: pages.facts(p, ended=True).drop("text"))
query("block_coverage", "pages", "SELECT count(*) AS pages, count(*) FILTER (contains(html, '<article')) AS marked FROM pages")(lambda p: pages.coverage(p, "<article"))


@query("block_insert", "pages", "SELECT page_id, CASE WHEN contains(html, '</footer>') THEN 'changed' ELSE 'skipped' END AS outcome, sha256(CASE WHEN contains(html, '</footer>') THEN left(html, strpos(html, '</footer>') - 1) || '<!-- agents --><p>x</p><!-- /agents -->' || substr(html, strpos(html, '</footer>')) ELSE html END) AS html_sha256 FROM pages")
def block_insert(p):
    return pages.insert_block(p, "<p>x</p>", "agents").select("page_id", "outcome", F.sha2("html", 256).alias("html_sha256"))


query("page_links", "pages", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")(pages.links)
query("unlinked_pages", "pages", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) FROM pages)")(pages.unlinked)


@query("conversation_redaction", "conversations", "SELECT conv_id, turn, text LIKE '%[REDACTED]%' AS redacted, sha256(text) AS text_sha256 FROM (SELECT conv_id, turn, " + "".join("regexp_replace(" for _ in X.SECRETS) + "text || ' sk-abcdefghijklmnopqrstuvwx'" + "".join(", '" + p.replace("'", "''") + "', '[REDACTED]', 'g')" for p in X.SECRETS) + " AS text FROM conversations)")
def conversation_redaction(turns):
    rows = turns.select("conv_id", "turn", X.redact(F.concat("text", F.lit(" sk-abcdefghijklmnopqrstuvwx"))).alias("text"))
    return rows.select("conv_id", "turn", F.contains("text", F.lit("[REDACTED]")).alias("redacted"), F.sha2("text", 256).alias("text_sha256"))


@query("fact_upsert", "page_daily", "SELECT date, page, CASE WHEN date >= DATE '1998-01-01' THEN clicks + 1 ELSE clicks END AS clicks, impressions, position FROM page_daily", "clicks impressions position")
def fact_upsert(facts):
    return merge.merge_into(facts, facts.where("date >= date '1998-01-01'").withColumn("clicks", F.col("clicks") + 1), ["date", "page"])


@query("latest_status", "url_index_status", "SELECT url, checked_at, coverage_state, indexed FROM url_index_status")
def latest_status(status):
    older = status.withColumn("checked_at", F.col("checked_at") - F.expr("interval 1 day")).withColumn("indexed", F.lit(0))
    return merge.latest(status.union(older), ["url"], "checked_at")


@query("ledger_settle", "action_ledger", "SELECT id, CASE WHEN status = 'planned' THEN 'shipped' ELSE status END AS status, json_extract_string(meta, '$.slug') AS slug, CASE WHEN status = 'planned' THEN 'abc' END AS commit FROM action_ledger")
def ledger_settle(ledger):
    outcomes = ledger.where("status = 'planned'").select("id", F.lit("shipped").alias("status"), F.col("created").alias("at"), F.lit("loop").alias("by"), F.lit('{"commit":"abc"}').alias("patch"))
    done = merge.settle(ledger, outcomes)
    return done.select("id", "status", F.get_json_object("meta", "$.slug").alias("slug"), F.get_json_object("meta", "$.commit").alias("commit"))


query("daily_event_counts", "events", "SELECT ts::DATE AS day, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY ALL", "value")(stream.daily_counts)
query("rolling_mention_rates", "aeo_probe", "SELECT (ts::DATE - i::INT)::DATE AS day, question_id, count(*) AS probes, sum(mentioned) / count(*) AS rate FROM (SELECT *, unnest(range(7)) AS i FROM aeo_probe) GROUP BY 1, 2", "rate")(stream.rolling_rates)


def late_upsert(spark, sf_dir):
    """Events as a stream into a table by day: the last event of each user and day."""
    feeds.use_checkpoints(spark)
    base, source = f"{spark.sparkContext.getCheckpointDir()}/upsert-{uuid.uuid4().hex}", f"{sf_dir}/events.parquet"
    # A stream reads folders; a pattern lets it read a table that is one file too.
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[t]").select("ts", F.to_date("ts").alias("day"), "user_id", "event_id", "value")
    stream.upsert_batches(rows, f"{base}/table", ["day", "user_id"], f"{base}/progress", once=True).awaitTermination()
    return stream.current(spark, f"{base}/table").select("day", "user_id", "event_id", "value")


QUERIES["late_upsert"] = late_upsert
SQL["late_upsert"] = "SELECT ts::DATE AS day, user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY ts DESC, event_id DESC) = 1"
