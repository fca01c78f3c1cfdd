"""Queries of dated series, report rows, the pages behind findings, and the settling of a run, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchloom.operators import planning, search, series
from searchloom.plans.content import _AS_OF, _DAY
from searchloom.plans.search import _DEAD, _PD, _PREFIX, INTENT, RECENT, SQL, TOTAL, query

# Here the calendar is filled by a search for the last inspection up to each day, not by a running sum.
_HEALTH = """WITH u AS (SELECT cluster, checked_at::DATE AS d, indexed FROM url_inventory JOIN url_index_status USING (url) WHERE in_sitemap = 1),
n AS (SELECT cluster, count(*) AS in_sitemap FROM url_inventory WHERE in_sitemap = 1 GROUP BY cluster),
g AS (SELECT cluster, unnest(generate_series(min(d)::TIMESTAMP, (SELECT max(d) FROM u)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM u GROUP BY cluster)
SELECT date, g.cluster, any_value(in_sitemap) AS in_sitemap, count(*) AS checked, sum(indexed)::BIGINT AS indexed FROM g JOIN n USING (cluster) JOIN u ON u.cluster = g.cluster AND u.d <= g.date GROUP BY date, g.cluster"""
query("health_by_day", "url_inventory url_index_status", _HEALTH)(series.daily_health)
_PCT = "SELECT date, sum(indexed)::BIGINT AS indexed, sum(checked)::BIGINT AS checked, sum(indexed) * 100.0 / sum(checked) AS pct FROM"
query("indexation_series", "url_inventory url_index_status", f"{_PCT} ({SQL['health_by_day']}) GROUP BY date", "pct")(lambda inventory, status: series.indexation(series.daily_health(inventory, status)))
query("named_coverage", "page_query page_daily", """SELECT *, coalesce(named_clicks * 100 / nullif(total_clicks, 0), 0) AS coverage
FROM (SELECT sum(clicks) AS total_clicks FROM page_daily), (SELECT sum(clicks) AS named_clicks FROM page_query WHERE query NOT LIKE '%best%')""", "total_clicks named_clicks coverage")(lambda page_query, page_daily: series.named_coverage(page_query.where("query not like '%best%'"), page_daily))
_WEEK = f"status = 'shipped' AND created::DATE >= {_AS_OF}::DATE - 7"
_CAPS = ", ".join(f"{n} AS {name}" for name, n in series.CAPS.items())
query("strategy", "action_ledger url_inventory url_index_status search_fact", f"""SELECT {_CAPS}, l.*, c.*, h.*, q.* FROM
(SELECT count(*) FILTER (kind = 'post' AND {_WEEK}) AS posts, count(*) FILTER (kind IN ('meta', 'faq') AND {_WEEK}) AS edits, count(*) FILTER (kind IN ('prune', 'sitemap', 'merge') AND {_WEEK}) AS removed, count(*) FILTER (status = 'planned') AS pending FROM action_ledger) l,
(SELECT count(DISTINCT json_extract_string(meta, '$.slug')) AS cooling FROM action_ledger WHERE kind IN ('meta', 'faq', 'post') AND created >= {_AS_OF} - INTERVAL 30 DAY) c,
(SELECT min(date) AS from_date, max(date) AS to_date, arg_min(pct, date) AS first_pct, arg_max(pct, date) AS last_pct, arg_max(indexed, date) AS indexed, arg_max(checked, date) AS checked, arg_max(pct, date) >= arg_min(pct, date) AS holding FROM ({_PCT} ({SQL['health_by_day']}) GROUP BY date)) h,
(SELECT sum(clicks) AS clicks, sum(impressions * position) / sum(impressions) AS position FROM query_daily WHERE {INTENT} = 'acquisition') q""", "first_pct last_pct clicks position", _DAY)(lambda ledger, inventory, status, asked, as_of: series.strategy(ledger, series.daily_health(inventory, status), asked, as_of))
# A fixture of publishing that fails for two of three items, so that posts free their slots.
query("settled_run", "action_ledger", f"""WITH n AS (SELECT count(*) AS shipped FROM action_ledger WHERE kind = 'post' AND status = 'shipped' AND decided_at::DATE = {_AS_OF}::DATE),
p AS (SELECT id, kind, id % 3 = 0 AS ok, date_diff('second', created, {_AS_OF}) // 86400 > 14 AS old FROM action_ledger WHERE status = 'planned'),
b AS (SELECT *, coalesce(sum((kind = 'post' AND NOT old AND ok)::INT) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT id, kind, CASE WHEN old THEN 'stale' WHEN kind = 'post' AND before + shipped >= 2 THEN 'hold' WHEN kind NOT IN {planning.KINDS} THEN 'drop' WHEN ok THEN 'shipped' ELSE 'failed' END AS outcome FROM b, n""", dated=_DAY)(lambda ledger, as_of: planning.settled(ledger, ledger.select("id", (F.col("id") % 3 == 0).alias("ok")), as_of, cap=2))

# Pages behind findings, and report rows
query("cannibal_pages", "page_query", f"""WITH r AS (SELECT query, page, {TOTAL} FROM page_query WHERE {RECENT} GROUP BY query, page),
c AS (SELECT query FROM r WHERE {INTENT} = 'acquisition' GROUP BY query HAVING count(*) >= 2 AND sum(impressions) >= 20 AND count(*) FILTER (impressions >= 1) >= 2)
SELECT query, page, clicks, impressions, position FROM r JOIN c USING (query) WHERE impressions >= 1""", "clicks impressions position", _PD)(search.cannibal_pages)
query("dead_pages", "url_inventory url_index_status search_fact", f"""SELECT prefix, url, replace(url, 'https://shop.example.com', '') AS path FROM (SELECT url, ({_PREFIX}) || '-' AS prefix FROM url_inventory WHERE in_sitemap = 1 AND url ILIKE '%/blog/%')
WHERE prefix IN (SELECT prefix FROM ({_DEAD}))""", dated=_PD)(lambda inventory, status, pages, as_of: search.dead_pages(inventory, search.dead_clusters(inventory, status, pages, as_of)))
query("orphan_pages", "url_inventory", "SELECT DISTINCT url FROM url_inventory WHERE url NOT IN (SELECT url FROM url_inventory WHERE in_sitemap = 1)")(lambda inventory: search.orphans(inventory, inventory.where("in_sitemap = 1")))
# Six digits here: at two, halves hang on the order in which positions were added up.
_ROW = "clicks, impressions, round_even(position, 6) AS position"
query("query_rows", "query_daily", f"SELECT date, query, {_ROW}, {INTENT} AS intent FROM query_daily")(lambda asked: search.query_rows(asked, 6))
query("page_rows", "page_daily", f"SELECT date, replace(page, 'https://shop.example.com', '') AS path, {_ROW} FROM page_daily")(lambda pages: search.page_rows(pages, 6))
