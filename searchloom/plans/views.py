"""Search facts, inventory, probes and ledger derived from the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_URL = "'https://shop.example.com/' || (CASE p_partkey % 20 WHEN 17 THEN 'for/' WHEN 18 THEN 'in/' WHEN 19 THEN '' ELSE 'blog/' END) || replace(p_name, ' ', '-') || '-for-' || CAST(p_partkey AS VARCHAR)"
# Old pages that no fact has, eight to a prefix, and pages of lists among them.
_OLD = "'https://shop.example.com/blog/' || (CASE WHEN c_custkey % 40 = 7 THEN 'page/' ELSE 'notes-' || CAST(c_custkey - c_custkey % 8 AS VARCHAR) || '-' END) || CAST(c_custkey AS VARCHAR)"
_FACT = "sum(clicks) AS clicks, sum(impressions) AS impressions, sum(impressions * position) / nullif(sum(impressions), 0) AS position FROM search_fact GROUP BY"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
VIEWS = {
    "search_fact": """
SELECT CAST(l.l_shipdate AS DATE) AS date, 'https://shop.example.com/blog/' || replace(p.p_name, ' ', '-') || '-for-' || CAST(p.p_partkey AS VARCHAR) AS page,
  CASE l.l_suppkey % 20 WHEN 0 THEN 'shopvox app' WHEN 1 THEN '"id widgetkit" android' WHEN 2 THEN 'journey cloud vs premium' WHEN 3 THEN 'day one alternative'
  ELSE split_part(p.p_name, ' ', 2) || ' ' || CASE l.l_suppkey % 8 WHEN 0 THEN 'review' WHEN 1 THEN 'for beginners' WHEN 2 THEN 'best' WHEN 3 THEN 'offline' WHEN 4 THEN 'private' WHEN 5 THEN 'how to start' WHEN 6 THEN 'vs others' ELSE lower(p.p_type) END END AS query,
  CAST(floor(l.l_quantity * l.l_discount * (CASE WHEN p.p_size % 4 = 0 THEN 0 ELSE 0.3 END)) AS DOUBLE) AS clicks, CAST(l.l_quantity AS DOUBLE) AS impressions, CAST(1 + (p.p_size % 45) + (l.l_linenumber % 5) * 0.5 AS DOUBLE) AS position
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "page_daily": f"SELECT date, page, {_FACT} date, page",
    "query_daily": f"SELECT date, query, {_FACT} date, query",
    "page_query": f"SELECT date, page, query, {_FACT} date, page, query",
    "url_inventory": f"SELECT {_URL} AS url, CASE p_partkey % 20 WHEN 17 THEN 'for' WHEN 18 THEN 'in' WHEN 19 THEN 'core' ELSE 'blog' END AS cluster, CASE WHEN p_partkey % 20 IN (17, 18) THEN 0 ELSE 1 END AS in_sitemap FROM part UNION ALL SELECT {_OLD} AS url, 'blog' AS cluster, 1 AS in_sitemap FROM customer",
    "url_index_status": f"SELECT {_URL} AS url, TIMESTAMP '2001-07-01 00:00:00' + INTERVAL '1' DAY * (p_size % 30) AS checked_at, CASE p_size % 6 WHEN 0 THEN 'Not found (404)' WHEN 1 THEN 'Page with redirect' WHEN 2 THEN 'Crawled - currently not indexed' ELSE 'Submitted and indexed' END AS coverage_state, CASE WHEN p_size % 6 >= 3 THEN 1 ELSE 0 END AS indexed FROM part WHERE p_size % 7 <> 0",
    "aeo_probe": """SELECT event_id AS id, ts, 'q' || CAST(user_id % 40 AS VARCHAR) AS question_id, 'question ' || CAST(user_id % 40 AS VARCHAR) AS question, CASE WHEN event_type = 'purchase' AND user_id % 40 < 25 THEN 1 ELSE 0 END AS mentioned, CASE WHEN event_type = 'signup' AND value > 300 THEN 1 ELSE 0 END AS cited,
  CASE event_type WHEN 'click' THEN '["Day One","Journey"]' WHEN 'view' THEN '["Daylio"]' WHEN 'signup' THEN '["Day One","Otter","Stoic"]' ELSE '[]' END AS competitors FROM events""",
    "aeo_citation": """SELECT event_id AS id, ts, 'q' || CAST(user_id % 40 AS VARCHAR) AS question_id, 'https://' || (CASE WHEN event_id % 9 = 0 THEN 'www.' ELSE '' END) || 'site' || CAST(event_id % 37 AS VARCHAR) || '.example.org/' || (CASE WHEN event_id % 2 = 0 THEN 'best-apps' ELSE 'post' END) AS url,
  CASE WHEN event_id % 11 = 0 THEN 'youtube.com' WHEN event_id % 13 = 0 THEN 'm.facebook.com' ELSE 'site' || CAST(event_id % 37 AS VARCHAR) || '.example.org' END AS domain, 'Title ' || CAST(event_id % 37 AS VARCHAR) AS title FROM events""",
    "inspection_json": f"""SELECT {_URL} AS url, '{{"inspectionResult":{{"indexStatusResult":{{"verdict":"PASS","coverageState":"' || (CASE p_size % 4 WHEN 0 THEN 'Submitted and indexed' WHEN 1 THEN 'Indexed, not submitted in sitemap' WHEN 2 THEN 'Not found (404)' ELSE 'Page with redirect' END) || '","robotsTxtState":"ALLOWED","userCanonical":"/' || CAST(p_partkey AS VARCHAR) || '"}},"richResultsResult":{{"detectedItems":' || (CASE WHEN p_size % 3 = 0 THEN '[{{"type":"FAQ"}}]' ELSE '[]' END) || '}}}}}}' AS payload FROM part""",
    "answer_json": """SELECT event_id AS id, ts, 'q' || CAST(user_id % 40 AS VARCHAR) AS question_id, '{"candidates":[{"content":{"parts":[{"text":"People name ' || (CASE event_type WHEN 'click' THEN 'day one and Journey' WHEN 'view' THEN 'Daylio' WHEN 'signup' THEN 'SHOPVOX' ELSE 'none' END) || '"},{"text":", as of ' || CAST(event_id % 7 AS VARCHAR) || '."}]},"groundingMetadata":{"groundingChunks":[{"web":{"uri":"https://www.site' || CAST(event_id % 37 AS VARCHAR) || '.example.org/a","title":"' || (CASE WHEN event_id % 5 = 0 THEN 'shop.example.com' ELSE 'A title' END) || '"}},{"web":{"uri":"","title":"x"}}]}}]}' AS payload FROM events""",
    "sitemap_xml": f"""SELECT p_partkey AS file, '<urlset><url><loc> ' || {_URL} || '/ </loc></url><url><loc>' || {_URL} || '</loc><priority>1</priority></url>' || (CASE WHEN p_size % 5 = 0 THEN '<url><loc>https://shop.example.com/blog/page/' || CAST(p_size AS VARCHAR) || '</loc></url>' ELSE '' END) || '</urlset>' AS xml FROM part""",
    "action_ledger": """SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS created, CASE o_orderkey % 5 WHEN 0 THEN 'post' WHEN 1 THEN 'meta' WHEN 2 THEN 'faq' WHEN 3 THEN 'prune' ELSE 'merge' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'planned' ELSE 'failed' END AS status,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * (o_orderkey % 10) AS decided_at, '{"slug":"s' || CAST(o_custkey AS VARCHAR) || '","source":"' || (CASE WHEN o_orderkey % 3 = 0 THEN 'aeo' ELSE 'gsc' END) || '"}' AS meta FROM orders""",
}
# What the queries that end in _all change in the facts: dates lie within 180 days, and queries belong to blocks of 20 parts.
_WIDE = (
    ("END END AS query", "END END || ' ' || CAST(p.p_partkey - p.p_partkey % 20 AS VARCHAR) AS query"),
    ("CAST(l.l_shipdate AS DATE) AS date", "CAST(TIMESTAMP '2001-11-04 00:00:00' - INTERVAL '1' DAY * (l.l_orderkey % 180) AS DATE) AS date"),
)
FACTS = ("page_daily", "query_daily", "page_query", "search_fact")
_NEEDS = {"page_daily": ("search_fact",), "query_daily": ("search_fact",), "page_query": ("search_fact",)}


def widened(sql: str) -> str:
    """SQL over search facts that lie closer together in time."""
    for old, new in _WIDE:
        sql = sql.replace(old, new)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A given table, or one derived from them; `wide`: from the facts that lie closer together."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = widened(VIEWS[name]) if wide else VIEWS[name]
    frames = {n: table(spark, sf_dir, n, wide) for n in (*_NEEDS.get(name, ()), *(t for t in TABLES if f" {t}" in f"{text} ".replace("FROM ", "FROM  ").replace("\n", " ") and (f"FROM {t}" in text or f"JOIN {t}" in text)))}
    sql = text.replace("VARCHAR", "STRING")
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in frames:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {n}", f"{word} {{{n}}}")
    return spark.sql(sql, **frames)


def with_views(sql: str) -> str:
    """DuckDB SQL with the derived tables that it names in front."""
    names = [n for n in VIEWS if n in sql or any(n in _NEEDS.get(m, ()) and m in sql for m in VIEWS)]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH RECURSIVE {ctes}, {body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"
