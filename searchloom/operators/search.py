"""Search facts, opportunities, ranked actions and reports. Every function takes frames and an explicit as_of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.functions import text as X
from searchloom.params import DEFAULT, Params
from searchloom.sources.feeds import use_checkpoints


def window(facts: DataFrame, as_of, days: int, lag: int = 0) -> DataFrame:
    """Rows of the last `days` days before as_of (less lag), both ends included."""
    end = F.date_sub(F.lit(as_of), lag)
    return facts.where(F.col("date").between(F.date_sub(end, days), end))


def wavg() -> Column:
    """Impression-weighted mean position; null without impressions."""
    return F.sum(F.col("impressions") * F.col("position")) / F.nullif(F.sum("impressions"), F.lit(0.0))


def totals(facts: DataFrame, *by: str) -> DataFrame:
    return facts.groupBy(*by).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), wavg().alias("position"))


def top_row(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("__n = 1").drop("__n")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with a dense priority 1..n. Ranks are local to sorted ranges, offset by the sizes of the ranges before.

    The placed rows are checkpointed, so that sizes and offsets see the same ranges: bounds are sampled anew by each job.
    """
    spark = rows.sparkSession
    use_checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)).checkpoint()
    sizes = placed.groupBy("__part").count()
    before = sizes.select(F.col("__part"), (F.sum("count").over(W.orderBy("__part")) - F.col("count")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn("priority", (F.col("__before") + F.col("__in") + 1).cast("long")).drop("__part", "__in", "__before")


def held(rows: DataFrame, **named: Column) -> DataFrame:
    """rows with columns that Spark takes once for each row: a filter on them stays behind a generator, and is neither
    pushed below a grouping or a join, where rows are many, nor has the expression copied into it."""
    for name, value in named.items():
        rows = rows.select(*(c for c in rows.columns if c != name), F.explode_outer(F.array(value)).alias(name))
    return rows


def acquired(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Rows of queries of acquisition intent."""
    return held(rows, __intent=X.intent(F.col("query"), params)).where("__intent = 'acquisition'").drop("__intent")


def query_mix(page_query: DataFrame, as_of, days: int = 90, params: Params = DEFAULT) -> DataFrame:
    """Per page: classified and acquisition impressions, their share, top acquisition query, whether it qualifies."""
    pairs = totals(window(page_query, as_of, days), "page", "query").withColumn("acquired", X.intent(F.col("query"), params) == "acquisition")
    mine = F.when(F.col("acquired"), F.struct(F.col("impressions"), (-F.col("position")).alias("n"), F.col("query"), F.col("position")))
    mix = pairs.groupBy("page").agg(F.sum("impressions").alias("classified"), F.sum(F.when(F.col("acquired"), F.col("impressions")).otherwise(0.0)).alias("acquisition"), F.max(mine).alias("top"))
    mix = mix.withColumn("share", X.ratio(F.col("acquisition"), F.col("classified")))
    qualifies = (F.col("classified") > 0) & (F.col("share") >= 0.5) & (F.col("acquisition") >= 25)
    return mix.select("page", "classified", "acquisition", "share", F.col("top.query").alias("top_query"), F.col("top.position").alias("top_position"), qualifies.alias("qualifies"))


def striking_distance(page_daily, page_query, as_of, days: int = 90, least: float = 50, params: Params = DEFAULT) -> DataFrame:
    pages = totals(window(page_daily, as_of, days), "page").where((F.col("impressions") >= least) & F.col("position").between(8, 30))
    joined = pages.join(query_mix(page_query, as_of, days, params).where("qualifies"), "page")
    return joined.select("page", "clicks", "impressions", "position", "top_query", (F.abs(F.col("top_position") - F.col("position")) >= 8).alias("drift"))


def ctr_underperformers(page_daily, page_query, as_of, days: int = 90, least: float = 100, params: Params = DEFAULT) -> DataFrame:
    pages = totals(window(page_daily, as_of, days), "page").where((F.col("impressions") >= least) & (F.col("position") <= 10))
    joined = pages.join(query_mix(page_query, as_of, days, params), "page", "left")
    kept = F.coalesce("qualifies", F.lit(False))
    low = X.ratio(F.col("clicks"), F.col("impressions")) < 0.5 * X.expected_ctr_flat(F.col("position"))
    return joined.where(~kept | low).select("page", F.when(kept, F.col("acquisition")).otherwise(F.col("impressions")).alias("impressions"), "clicks", "position", F.when(kept, "underperforms").otherwise("dropped").alias("outcome"))


def content_gaps(query_daily, as_of, days: int = 90, least: float = 40, params: Params = DEFAULT) -> DataFrame:
    found = totals(window(query_daily, as_of, days), "query").where((F.col("impressions") >= least) & (F.col("position") > 30))
    return acquired(found, params).select("query", "clicks", "impressions", "position")


def opportunity_report(page_daily, query_daily, page_query, as_of, days: int = 90, params: Params = DEFAULT) -> DataFrame:
    a = striking_distance(page_daily, page_query, as_of, days, params=params).select(F.lit("striking").alias("kind"), F.col("page").alias("target"), "impressions", "position")
    b = ctr_underperformers(page_daily, page_query, as_of, days, params=params).where("outcome = 'underperforms'").select(F.lit("ctr").alias("kind"), F.col("page").alias("target"), "impressions", "position")
    c = content_gaps(query_daily, as_of, days, params=params).select(F.lit("gap").alias("kind"), F.col("query").alias("target"), "impressions", "position")
    return a.unionByName(b).unionByName(c)


def best_page(page_query, as_of, days: int) -> DataFrame:
    pairs = totals(window(page_query, as_of, days), "page", "query")
    return top_row(pairs, "query", F.desc("impressions"), "page").select("query", "page", F.col("position").alias("page_position"))


def actions(query_daily, page_query, as_of, days: int = 90, least: float = 15, params: Params = DEFAULT) -> DataFrame:
    """Queries of acquisition intent with the gain of reaching the first page, in no order."""
    asked = acquired(totals(window(query_daily, as_of, days), "query").where(F.col("impressions") >= least), params)
    rows = asked.join(best_page(page_query, as_of, days), "query", "left").withColumn("at", F.coalesce(F.when(F.col("page_position") != 0, F.col("page_position")), F.col("position")))
    far = F.col("at") > 40
    gain = F.col("impressions") * (F.lit(0.06) - X.expected_ctr(F.col("at"))) * F.when(far, 0.3).otherwise(1.0)
    return rows.where(F.col("at") >= 10).select(F.when(far, "too-far").otherwise("improve-page").alias("kind"), "query", F.coalesce("page", F.lit("(no page ranks)")).alias("target"), "impressions", F.col("at").alias("position"), X.search_page(F.col("at")).alias("search_page"), F.round(gain, 6).alias("gain"))


def brief(query_daily, page_query, as_of, days: int = 90, least: float = 15, params: Params = DEFAULT) -> DataFrame:
    """Ranked actions, those of the largest gain first."""
    return ranked(actions(query_daily, page_query, as_of, days, least, params), F.desc("gain"), F.asc("query"))


def pages_ranking(page_query, as_of, days: int = 90, least: float = 1) -> DataFrame:
    return totals(window(page_query, as_of, days), "query", "page").where(F.col("impressions") >= least)


def cannibalised(page_query, as_of, days: int = 90, least: float = 20, params: Params = DEFAULT) -> DataFrame:
    pairs = totals(window(page_query, as_of, days), "query", "page")
    found = pairs.groupBy("query").agg(F.count("*").alias("pages"), F.sum("impressions").alias("impressions"), F.count(F.when(F.col("impressions") >= 1, 1)).alias("shown"), F.min(F.when(F.col("impressions") >= 1, F.col("position"))).alias("best_position"))
    found = found.where((F.col("pages") >= 2) & (F.col("impressions") >= least) & (F.col("shown") >= 2))
    return acquired(found, params).select("query", "shown", "impressions", "best_position")


def cannibal_pages(page_query, as_of, days: int = 90, least: float = 20, params: Params = DEFAULT) -> DataFrame:
    """The pages behind each cannibalised query that were shown: (query, page, clicks, impressions, position), a row each."""
    asked = cannibalised(page_query, as_of, days, least, params).select("query")
    return pages_ranking(page_query, as_of, days).join(asked, "query", "left_semi").select("query", "page", "clicks", "impressions", "position")


def won(queries: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row: clicks and position of all acquisition queries. Facts are added up by query before intents are asked for."""
    weighted = F.sum(F.col("impressions") * F.col("position")).alias("weighted")
    asked = acquired(queries.groupBy("query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), weighted), params)
    return asked.agg(F.sum("clicks").alias("clicks"), (F.sum("weighted") / F.nullif(F.sum("impressions"), F.lit(0.0))).alias("position"))


def excluded(query_daily, as_of, days: int = 90, least: float = 15, params: Params = DEFAULT) -> DataFrame:
    asked = totals(window(query_daily, as_of, days), "query").where(F.col("impressions") >= least)
    return held(asked, intent=X.intent(F.col("query"), params)).where("intent <> 'acquisition'").groupBy("intent").agg(F.count("*").alias("queries"), F.sum("impressions").alias("impressions"))


def merge_candidates(page_daily, page_query, index_status, as_of, days: int = 90, shared: int = 5) -> DataFrame:
    """Pairs of indexed blog pages that answer the same queries, where one outranks the other clearly.

    Facts are added up per (page, query) first. Two pages that share `shared` queries share one of all but the last
    shared - 1 of either, in any order that is the same for both; with rare queries first, few pages meet on a query that
    many share, and pages of fewer queries on none. Only pairs that meet so are counted.
    """
    blog = F.col("page").ilike("%/blog/%")
    pairs = totals(window(page_query, as_of, days).where(blog), "page", "query").select("page", "query", "impressions")
    often = pairs.groupBy("query").agg(F.count("*").alias("often"))
    rare_first = W.partitionBy("page").orderBy("often", "query")
    placed = pairs.join(often, "query").withColumns({"at": F.row_number().over(rare_first), "of": F.count("*").over(W.partitionBy("page"))})
    first = placed.where((F.col("often") > 1) & (F.col("at") <= F.col("of") - (shared - 1))).select("page", "query")
    meet = first.select(F.col("page").alias("a"), "query").join(first.select(F.col("page").alias("b"), "query"), "query").where("a < b").select("a", "b").distinct()
    a, b = (pairs.select(F.col("page").alias(x), "query", F.col("impressions").alias(f"i{x}")) for x in "ab")
    both = meet.join(a, "a").join(b, ["b", "query"]).groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("ia") + F.col("ib")).alias("shared_impressions")).where(F.col("shared") >= shared)
    stats = totals(window(page_daily, as_of, days).where(blog), "page").join(index_status.where("indexed = 1").select(F.col("url").alias("page")).distinct(), "page", "left_semi")
    s = {x: stats.select(F.col("page").alias(x), F.struct(F.col("page"), F.col("clicks"), F.col("impressions"), F.col("position")).alias(f"s{x}")) for x in "ab"}
    rows = both.join(s["a"], "a").join(s["b"], "b")
    larger = F.expr("sa.impressions > sb.impressions or (sa.impressions = sb.impressions and sa.page < sb.page)")
    rows = rows.withColumn("w", F.when(larger, F.col("sa")).otherwise(F.col("sb"))).withColumn("l", F.when(larger, F.col("sb")).otherwise(F.col("sa")))
    rows = rows.where("l.clicks <= 0 and w.position < l.position and l.impressions <> 0 and w.impressions / l.impressions >= 1.5")
    return rows.select(F.col("w.page").alias("winner"), F.col("l.page").alias("loser"), "shared", "shared_impressions")


def dead_clusters(inventory, index_status, page_daily, as_of, days: int = 90, least_pages: int = 5, most: float = 1.0, params: Params = DEFAULT) -> DataFrame:
    """Slug prefixes of blog pages in the sitemap that nobody is shown and nobody clicks."""
    recent = page_daily.where(F.col("date") >= F.date_sub(F.lit(as_of), days)).groupBy(F.col("page").alias("url")).agg(F.sum("impressions").alias("i"), F.sum("clicks").alias("c"))
    pages = inventory.where((F.col("in_sitemap") == 1) & F.col("url").ilike("%/blog/%")).select("url")
    joined = pages.join(index_status.select("url", "indexed"), "url", "left").join(recent, "url", "left")
    joined = held(joined, prefix=X.slug_prefix(F.col("url"))).where("prefix <> ''")
    for p in params.protected_prefixes:
        joined = joined.where(~F.col("prefix").startswith(p))
    found = joined.groupBy("prefix").agg(F.count("*").alias("pages"), F.sum(F.coalesce("indexed", F.lit(0))).alias("indexed"), F.sum(F.coalesce("i", F.lit(0.0))).alias("impressions"), F.sum(F.coalesce("c", F.lit(0.0))).alias("clicks"))
    return found.where((F.col("pages") >= least_pages) & (F.col("clicks") <= 0) & (F.col("impressions") / F.col("pages") <= most)).withColumn("prefix", F.concat("prefix", F.lit("-")))


def dead_pages(inventory: DataFrame, dead: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(prefix, url, path) of each page that a prune of dead(prefix) takes off: what its action has to name."""
    pages = inventory.where((F.col("in_sitemap") == 1) & F.col("url").ilike("%/blog/%"))
    named = held(pages.select("url", F.replace("url", F.lit(params.site), F.lit("")).alias("path")), prefix=F.concat(X.slug_prefix(F.col("url")), F.lit("-"))).select("prefix", "url", "path")
    return named.join(dead.select("prefix"), "prefix", "left_semi")


def orphans(live: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(url): pages that are live and in no sitemap, each once. A null URL is none."""
    return live.select("url").where("url is not null").distinct().join(sitemap.select("url"), "url", "left_anti")


def sitemap_problems(urls: DataFrame, dead_urls: DataFrame) -> DataFrame:
    marked = urls.select("url").join(dead_urls.select("url").distinct().withColumn("dead", F.lit(True)), "url", "left")
    return marked.withColumn("reason", F.when(X.is_pagination(F.col("url")), "pagination").when(F.col("dead"), "dead")).where("reason is not null").select("url", "reason")


def suspect_urls(inventory, index_status) -> DataFrame:
    state = F.lower("coverage_state")
    return inventory.where("in_sitemap = 1").join(index_status, "url").where(X.contains_any(state, ("not found", "redirect", "excluded"))).select("url", "coverage_state")


def delist_survivors(page_daily, as_of, days: int = 90, least: float = 5, params: Params = DEFAULT) -> DataFrame:
    rows = page_daily.where(F.col("date") >= F.date_sub(F.lit(as_of), days)).where(X.cluster(F.col("page"), params).isin(*params.retired_clusters))
    return rows.groupBy("page").agg(F.sum("impressions").alias("impressions")).where(F.col("impressions") >= least).select(F.replace("page", F.lit(params.site), F.lit("")).alias("path"), "impressions")


def noindex_rules(clusters: DataFrame, paths: DataFrame, existing: DataFrame) -> DataFrame:
    """(source) of directives to add: a glob for each cluster, each path, minus those that exist."""
    wanted = clusters.select(F.concat(F.lit("/"), F.col("cluster"), F.lit("/:path*")).alias("source")).union(paths.select("path")).distinct()
    return wanted.join(existing, "source", "left_anti")


def redirect_rules(rules: DataFrame, existing: DataFrame) -> DataFrame:
    """rules(source, destination) with status 301 and a reason for rejection, null if valid."""
    known = existing.select("source").distinct()
    rows = rules.join(known.withColumn("there", F.lit(True)), "source", "left").join(known.union(rules.select("source")).distinct().select(F.col("source").alias("destination"), F.lit(True).alias("chained")), "destination", "left")
    reason = F.when(~F.col("source").startswith("/") | ~F.col("destination").startswith("/"), "not absolute").when(F.col("source") == F.col("destination"), "loop").when(F.col("there"), "exists").when(F.col("chained"), "chain")
    return rows.select("source", "destination", F.lit(301).alias("status"), reason.alias("rejected"))


def onpage_candidates(page_daily, page_query, as_of, days: int = 90, params: Params = DEFAULT) -> DataFrame:
    """Blog pages whose first acquisition query of their ten largest could get more clicks (meta) or ranks low (faq)."""
    page = F.col("page")
    pages = totals(window(page_daily, as_of, days).where(page.ilike("%/blog/%")), "page").where(F.col("impressions") >= 20)
    name = X.slug(page)
    pages = pages.where((name != "") & ~name.isin("index", "blog") & ~name.rlike(r"^\d+$") & ~F.contains(page, F.lit("/blog/page/")))
    pairs = totals(window(page_query, as_of, days), "page", "query").withColumn("n", F.row_number().over(W.partitionBy("page").orderBy(F.desc("impressions"), "query"))).where("n <= 10")
    mine = top_row(pairs.where((X.intent(F.col("query"), params) == "acquisition") & (F.col("query") != "")), "page", "n").select("page", "query", F.col("position").alias("qp"))
    rows = pages.join(mine, "page").withColumn("at", F.coalesce("qp", "position"))
    ctr, due, i = X.ratio(F.col("clicks"), F.col("impressions")), X.expected_ctr(F.col("at")), F.col("impressions")
    meta, faq = (F.col("at") <= 20) & (ctr < due * 0.6), F.col("at").between(10, 40)
    rows = rows.withColumn("kind", F.when(meta, "meta").when(faq, "faq")).where("kind is not null")
    return rows.select("page", "query", "kind", "impressions", F.col("at").alias("query_position"), F.round(F.when(meta, i * (due - ctr)).otherwise(i * (0.06 - due) * 0.3), 6).alias("gain"))


def inspection_rotation(inventory, index_status, n: int = 300) -> DataFrame:
    """The sitemap URLs to check next: never checked first, then the oldest."""
    joined = inventory.where("in_sitemap = 1").join(index_status.select("url", "checked_at"), "url", "left")
    return joined.orderBy(F.asc_nulls_first("checked_at"), "url").limit(n).select("url", "checked_at")


def orphan_sample(inventory, index_status, per_cluster: int = 5) -> DataFrame:
    unseen = inventory.where("in_sitemap = 0").join(index_status, "url", "left_anti")
    return unseen.withColumn("n", F.row_number().over(W.partitionBy("cluster").orderBy("url"))).where(F.col("n") <= per_cluster).select("cluster", "url", F.col("n").cast("long").alias("n"))


def build_inventory(sitemap: DataFrame, local: DataFrame, seen_at, params: Params = DEFAULT) -> DataFrame:
    listed = sitemap.select("url").distinct().withColumn("listed", F.lit(1))
    urls = sitemap.select("url").union(local.select("url")).distinct().join(listed, "url", "left")
    return urls.select("url", X.cluster(F.col("url"), params).alias("cluster"), F.coalesce("listed", F.lit(0)).alias("in_sitemap"), F.lit(seen_at).alias("first_seen"))


def index_health(inventory, index_status) -> DataFrame:
    """Indexation of sitemap URLs by cluster, and in total (cluster null)."""
    joined = inventory.where("in_sitemap = 1").join(index_status.select("url", "indexed"), "url", "left")
    return joined.rollup("cluster").agg(F.count("*").alias("in_sitemap"), F.count("indexed").alias("checked"), F.sum(F.coalesce("indexed", F.lit(0))).alias("indexed"))


def trend(health: DataFrame) -> DataFrame:
    """First and last indexed share of a dated series and its direction, at half a point."""
    daily = health.groupBy("date").agg((F.sum("indexed") * 100.0 / F.nullif(F.sum("in_sitemap"), F.lit(0))).alias("pct"))
    ends = daily.agg(F.min_by("pct", "date").alias("first"), F.max_by("pct", "date").alias("last"))
    step = F.col("last") - F.col("first")
    return ends.withColumn("direction", F.when(step > 0.5, "improving").when(step < -0.5, "falling").otherwise("flat"))


def windows(page_daily, query_daily, n: int = 3, days: int = 28) -> DataFrame:
    """The last n spans of `days` days, each table counted back from its own last date."""

    def spans(facts, key, name):
        last = facts.agg(F.max("date").alias("last"))
        placed = facts.join(F.broadcast(last), F.lit(True)).withColumn("bucket", F.floor(F.datediff("last", "date") / days)).where(F.col("bucket") < n)
        return placed.groupBy("bucket").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), wavg().alias("position"), F.count_distinct(F.when(F.col("clicks") > 0, F.col(key)) if key == "page" else F.col(key)).alias(name))

    pages = spans(page_daily, "page", "earning_pages")
    asked = spans(query_daily, "query", "queries").select("bucket", "queries")
    return pages.join(asked, "bucket", "left").withColumn("ctr", X.ratio(F.col("clicks") * 100, F.col("impressions")))


def monthly(page_daily) -> DataFrame:
    months = page_daily.groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.count_distinct("date").alias("covered"))
    whole = F.day(F.last_day("month"))
    return months.withColumn("days", whole.cast("long")).withColumn("partial", F.col("covered") < whole)


def composition(query_daily, as_of, days: int = 90, params: Params = DEFAULT) -> DataFrame:
    asked = window(query_daily, as_of, days).withColumn("intent", X.intent(F.col("query"), params))
    return asked.groupBy("intent").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), wavg().alias("position"), F.count_distinct("query").alias("queries"))


def grain_reconciliation(page_query) -> DataFrame:
    """Totals at each grain, to show rows that a finer one withholds."""
    return page_query.groupingSets([[], ["page"], ["query"], ["page", "query"]], "page", "query").agg(F.grouping_id().alias("grain"), F.sum("impressions").alias("i")).groupBy("grain").agg(F.count("*").alias("rows"), F.sum("i").alias("impressions"))


def daily(page_daily, digits: int = 2) -> DataFrame:
    return totals(page_daily, "date").withColumn("position", F.bround("position", digits))


def query_rows(query_daily: DataFrame, digits: int = 2, params: Params = DEFAULT) -> DataFrame:
    """Each query by day with its intent; missing measures are 0, positions rounded half to even."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return query_daily.select("date", "query", zero("clicks").alias("clicks"), zero("impressions").alias("impressions"), F.bround(zero("position"), digits).alias("position"), X.intent(F.col("query"), params).alias("intent"))


def page_rows(page_daily: DataFrame, digits: int = 2, params: Params = DEFAULT) -> DataFrame:
    """Each page by day under its path, "/" for the site itself or a page without URL; missing measures are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    path = F.replace(F.coalesce("page", F.lit("")), F.lit(params.site), F.lit(""))
    return page_daily.select("date", F.when(path == "", "/").otherwise(path).alias("path"), zero("clicks").alias("clicks"), zero("impressions").alias("impressions"), F.bround(zero("position"), digits).alias("position"))


def head_positions(striking: DataFrame, page_query: DataFrame) -> DataFrame:
    """striking with the all-time position of each page's top query."""
    ever = totals(page_query, "page", "query").select("page", F.col("query").alias("top_query"), F.col("position").alias("head_position"))
    return striking.join(ever, ["page", "top_query"], "left")
