"""Dated series without gaps, and the strategy row that rests on them. Windows run over counts, never over single URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.functions import text as X
from searchloom.operators import outreach, search
from searchloom.params import DEFAULT, Params

# What a run may ship, and how many days a page is left alone.
CAPS = {"posts_per_day": 1, "posts_per_week": 7, "edits_per_run": 2, "edits_per_week": 5, "cooldown_days": 30}


def fill_days(snapshots: DataFrame, by: str, *values: str) -> DataFrame:
    """(date, by, *values): one row a day for each value of `by`, from its first snapshot to the last of all.

    snapshots has one row for each date and value of `by`, null included; a day without one takes the values of the last
    before it, and so does a null. Rows without a date are left out; an empty table gives none.
    """
    dated = snapshots.where("date is not null").select("date", F.struct(by).alias("__of"), *values)
    last = dated.agg(F.max("date").alias("__last"))
    spans = dated.groupBy("__of").agg(F.min("date").alias("__first")).crossJoin(F.broadcast(last))
    days = spans.select("__of", F.explode(F.sequence("__first", "__last")).alias("date"))
    so_far = W.partitionBy("__of").orderBy("date")
    # Structs are compared, so that the null group finds itself.
    joined = days.join(dated, ["__of", "date"], "left")
    return joined.select("date", F.col(f"__of.{by}").alias(by), *(F.last(v, ignorenulls=True).over(so_far).alias(v) for v in values))


def daily_health(inventory: DataFrame, index_status: DataFrame) -> DataFrame:
    """(date, cluster, in_sitemap, checked, indexed): how many of a cluster's sitemap URLs were checked and indexed by each day.

    index_status holds one row for a URL, checked_at its day; URLs without one are never checked. Days on which no URL of
    a cluster was checked carry the counts of the day before. Clusters of which none was ever checked are in no row.
    """
    listed = inventory.where("in_sitemap = 1")
    sizes = listed.groupBy("cluster").agg(F.count("*").alias("in_sitemap"))
    new = listed.join(index_status.select("url", F.to_date("checked_at").alias("date"), "indexed"), "url").where("date is not null")
    new = new.groupBy("cluster", "date").agg(F.count("*").alias("checked"), F.sum(F.coalesce("indexed", F.lit(0))).cast("long").alias("indexed"))
    so_far = W.partitionBy("cluster").orderBy("date")
    totals = new.select("date", "cluster", *(F.sum(c).over(so_far).alias(c) for c in ("checked", "indexed")))
    filled = fill_days(totals, "cluster", "checked", "indexed")
    return filled.join(F.broadcast(sizes), filled["cluster"].eqNullSafe(sizes["cluster"])).select("date", filled["cluster"], "in_sitemap", "checked", "indexed")


def indexation(health: DataFrame, as_of=None, weeks: int = 8) -> DataFrame:
    """(date, indexed, checked, pct) over all clusters of a dated series; with as_of, the last `weeks` weeks alone."""
    rows = health if as_of is None else health.where(F.col("date") >= F.date_sub(F.to_date(F.lit(as_of)), 7 * weeks))
    daily = rows.groupBy("date").agg(F.sum("indexed").alias("indexed"), F.sum("checked").alias("checked"))
    return daily.withColumn("pct", X.ratio(F.col("indexed") * 100.0, F.col("checked")))


def named_coverage(queries: DataFrame, page_daily: DataFrame) -> DataFrame:
    """One row: clicks of all pages, those of them that came with a query, and their share in percent (0 without clicks)."""
    total = page_daily.agg(F.coalesce(F.sum("clicks"), F.lit(0.0)).alias("total_clicks"))
    named = queries.agg(F.coalesce(F.sum("clicks"), F.lit(0.0)).alias("named_clicks"))
    return total.crossJoin(F.broadcast(named)).withColumn("coverage", X.ratio(F.col("named_clicks") * 100, F.col("total_clicks")))


def strategy(ledger: DataFrame, health: DataFrame, queries: DataFrame, as_of, params: Params = DEFAULT) -> DataFrame:
    """One row: the caps, what the last seven days used of them, whether indexation holds, and acquisition.

    health is a dated series of all clusters (daily_health). Indexation holds if its last share is not below its first;
    without a series its dates are null, its numbers 0, and it holds.
    """
    recent = (F.col("status") == "shipped") & (F.to_date("created") >= F.date_sub(F.to_date(F.lit(as_of)), 7))
    kind = F.col("kind")
    used = ledger.agg(F.count_if(recent & (kind == "post")).alias("posts"), F.count_if(recent & kind.isin("meta", "faq")).alias("edits"), F.count_if(recent & kind.isin("prune", "sitemap", "merge")).alias("removed"), F.count_if(F.col("status") == "planned").alias("pending"))
    cooling = outreach.cooling_down(ledger, as_of, CAPS["cooldown_days"]).agg(F.count("*").alias("cooling"))
    day = F.struct("pct", "indexed", "checked", "date")
    ends = indexation(health).agg(F.min_by(day, "date").alias("a"), F.max_by(day, "date").alias("b"))
    zero = lambda c, to: F.coalesce(c, F.lit(0).cast(to))
    held = ends.select(F.col("a.date").alias("from_date"), F.col("b.date").alias("to_date"), zero(F.col("a.pct"), "double").alias("first_pct"), zero(F.col("b.pct"), "double").alias("last_pct"), zero(F.col("b.indexed"), "long").alias("indexed"), zero(F.col("b.checked"), "long").alias("checked"), F.coalesce(F.col("b.pct") >= F.col("a.pct"), F.lit(True)).alias("holding"))
    won = search.won(queries, params).select(*(zero(F.col(c), "double").alias(c) for c in ("clicks", "position")))
    caps = (F.lit(n).alias(name) for name, n in CAPS.items())
    return used.crossJoin(F.broadcast(cooling)).crossJoin(F.broadcast(held)).crossJoin(F.broadcast(won)).select(*caps, "*")

