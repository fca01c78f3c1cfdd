"""What a run of the loop may do: selections under caps, holds, submission batches, and status rows of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.operators import outreach, search
from searchloom.functions import text as X
from searchloom.params import DEFAULT, Params

# Kinds of items that a run knows how to apply.
KINDS = ("post", "meta", "faq", "prune", "merge", "sitemap")


def daily_holds(ledger: DataFrame, as_of, cap: int = 1) -> DataFrame:
    """(id, kind, decision): planned posts beyond today's cap are held, unknown kinds dropped, others applied."""
    post, today = F.col("kind") == "post", (F.col("status") == "shipped") & (F.to_date("decided_at") == F.to_date(F.lit(as_of)))
    shipped = ledger.where(post & today).agg(F.count("*").alias("shipped"))
    left = ledger.where("status = 'planned'").select("id", "kind")
    # Only the first `cap` posts can be applied: a top-k, not one window over all.
    first = left.where(post).orderBy("id").limit(cap).withColumn("place", F.row_number().over(W.orderBy("id")))
    free = first.crossJoin(F.broadcast(shipped)).where(F.col("place") + F.col("shipped") <= cap).select("id", F.lit(True).alias("free"))
    decision = F.when(~F.col("kind").isin(*KINDS), "drop").when(post & F.col("free").isNull(), "hold").otherwise("apply")
    return left.join(F.broadcast(free), "id", "left").select("id", "kind", decision.alias("decision"))


def settled(ledger: DataFrame, attempts: DataFrame, as_of, cap: int = 1, days: int = 14) -> DataFrame:
    """(id, kind, outcome) of each planned item of a run that tries them by id: stale, drop, hold, failed or shipped.

    attempts(id, ok) says how publishing ends; items without a row succeed. Items older than `days` whole days are stale
    and kinds that no run knows are dropped. Only posts that succeed use up the day's cap, so that a failed one frees its
    slot: posts are tried up to the one that fills the cap, which is the last of the first few successes (a top-k), and
    held behind it. Posts that shipped today count; without free slots all posts are held.
    """
    post, today = F.col("kind") == "post", (F.col("status") == "shipped") & (F.to_date("decided_at") == F.to_date(F.lit(as_of)))
    ends = attempts.groupBy("id").agg(F.min("ok").alias("__ok"))
    old = outreach.stale(ledger, as_of, days).select("id", F.lit(True).alias("__old"))
    left = ledger.where("status = 'planned'").select("id", "kind").join(ends, "id", "left").join(old, "id", "left")
    left = left.withColumns({"__ok": F.coalesce("__ok", F.lit(True)), "__old": F.coalesce("__old", F.lit(False))})
    shipped = ledger.where(post & today).agg(F.count("*").alias("shipped"))
    first = left.where(post & ~F.col("__old") & F.col("__ok")).orderBy("id").limit(cap).withColumn("place", F.row_number().over(W.orderBy("id")))
    free = F.lit(cap) - F.col("shipped")
    # (until, full): the id of the success that fills the cap; full from the start without free slots.
    filled = shipped.join(F.broadcast(first), F.col("place") == free, "left").select(F.col("id").alias("__until"), (free <= 0).alias("__full"))
    held = post & (F.col("__full") | F.coalesce(F.col("id") > F.col("__until"), F.lit(False)))
    outcome = F.when(F.col("__old"), "stale").when(held, "hold").when(~F.col("kind").isin(*KINDS), "drop").when(F.col("__ok"), "shipped").otherwise("failed")
    return left.crossJoin(F.broadcast(filled)).select("id", "kind", outcome.alias("outcome"))


def submission_batch(paths: DataFrame, most: int = 100, params: Params = DEFAULT) -> DataFrame:
    """The first `most` own-site URLs of changed paths, sorted."""
    return paths.select(F.concat(F.lit(params.site), "path").alias("url")).where(F.col("url").startswith(params.site + "/")).distinct().orderBy("url").limit(most)


def outcomes(ledger: DataFrame) -> DataFrame:
    """What each day of settling did: items by outcome, and the first and last of them."""
    return ledger.where("status <> 'planned'").groupBy(F.to_date("decided_at").alias("day"), F.col("status").alias("outcome")).agg(F.count("*").alias("items"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def policy_status(ledger: DataFrame, as_of) -> DataFrame:
    """One row: budgets with what they rest on, the reason when no post is due, and how many pages are cooling down."""
    row = outreach.budgets(ledger, as_of).crossJoin(F.broadcast(outreach.cooling_down(ledger, as_of).agg(F.count("*").alias("cooling"))))
    reason = F.when(F.col("post_budget") > 0, "free").when(F.col("posts_today") + F.col("posts_queued") >= 1, "daily cap").otherwise("weekly cap")
    return row.withColumn("reason", reason)


def scorecard(ledger: DataFrame, inventory: DataFrame, status: DataFrame, query_daily: DataFrame, as_of) -> DataFrame:
    """One row: the week's shipped items, pages cooling down, share of the sitemap indexed, clicks and position of acquisition queries."""
    week = (F.col("status") == "shipped") & (F.col("decided_at") >= F.lit(as_of) - F.make_dt_interval(F.lit(7)))
    kind = F.col("kind")
    shipped = ledger.agg(F.count_if(week & (kind == "post")).alias("posts"), F.count_if(week & kind.isin("meta", "faq")).alias("edits"), F.count_if(week & kind.isin("prune", "merge")).alias("removed"))
    cooling = outreach.cooling_down(ledger, as_of).agg(F.count("*").alias("cooling"))
    listed = inventory.where("in_sitemap = 1").select("url").join(status, "url", "left")
    held = listed.agg((F.sum(F.coalesce("indexed", F.lit(0))) * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("indexed_pct"))
    return shipped.crossJoin(cooling).crossJoin(held).crossJoin(search.won(query_daily))


def disallowed(paths: DataFrame, path: str, prefixes, names=()) -> DataFrame:
    """Rows whose path lies under no prefix and is no allowed name: any of them rejects a batch."""
    under = F.lit(False)
    for prefix in prefixes:
        under = under | F.col(path).startswith(prefix)
    return paths.where(~(under | F.col(path).isin(*names)) | F.col(path).isNull())


def missing_pages(changed: DataFrame, inventory: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(path, problem): changed paths without a page, or whose page is not in the sitemap."""
    urls = changed.select("path", F.concat(F.lit(params.site), "path").alias("url"))
    joined = urls.join(inventory.groupBy("url").agg(F.max("in_sitemap").alias("listed")), "url", "left")
    problem = F.when(F.col("listed").isNull(), "no page").when(F.col("listed") == 0, "not in sitemap")
    return joined.select("path", problem.alias("problem")).where("problem is not null")


def planned(ledger: DataFrame, kind: str | None = None) -> DataFrame:
    rows = ledger.where("status = 'planned'")
    return (rows.where(F.col("kind") == kind) if kind else rows).orderBy("id")


def in_clusters(inventory: DataFrame, clusters, n: int = 200) -> DataFrame:
    """The first n URLs of some clusters: what a corpus is built from."""
    return inventory.where(F.col("cluster").isin(*clusters)).select("url").orderBy("url").limit(n)


def select_posts(actions: DataFrame, gaps: DataFrame, ledger: DataFrame, live: DataFrame, ranking: DataFrame, as_of, budget: int, corpus: DataFrame | None = None) -> DataFrame:
    """The first `budget` queries to write for: (source, query, slug, gain, place).

    actions(kind, query, target, gain) that no blog page of ours answers come first, then gaps(question, gain) of answer
    engines; the other way round if the last two posts shipped both came from search. Slugs written within ten years,
    live(slug) and queries that ranking(query) pages answer are left out. An empty duplication corpus allows no post.
    """
    searched = actions.where((F.col("kind") == "too-far") | ~F.contains("target", F.lit("/blog/"))).select(F.lit("gsc").alias("source"), "query", "gain")
    asked = gaps.select(F.lit("aeo").alias("source"), F.col("question").alias("query"), F.col("gain").cast("double").alias("gain"))
    last = ledger.where("kind = 'post' and status = 'shipped'").orderBy(F.desc("id")).limit(2)
    turn = last.agg((F.count_if(F.coalesce(F.get_json_object("meta", "$.source"), F.lit("gsc")) == "gsc") == 2).alias("aeo_first"))
    rows = searched.union(asked).withColumn("slug", X.slugify(F.col("query")))
    written = outreach.cooling_down(ledger, as_of, 3650, ("post",))
    rows = rows.join(written, "slug", "left_anti").join(live.select("slug"), "slug", "left_anti").join(ranking.select("query").distinct(), "query", "left_anti")
    if corpus is not None:
        rows = rows.crossJoin(F.broadcast(corpus.agg(F.count("*").alias("__corpus")))).where("__corpus > 0").drop("__corpus")
    placed = rows.crossJoin(F.broadcast(turn)).withColumn("channel", ((F.col("source") == "aeo") != F.col("aeo_first")).cast("int"))
    first = placed.orderBy("channel", F.desc("gain"), "query").limit(budget)
    return first.select("source", "query", "slug", "gain", F.row_number().over(W.orderBy("channel", F.desc("gain"), "query")).cast("long").alias("place"))


def select_hygiene(dead: DataFrame, merges: DataFrame, suspects: DataFrame, listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """(kind, target, detail) of what to tidy up: all dead prefixes, the best pair to merge, and URLs to take out of sitemaps.

    Nothing while a prune or sitemap item is queued, and no merge while one is. listed(url): what sitemaps hold.
    """
    queue = ledger.where("status = 'planned'").agg(F.count_if(F.col("kind").isin("prune", "sitemap")).alias("__tidy"), F.count_if(F.col("kind") == "merge").alias("__merge"))
    prune = dead.select(F.lit("prune").alias("kind"), F.col("prefix").alias("target"), F.col("pages").cast("string").alias("detail"))
    merge = merges.orderBy(F.desc("shared_impressions"), "winner", "loser").limit(1).select(F.lit("merge"), "loser", "winner")
    pages = listed.where(X.is_pagination(F.col("url"))).select("url", F.lit("pagination").alias("why"))
    drop = suspects.select("url", F.lit("dead").alias("why")).union(pages).groupBy("url").agg(F.min("why").alias("why")).select(F.lit("sitemap"), "url", "why")
    rows = prune.union(merge).union(drop).crossJoin(F.broadcast(queue))
    return rows.where("__tidy = 0 and (kind <> 'merge' or __merge = 0)").drop("__tidy", "__merge")


def resolve(items: DataFrame, live: DataFrame, with_faq: DataFrame) -> DataFrame:
    """items(id, kind, slug) with outcome: resolved if the change is there already (a live post, a FAQ on its page), else todo."""
    has = lambda df, name: df.select("slug").distinct().withColumn(name, F.lit(True))
    rows = items.join(has(live, "__live"), "slug", "left").join(has(with_faq, "__faq"), "slug", "left")
    done = ((F.col("kind") == "post") & F.col("__live")) | ((F.col("kind") == "faq") & F.col("__faq"))
    return rows.select("id", "kind", "slug", F.when(done, "resolved").otherwise("todo").alias("outcome"))


def freshness(*facts: tuple[str, DataFrame]) -> DataFrame:
    """(name, newest) of each table of facts."""
    rows = [df.agg(F.max("date").alias("newest")).select(F.lit(name).alias("name"), "newest") for name, df in facts]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
