"""Answer-engine rates and gaps, citation targets, and the action ledger's budgets and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.functions import text as X
from searchloom.params import DEFAULT, Params

NAMES = "array<string>"


def since(rows: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Rows from the start of the day `days` days before as_of on."""
    return rows.where(F.col(ts) >= F.date_trunc("day", F.lit(as_of) - F.make_dt_interval(F.lit(days))))


def panel_rates(probes: DataFrame, *by: str) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    return probes.groupBy(*by).agg(F.count("*").alias("probes"), (F.sum("mentioned") * 100.0 / n).alias("mentioned_pct"), (F.sum("cited") * 100.0 / n).alias("cited_pct"))


def aeo_gaps(probes: DataFrame, as_of, days: int = 90, least: int = 2, strict: bool = False) -> DataFrame:
    """Questions that answers never name us for, and whom they name: the union over runs, or (strict) the largest string."""
    rows = since(probes, "ts", as_of, days)
    agg = rows.groupBy("question_id").agg(F.count("*").alias("runs"), F.sum("mentioned").alias("m"), F.max_by("question", "competitors").alias("question"), F.max("competitors").alias("largest"))
    named = rows.select("question_id", F.explode(F.from_json("competitors", NAMES)).alias("c")).groupBy("question_id").agg(F.sort_array(F.collect_set("c")).alias("names"))
    agg = agg.where((F.col("runs") >= least) & (F.col("m") == 0)).join(named, "question_id", "left")
    names = F.from_json("largest", NAMES) if strict else F.coalesce("names", F.array().cast(NAMES))
    return agg.select("question_id", "question", "runs", F.array_join(names, ", ").alias("competitors"), F.size(names).cast("long").alias("gain"))


def outreach_targets(citations: DataFrame, probes: DataFrame, as_of, days: int = 30, least: int = 2, params: Params = DEFAULT) -> DataFrame:
    """Cited domains worth writing to, with the competitors named for the questions that they were cited for."""
    rows = since(citations, "ts", as_of, days).where((F.col("domain") != "") & ~X.is_skipped_domain(F.col("domain"), params))
    agg = rows.groupBy("domain").agg(F.count("*").alias("hits"), F.min("url").alias("url"), F.max("title").alias("title")).where(F.col("hits") >= least)
    named = since(probes, "ts", as_of, days).select("question_id", F.explode(F.from_json("competitors", NAMES)).alias("c")).distinct()
    comps = rows.select("domain", "question_id").distinct().join(named, "question_id").groupBy("domain").agg(F.count_distinct("c").alias("n"), F.array_join(F.sort_array(F.collect_set("c")), ", ").alias("competitors"))
    joined = agg.join(comps, "domain", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.col("hits") * 2 + F.col("n") * 1.5 + F.when(X.is_listicle(F.col("title"), F.col("url"), params), 4).otherwise(0)
    return joined.select("domain", "url", "title", "hits", F.coalesce("competitors", F.lit("")).alias("competitors"), score.cast("double").alias("score"))


def top_cited(citations: DataFrame, n: int = 10) -> DataFrame:
    return citations.groupBy("domain").agg(F.count("*").alias("citations")).orderBy(F.desc("citations"), "domain").limit(n)


def ledger_summary(ledger: DataFrame, as_of, days: int = 30) -> DataFrame:
    return since(ledger, "created", as_of, days).groupBy("kind", "status").agg(F.count("*").alias("n"))


def recent(ledger: DataFrame, n: int = 5) -> DataFrame:
    """The last n items of each kind, with the source that their meta names."""
    rows = ledger.withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("id")))).where(F.col("n") <= n)
    return rows.select("kind", "id", "status", F.coalesce(F.get_json_object("meta", "$.source"), F.lit("gsc")).alias("source"), F.col("n").cast("long").alias("n"))


def cooling_down(ledger: DataFrame, as_of, days: int = 30, kinds=("meta", "faq", "post")) -> DataFrame:
    rows = ledger.where(F.col("kind").isin(*kinds) & (F.col("created") >= F.lit(as_of) - F.make_dt_interval(F.lit(days))))
    return rows.select(F.get_json_object("meta", "$.slug").alias("slug")).where("slug is not null").distinct()


def budgets(ledger: DataFrame, as_of) -> DataFrame:
    """One row: what was shipped and is queued, and what may be planned: posts 1 a day and 7 a week, page edits 2 at once and 5 a week."""
    shipped, day, week = F.col("status") == "shipped", F.to_date("decided_at") == F.to_date(F.lit(as_of)), F.col("decided_at") >= F.lit(as_of) - F.make_dt_interval(F.lit(7))
    post, edit, queued = F.col("kind") == "post", F.col("kind").isin("meta", "faq"), F.col("status") == "planned"
    c = {"posts_today": post & shipped & day, "posts_week": post & shipped & week, "posts_queued": post & queued, "edits_week": edit & shipped & week, "edits_queued": edit & queued}
    row = ledger.agg(*(F.count_if(v).alias(k) for k, v in c.items()))
    least = lambda a, b: F.greatest(F.lit(0), F.least(a, b))
    return row.withColumn("post_budget", least(1 - F.col("posts_today") - F.col("posts_queued"), 7 - F.col("posts_week") - F.col("posts_queued"))).withColumn("edit_budget", least(2 - F.col("edits_queued"), 5 - F.col("edits_week") - F.col("edits_queued")))


def stale(ledger: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Planned items older than `days` whole days."""
    age = F.floor((F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("created")) / 86400)
    return ledger.where("status = 'planned'").withColumn("age", age.cast("long")).where(F.col("age") > days).select("id", "kind", "age")


def changed_urls(ledger: DataFrame) -> DataFrame:
    """The paths that shipped items changed: a page each for post, meta and faq, the index for posts, and where a merge leads."""
    rows = ledger.where("status = 'shipped'").withColumn("slug", F.get_json_object("meta", "$.slug"))
    paths = F.when(F.col("kind") == "post", F.array(F.concat(F.lit("/blog/"), "slug"), F.lit("/blog"))).when(F.col("kind").isin("meta", "faq"), F.array(F.concat(F.lit("/blog/"), "slug"))).when(F.col("kind") == "merge", F.array(F.get_json_object("meta", "$.destination")))
    return rows.select(F.explode(paths).alias("path")).where("path is not null").distinct()


def select_edits(candidates: DataFrame, cooling: DataFrame, budget: int, with_faq: DataFrame | None = None) -> DataFrame:
    """The first `budget` on-page candidates by gain whose pages are not cooling down; a page of with_faq(slug) needs no FAQ."""
    free = candidates.withColumn("slug", X.slug(F.col("page"))).join(cooling, "slug", "left_anti")
    if with_faq is not None:
        free = free.join(with_faq.select("slug", F.lit("faq").alias("kind")).distinct(), ["slug", "kind"], "left_anti").select(free.columns)
    return free.orderBy(F.desc("gain"), "page").limit(budget)


def answer_flags(answers: DataFrame, brand: str, domain: str, competitors) -> DataFrame:
    """answers(.., text, citations) with mentioned and cited (0 or 1) and competitors, those named, in their given order.

    Names are looked for literally, whatever their case; a citation counts by its domain or its title.
    """
    low, named = F.lower("text"), F.array(*map(F.lit, competitors)) if competitors else F.array().cast(NAMES)
    ours = lambda c: F.contains(X.citation_domain(c["uri"], c["title"]), F.lit(domain)) | F.contains(F.lower(c["title"]), F.lit(domain))
    return answers.withColumns({
        "mentioned": F.contains(low, F.lit(brand.lower())).cast("int"),
        "cited": F.exists("citations", ours).cast("int"),
        "competitors": F.to_json(F.filter(named, lambda c: F.contains(low, F.lower(c)))),
    })


def probe_facts(flagged: DataFrame, most: int = 8000) -> DataFrame:
    """Probe rows of answer_flags(): the answer's text is cut."""
    return flagged.select("id", "ts", "question_id", "mentioned", "cited", "competitors", F.substring("text", 1, most).alias("answer"))


def citation_facts(answers: DataFrame, most: int = 300) -> DataFrame:
    rows = answers.select("ts", "question_id", F.explode("citations").alias("c"))
    return rows.select("ts", "question_id", F.col("c.uri").alias("url"), X.citation_domain(F.col("c.uri"), F.col("c.title")).alias("domain"), F.substring("c.title", 1, most).alias("title"))


def panel_check(probes: DataFrame, questions: DataFrame, repeats: int, least: float = 0.75) -> DataFrame:
    """One row: probes returned and attempted, and whether enough came back for the rates to be trusted."""
    row = probes.agg(F.count("*").alias("returned")).crossJoin(F.broadcast(questions.agg((F.count("*") * repeats).alias("attempted"))))
    return row.withColumn("trusted", (F.col("attempted") == 0) | (F.col("returned") >= F.col("attempted") * least))


def mark_listed(targets: DataFrame, citations: DataFrame, token: str) -> DataFrame:
    """targets with `listed`: whether their domain is a cited one that holds the site's own token."""
    own = citations.where(F.col("domain").ilike(f"%{token}%")).select("domain").distinct().withColumn("__l", F.lit(True))
    return targets.join(own, "domain", "left").withColumn("listed", F.coalesce("__l", F.lit(False))).drop("__l")


def funnel(targets: DataFrame) -> DataFrame:
    """How many targets are in each state, and in all (state null)."""
    return targets.rollup("state").agg(F.count("*").alias("targets"), F.count("listed_at").alias("ever_listed"))


def stored(targets: DataFrame, state: str | None = None, n: int | None = None) -> DataFrame:
    """Targets, of one state if given, by score, then citations, then url; the first n if given."""
    rows = (targets.where(F.col("state") == state) if state else targets).orderBy(F.desc("score"), F.desc("citations"), "url")
    return rows.limit(n) if n else rows


def unhandled(found: DataFrame, targets: DataFrame) -> DataFrame:
    """The found targets that nobody has dealt with yet."""
    return found.join(targets.where("state <> 'new'").select("url"), "url", "left_anti")


def answer_summary(probes: DataFrame) -> DataFrame:
    return probes.agg(F.count("*").alias("probes"), F.coalesce(F.sum("mentioned"), F.lit(0)).alias("mentioned"), F.coalesce(F.sum("cited"), F.lit(0)).alias("cited"))


def pitch(competitors: Column, claim: str) -> Column:
    """What to write to a site whose page names these competitors (comma separated), the first three of them."""
    first = F.array_join(F.slice(F.split(competitors, ", "), 1, 3), ", ")
    return F.when(competitors == "", F.lit(f"Lead with the claim: {claim}.")).otherwise(F.concat(F.lit("The page covers "), first, F.lit(f" but nothing that offers {claim}.")))
