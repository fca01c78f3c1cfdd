"""Dated series, the strategy row and the settling of a run, by hand and against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from searchloom.operators import planning, search, series

D = lambda n: dt.date(2024, 2, n)
AS_OF = dt.datetime(2024, 3, 1, 12)
LEDGER = "id long, created timestamp, kind string, status string, decided_at timestamp, meta string"


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_gaps_take_the_last_values(spark):
    rows = [(D(27), "a", 1, 5), (dt.date(2024, 3, 1), "a", 2, None), (D(28), None, 7, 7), (None, "a", 9, 9), (D(29), "b", 3, 3)]
    shots = spark.createDataFrame(rows, "date date, name string, x long, y long")
    got = set(rows_of(series.fill_days(shots, "name", "x", "y"), "date"))
    want = {(D(27), "a", 1, 5), (D(28), "a", 1, 5), (D(29), "a", 1, 5), (dt.date(2024, 3, 1), "a", 2, 5)}
    want |= {(D(28), None, 7, 7), (D(29), None, 7, 7), (dt.date(2024, 3, 1), None, 7, 7), (D(29), "b", 3, 3), (dt.date(2024, 3, 1), "b", 3, 3)}
    assert got == want
    assert series.fill_days(shots.limit(0), "name", "x", "y").count() == 0


def test_health_by_day_and_series(spark):
    pages = spark.createDataFrame([("u1", "blog", 1), ("u2", "blog", 1), ("u3", "blog", 1), ("u4", "core", 1), ("u5", "core", 0), ("u6", None, 1)], "url string, cluster string, in_sitemap int")
    seen = [("u1", D(1), 1), ("u2", D(4), 0), ("u4", D(3), None), ("u5", D(1), 1), ("u6", D(4), 1), ("u3", None, 1)]
    status = spark.createDataFrame([(u, d and dt.datetime(d.year, d.month, d.day, 23), i) for u, d, i in seen], "url string, checked_at timestamp, indexed int")
    health = series.daily_health(pages, status)
    blog = [(D(n), "blog", 3, 1, 1) for n in (1, 2, 3)] + [(D(4), "blog", 3, 2, 1)]
    assert set(rows_of(health, "date")) == {*blog, (D(3), "core", 1, 1, 0), (D(4), "core", 1, 1, 0), (D(4), None, 1, 1, 1)}
    assert rows_of(series.indexation(health), "date") == [(D(1), 1, 1, 100.0), (D(2), 1, 1, 100.0), (D(3), 1, 2, 50.0), (D(4), 2, 4, 50.0)]
    assert [r.date for r in series.indexation(health, dt.datetime(2024, 2, 17), weeks=2).orderBy("date").collect()] == [D(3), D(4)]
    assert series.daily_health(pages, status.limit(0)).count() == 0


def test_coverage_of_named_clicks(spark):
    facts = spark.createDataFrame([("q", 3.0), (None, None)], "query string, clicks double")
    assert rows_of(series.named_coverage(facts, facts.withColumn("clicks", F.col("clicks") * 4)), "coverage") == [(12.0, 3.0, 25.0)]
    assert rows_of(series.named_coverage(facts.limit(0), facts.limit(0)), "coverage") == [(0.0, 0.0, 0.0)]


def test_strategy(spark):
    day = lambda n: AS_OF - dt.timedelta(days=n)
    rows = [(1, day(7), "post", "shipped", day(7), '{"slug":"a"}'), (2, day(8), "post", "shipped", day(1), '{"slug":"b"}'), (3, day(1), "sitemap", "shipped", None, None), (4, day(1), "faq", "planned", None, '{"slug":"a"}')]
    ledger = spark.createDataFrame(rows, LEDGER)
    asked = spark.createDataFrame([("calm notes", 2.0, 10.0, 4.0), ("shopvox", 9.0, 10.0, 1.0)], "query string, clicks double, impressions double, position double")
    health = spark.createDataFrame([(D(1), "a", 4, 2, 1), (D(2), "a", 4, 4, 1)], "date date, cluster string, in_sitemap long, checked long, indexed long")
    r = series.strategy(ledger, health, asked, AS_OF).first()
    assert (r.posts, r.edits, r.removed, r.pending, r.cooling) == (1, 0, 1, 1, 2)
    assert (r.from_date, r.to_date, r.first_pct, r.last_pct, r.indexed, r.checked, r.holding) == (D(1), D(2), 50.0, 25.0, 1, 4, False)
    assert (r.clicks, r.position, r.posts_per_day, r.cooldown_days) == (2.0, 4.0, 1, 30)
    r = series.strategy(ledger.limit(0), health.limit(0), asked.limit(0), AS_OF).first()
    assert (r.posts, r.from_date, r.checked, r.holding, r.clicks, r.position) == (0, None, 0, True, 0.0, 0.0)


def plain_run(items, ok, shipped, cap):
    out = {}
    for i, created, kind in sorted(items):
        if (AS_OF - created).days > 14:
            out[i] = "stale"
        elif kind == "post" and shipped >= cap:
            out[i] = "hold"
        elif kind not in planning.KINDS:
            out[i] = "drop"
        else:
            out[i] = "shipped" if ok.get(i, True) else "failed"
            shipped += kind == "post" and out[i] == "shipped"
    return out


@pytest.mark.parametrize(("seed", "shipped", "cap"), [(1, 0, 1), (2, 1, 3), (3, 2, 2), (4, 0, 40)])
def test_a_failed_post_frees_its_slot(spark, seed, shipped, cap):
    rng = random.Random(seed)
    items = [(i, AS_OF - dt.timedelta(days=rng.choice((0, 3, 14, 15, 20))), rng.choice(("post", "post", "meta", "merge", "poem"))) for i in range(40)]
    ok = {i: rng.random() < 0.4 for i in range(30)}
    done = [(100 + i, AS_OF, "post", "shipped", AS_OF, None) for i in range(shipped)] + [(200, AS_OF, "post", "shipped", AS_OF - dt.timedelta(days=1), None)]
    ledger = spark.createDataFrame([(i, c, k, "planned", None, None) for i, c, k in items] + done, LEDGER)
    attempts = spark.createDataFrame(list(ok.items()), "id long, ok boolean")
    got = {r.id: r.outcome for r in planning.settled(ledger, attempts, AS_OF, cap).collect()}
    assert got == plain_run(items, ok, shipped, cap)
    assert planning.settled(ledger.limit(0), attempts, AS_OF, cap).count() == 0


def test_report_rows_and_pages_behind_findings(spark):
    site = "https://shop.example.com"
    facts = spark.createDataFrame([(D(1), site, None, 4.0, 1.125), (D(1), None, 1.0, None, None), (D(2), site + "/blog/a", 1.0, 2.0, 3.0)], "date date, page string, clicks double, impressions double, position double")
    want = {(D(1), "/", 0.0, 4.0, 1.12), (D(1), "/", 1.0, 0.0, 0.0), (D(2), "/blog/a", 1.0, 2.0, 3.0)}
    assert set(rows_of(search.page_rows(facts), "date")) == want
    asked = {(r.query, r.intent) for r in search.query_rows(facts.withColumn("query", F.lit("shopvox app"))).collect()}
    assert asked == {("shopvox app", "brand")}
    pairs = [(D(1), p, q, 0.0, i, 5.0) for p, q, i in (("a", "calm notes", 10.0), ("b", "calm notes", 10.0), ("c", "calm notes", 0.0), ("a", "other notes", 40.0), ("a", "shopvox", 20.0), ("b", "shopvox", 20.0))]
    pairs = spark.createDataFrame(pairs, "date date, page string, query string, clicks double, impressions double, position double")
    assert [(r.query, r.page) for r in search.cannibal_pages(pairs, D(2)).orderBy("page").collect()] == [("calm notes", "a"), ("calm notes", "b")]
    pages = spark.createDataFrame([(f"{site}/blog/old-notes-{i}", int(i < 6)) for i in range(7)] + [(f"{site}/blog/new-notes-1", 1), (None, 1)], "url string, in_sitemap int")
    dead = spark.createDataFrame([("old-notes-",)], "prefix string")
    assert {(r.prefix, r.path) for r in search.dead_pages(pages, dead).collect()} == {("old-notes-", f"/blog/old-notes-{i}") for i in range(6)}
    assert [r.url for r in search.orphans(pages.union(pages), pages.where("in_sitemap = 1")).collect()] == [f"{site}/blog/old-notes-6"]
