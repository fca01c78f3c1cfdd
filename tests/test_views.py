"""The facts of all parts: pages, queries and pairs grow with the input."""

from pyspark.sql import functions as F

from searchloom.plans import search
from searchloom.plans.views import table


def counts(spark, size):
    facts = table(spark, f"/root/testdata/{size}", "search_fact", wide=True)
    return facts.agg(F.countDistinct("page"), F.countDistinct("query"), F.countDistinct("page", "query")).first()


def test_pages_queries_and_pairs_grow_with_the_parts(spark):
    small, large = counts(spark, "sf0.001"), counts(spark, "sf0.01")
    assert small[0] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey").distinct().count() > 60
    assert all(b >= 8 * a for a, b in zip(small, large, strict=True))


def test_rankings_hold_pages_beyond_the_first_sixty(spark):
    assert {"brief_all", "striking_distance_all", "content_gaps_all", "dead_clusters_all"} <= set(search.QUERIES)
    assert search.QUERIES["pages_ranking_all"](spark, "/root/testdata/sf0.001").select("page").distinct().count() > 60
    assert search.QUERIES["merge_candidates_all"](spark, "/root/testdata/sf0.01").count() > 0


def test_old_pages_give_dead_prefixes_and_listing_pages(spark):
    size = "/root/testdata/sf0.001"
    dead = search.QUERIES["dead_clusters"](spark, size).collect()
    assert dead and all(r.prefix.startswith("notes-") and r.pages >= 5 and r.impressions == 0 for r in dead)
    assert {r.reason for r in search.QUERIES["sitemap_problems"](spark, size).collect()} == {"dead", "pagination"}
    assert {r.pagination for r in search.QUERIES["url_functions"](spark, size).collect()} == {True, False}
