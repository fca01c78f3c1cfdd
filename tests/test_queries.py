"""Every registered query that has SQL, against DuckDB on the smallest tables, and unit examples."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from searchloom.functions import text as X
from searchloom.operators import merge
from searchloom.plans import content, more, rules, search, series
from searchloom.plans.views import TABLES
from searchloom.sources import feeds
from searchloom.streaming import events

SF = "/root/testdata/sf0.001"
assert content and rules and more and series


def plain(rows):
    return sorted(repr(tuple(float(x) if hasattr(x, "as_tuple") else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(search.SQL))
def test_query_matches_sql(spark, duck, name):
    found = search.QUERIES[name](spark, SF)
    want = duck.execute(search.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert plain(found.select(*columns).collect()) == plain(want.fetchall())


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_intents_and_names(spark):
    intents = {"shop vox app": "brand", '"id widgetkit" android': "irrelevant", "journey cloud vs premium": "competitor-internal", "day one alternative": "acquisition", "shopvox vs day one pricing": "brand"}
    assert {q: value(spark, X.intent(F.lit(q))) for q in intents} == intents
    prefix = lambda s: value(spark, X.slug_prefix(F.lit(s)))
    assert prefix("https://x/blog/voice-journal-for-runners") == prefix("https://x/blog/voice-journal-for-anxiety") == "voice-journal-for"
    assert value(spark, X.is_pagination(F.lit("https://x/blog/page/3")))
    assert not value(spark, X.is_skipped_domain(F.lit("notgoogle.com.example.org"))) and value(spark, X.is_skipped_domain(F.lit("m.youtube.com")))
    assert value(spark, X.engine_date(F.lit("/Date(1700000000000)/"))) == datetime.date(2023, 11, 14)
    assert [value(spark, X.expected_ctr(F.lit(p))) for p in (2.5, 3.5, 15.0, 30.0)] == [0.15, 0.08, 0.008, 0.002]
    assert value(spark, X.redact(F.lit("key sk-abcdefghijklmnopqrstuvwx end"))) == "key [REDACTED] end"
    assert value(spark, X.citation_domain(F.lit("https://www.a.org/x"), F.lit("A title"))) == "a.org"


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", "z")], "k int, v string, w string")
    once = merge.merge_into(old, new, ["k"], {"v": "keep", "w": "coalesce_old"})
    assert sorted(once.collect()) == [(1, "a", None), (2, "b", "x"), (3, "d", "z")]
    assert sorted(merge.merge_into(once, new, ["k"], {"v": "keep", "w": "coalesce_old"}).collect()) == sorted(once.collect())


def test_snapshot_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'line\nbreak "quoted"'), (2, None)], "id int, t string")
    feeds.dump(rows, str(tmp_path / "s"), "id")
    assert sorted(feeds.load(spark, str(tmp_path / "s"), "id int, t string", "id").collect()) == sorted(rows.collect())


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job = events.daily_counts(source).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    job.processAllAvailable()
    job.stop()
    assert {(r.day, r.event_type, r.n) for r in spark.table("daily").collect()} == {(r.day, r.event_type, r.n) for r in events.daily_counts(rows).collect()}
