"""Operators that SQL tells little about: cleaning, gates, page edits, merges, planning, streams."""

import datetime
import html
import json
from html.entities import html5 as html_entities

import pytest
from pyspark.sql import functions as F

from searchloom.functions import text as X
from searchloom.operators import checks, corpus_index, flags, marks, merge, outreach, pages, planning, quality, search, style, tells
from searchloom.params import CTR_CURVE, DEFAULT
from searchloom.sources import feeds, payloads
from searchloom.streaming import events

NOW, LATER = datetime.datetime(2024, 5, 1), datetime.datetime(2024, 5, 2)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_fixed_values():
    assert CTR_CURVE == (0.28, 0.15, 0.11, 0.08, 0.06, 0.05, 0.04, 0.03, 0.028, 0.025)
    assert (len(quality.TIER1), len(style.TIER2), len(style.TIER3), len(style.PHRASES), len(style.ADVERBS)) == (45, 32, 14, 12, 11)
    assert (len(DEFAULT.competitors), len(DEFAULT.internal_markers), len(DEFAULT.comparative), len(DEFAULT.skip_domains), len(DEFAULT.listicle_hints)) == (13, 17, 5, 11, 8)
    assert [len(x) for x in (tells.FINGERPRINTS, tells.HARD_NOS, tells.CREDIBILITY, tells.PATTERNS, tells.TELLS)] == [6, 4, 4, 12, 15]
    assert set(tells.NEEDLES) == {r[0] for r in (*tells.FINGERPRINTS, *tells.HARD_NOS, *tells.CREDIBILITY, *tells.PATTERNS, *tells.TELLS)}
    assert X.brand_tokens("www.getshopvox.com", "shop vox") == ("shopvox",)


RULES = {
    "chat citation markup": ("see cite turn0search1", "it is your turn to cite"),
    "unfilled placeholder": ("Dear [Your Name]", "Dear [you]"),
    "placeholder date": ("on 2024-XX-XX", "on 2024-05-01"),
    "cutoff disclaimer": ("As of my last update", "as of my birthday"),
    "chatbot artifact": ("CERTAINLY!", "certainly."),
    "vague attribution": ("Experts   agree", "experts argue"),
    "let's construction": ("Lets dive", "let us dive"),
    "formulaic opening": ("in the ever-evolving world", "in the world"),
    "hedge stack": ("might eventually", "might go"),
    "generic conclusion": ("Only time will tell", "time will tell"),
    "transition filler": ("a\n  Moreover it", "and moreover it"),
    "worth-verbing": ("worth a look", "worth money"),
    "copula avoidance": ("it serves as one", "it serves one"),
    "hard-no: excited to announce": ("Excited to share", "excited to go"),
    "hard-no: inspirational closer": ("The future is bright", "the future is dim"),
    "hard-no: performed emotion": ("I was thrilled", "she was thrilled"),
    "sycophancy": ("You're absolutely right", "you are right"),
    "tier1 vocabulary": ("a robust one", "robustly"),
}


def test_each_rule_has_its_flag(spark):
    rows = spark.createDataFrame([(f"{rule}/{i}", text) for rule, pair in RULES.items() for i, text in enumerate(pair)], "doc_id string, text string")
    found = {(r.doc_id, r.rule) for r in flags.flag_rows(rows).collect()}
    assert {(f"{rule}/0", rule) for rule in RULES} <= found
    assert not {(f"{rule}/1", rule) for rule in RULES} & found


def test_marks(spark):
    family, persian = "\U0001f468‍\U0001f469", "می‌خ"
    texts = {"zero": "a​b﻿", "blank": "a b", "kept": family + persian, "loose": "a‍b", "pasted": "x citeturn0search3 y", "hole": "[Insert date]", "front": "---\ntitle: a\nModel: x\n---\nbody", "none": None}
    found = {r.k: r for r in marks.sanitise(spark.createDataFrame(list(texts.items()), "k string, text string")).collect()}
    assert {k: r.clean for k, r in found.items()} == {"zero": "ab", "blank": "a b", "kept": family + persian, "loose": "ab", "pasted": "x  y", "hole": "[Insert date]", "front": "---\ntitle: a\n---\nbody", "none": ""}
    assert [(found[k].removed, found[k].replaced, found[k].kept) for k in ("zero", "blank", "kept", "loose")] == [(2, 0, 0), (0, 1, 0), (0, 0, 2), (1, 0, 0)]
    assert {k for k, r in found.items() if r.blocks} == {"hole"} and found["front"]["keys"] == 1 and found["pasted"].pasted == 1


def test_gate_contexts_and_checks(spark):
    tags = "I like it. " + " ".join(f"#t{i}" for i in range(6)) + " (end)"
    rows = spark.createDataFrame([("tags", tags), ("mark", "I fed​ the cat."), ("hole", "I am [Your name].")], "doc_id string, text string")
    gate = lambda context: {r.doc_id: r for r in quality.evaluate(rows, None, context).collect()}
    social, section, blog = gate("social"), gate("section"), gate("blog")
    assert [k for k, r in social.items() if r.passed] == ["mark"] and {k for k, r in section.items() if r.passed} == {"mark", "tags"}
    assert not any(r.passed for r in blog.values())  # all are too short
    assert section["mark"].clean == "I fed the cat." and section["mark"].warnings == ["1 marks stripped"] and section["hole"].reasons == ["unfilled placeholder", "unfilled placeholder: paste-from-chat fingerprint"]
    faq = "## FAQ\n### A one?\nYes.\n### A two?\nNo.\n### A three?\nI said so."
    blocks = spark.createDataFrame([(1, faq), (2, faq.replace("### A two?\nNo.\n", "")), (3, faq[3:-1])], "id int, text string")
    told = faq.replace("I said so.", "Thank me later. It made a decision. Bookmark this. Four key lessons. Worth reading. I delve into a robust realm.")
    blocks = blocks.union(spark.createDataFrame([(4, told)], "id int, text string"))
    found = {r.id: r.problems for r in checks.faq_problems(blocks, spark.createDataFrame([], "url string, text string")).collect()}
    assert found == {1: [], 2: ["not 3 questions"], 3: ["no section heading", "ends in mid-sentence"], 4: ["7 P1 tells — the shape is generated, not the wording"]}
    raw = "```text\nScript: - one *two*\n" + "I fed the cat today. " * 16 + "\n```"
    said = {r.id: r for r in checks.narration_problems(spark.createDataFrame([(1, raw), (2, "short")], "id int, text string")).collect()}
    assert said[1].script.startswith("one two I fed") and said[1].words == 82 and said[2].problems == ["length"]


def test_meta_problems(spark):
    problems = lambda *a: value(spark, checks.meta_problems(*(F.lit(x) for x in a)))
    good = ("A private journal app", "A journal that stays on the phone, with no account, and works in airplane mode.", "journal app")
    assert problems(*good, "Old", "old") == [] and problems("", "x", "q", "", "") == ["missing"]
    assert problems(*good, good[0].upper(), good[1]) == ["identical to what is live"]
    assert problems("a|b|c", "Delve", "journal", "", "") == ["description too short", "banned vocabulary", "title drops the query", "more than one separator"]


HEAD = '<html><head><title>Old</title><meta name="description" content="old"><meta property="og:title" content="o">\n<script type="application/ld+json">{"@type":"BlogPosting","n":1,"headline":"Old"}</script></head><body><article>text</article>\n  <footer></footer></body></html>'


def test_page_edits(spark):
    rows = spark.createDataFrame([(1, "u", HEAD), (2, "v", "no head")], "page_id int, url string, html string")
    changes = spark.createDataFrame([("u", 'A "b" $1 & c', "d'e\\f"), ("v", "t", "d")], "url string, title string, description string")
    found = {r.url: r for r in pages.retitle(rows, changes).collect()}
    page = found["u"].html
    assert "<title>A &quot;b&quot; $1 &amp; c</title>" in page and 'description" content="d&#x27;e\\f"' in page and 'og:title" content="A &quot;b&quot; $1 &amp; c"' in page
    data = json.loads(page.split("ld+json\">")[1].split("</script>")[0])
    assert data == {"@type": "BlogPosting", "n": 1, "headline": 'A "b" $1 & c', "description": "d'e\\f"} and found["v"].outcome == "rejected"
    faq = pages.append_faq(rows, spark.createDataFrame([("u", "### Is <it>?\nYes,\n it is.\n### Empty"), ("v", "### A?\nb")], "url string, block string"))
    added = {r.url: r for r in faq.collect()}
    assert (added["u"].outcome, added["v"].outcome) == ("changed", "rejected")
    assert "<h3>Is &lt;it&gt;?</h3>\n<p>Yes, it is.</p>" in added["u"].html.split("</article>")[0] and '"@type": "FAQPage"' in added["u"].html.split("</head>")[0]
    again = pages.append_faq(faq.select("page_id", "url", "html"), spark.createDataFrame([("u", "### A?\nb")], "url string, block string")).first()
    assert again.outcome == "present"
    block = lambda df, text: pages.insert_block(df, text, "m")
    foot = spark.createDataFrame([(1, "u", "<p>\n  </footer>"), (2, "v", "<!-- m --> </footer>")], "page_id int, url string, html string")
    first = block(foot, "<p>1</p>")
    assert [(r.html, r.outcome) for r in first.collect()] == [("<p>\n  <!-- m --><p>1</p><!-- /m -->\n  </footer>", "changed"), ("<!-- m --> </footer>", "broken")]
    assert [r.outcome for r in block(first, "<p>1</p>").collect()] == ["unchanged", "broken"] and "<p>2</p>" in block(first, "<p>2</p>").first().html


def test_front_matter_versions_and_listing(spark, tmp_path):
    assert value(spark, pages.set_front_value(F.lit("no front"), "title", F.lit("x"))) is None
    drift = lambda a, b: value(spark, pages.version_drift(F.lit(a), F.lit(b)))
    log = "# Changes\n## [2.0] — 2024-02-01\n## [1.0] — 2023-01-01"
    assert drift("- Latest version (as of 2024-01-01): 2.0", log) is None and drift("x", log) == "unreadable"
    assert drift("- Latest version (as of 2023-01-01): 1.0", log) == "declares 1.0 as of 2023-01-01, shipped 2.0 on 2024-02-01"
    for name in ("index.html", "blog/index.html", "blog/a.html", "blog/b.txt"):
        (tmp_path / "public" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "public" / name).write_text("x")
    assert [tuple(r) for r in pages.listing(spark, str(tmp_path / "public"), "https://s").collect()] == [("blog/a.html", "https://s/blog/a"), ("blog/index.html", "https://s/blog"), ("index.html", "https://s/")]
    posts = spark.createDataFrame([("a-b", "<title>T &amp; t</title>"), ("c-d", "x"), ("e", "x")], "slug string, html string")
    found = pages.orphans(posts, spark.createDataFrame([('<a href="/blog/e">',)], "html string")).orderBy("slug").collect()
    assert [tuple(r) for r in found] == [("a-b", "T & t", ""), ("c-d", "C D", "")]


def test_settle_keeps_types_and_cuts_reasons(spark):
    ledger = spark.createDataFrame([(1, "planned", NOW, '{"n":1,"deep":{"a":[1,2]},"slug":"s"}'), (2, "shipped", NOW, None)], "id int, status string, decided_at timestamp, meta string")
    outcomes = spark.createDataFrame([(1, "failed", LATER, "loop", json.dumps({"error": "e" * 600, "n": True}))], "id int, status string, at timestamp, by string, patch string")
    done = {r.id: r for r in merge.settle(ledger, outcomes).collect()}
    assert json.loads(done[1].meta) == {"n": True, "deep": {"a": [1, 2]}, "slug": "s", "error": "e" * 500}
    assert (done[1].status, done[1].decided_by, done[1].decided_at) == ("failed", "loop", LATER) and done[2].meta is None and done[2].decided_by is None


def test_targets_go_forward_only(spark):
    schema = "url string, domain string, title string, first_seen timestamp, last_seen timestamp, citations long, score double, competitors string, state string, state_changed timestamp, listed_at timestamp"
    old = spark.createDataFrame([("a", "d", "t", NOW, NOW, 1, 1.0, "", "contacted", NOW, None), ("b", "d", "t", NOW, NOW, 1, 1.0, "", "listed", NOW, NOW), ("c", "d", "t", NOW, NOW, 1, 1.0, "", "new", NOW, None)], schema)
    found = spark.createDataFrame([("a", "d", "T", 5, 2.0, "x", True), ("b", "d", "T", 5, 2.0, "x", False), ("n", "d", "T", 5, 2.0, "x", True)], "url string, domain string, title string, citations long, score double, competitors string, listed boolean")
    once = merge.merge_targets(old, found, LATER)
    rows = {r.url: r for r in once.collect()}
    assert {u: (r.state, r.listed_at, r.outcome) for u, r in rows.items()} == {"a": ("listed", LATER, "newly_listed"), "b": ("listed", NOW, "seen"), "c": ("new", None, None), "n": ("listed", LATER, "added")}
    assert tuple(merge.target_counts(once).first()) == (3, 1, 1)
    again = {r.url: r for r in merge.merge_targets(once.drop("outcome"), found, LATER).collect()}
    assert {u: tuple(r)[:-1] for u, r in again.items()} == {u: tuple(r)[:-1] for u, r in rows.items()} and again["a"].outcome == "seen"


def test_guarded_replace_and_last_row_wins(spark, tmp_path):
    old, new = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    kept = lambda df, stamp: (lambda t: (t[0].first()[0], t[1]))(merge.replace_if_any(old, df, stamp, LATER))
    assert kept(new, None) == (2, True) and kept(new.limit(0), None) == (1, False) and kept(new, NOW) == (1, False)
    (tmp_path / "s.csv").write_text("id,t\n1,a\n2,b\n1,c\n")
    assert sorted(feeds.load(spark, str(tmp_path / "s.csv"), "id int, t string", "id").collect()) == [(1, "c"), (2, "b")]
    files = spark.createDataFrame([('<sitemapindex xmlns="http://x/y"><sitemap><loc> a </loc></sitemap></sitemapindex>',)], "xml string")
    assert payloads.sitemap_entries(files).collect() == [("sitemap", "a")]


def test_planning(spark):
    actions = spark.createDataFrame([("too-far", "q one", "/blog/x", 3.0), ("improve-page", "q two", "/blog/x", 9.0), ("improve-page", "q three", "/about", 1.0), ("too-far", "q live", "x", 8.0)], "kind string, query string, target string, gain double")
    gaps = spark.createDataFrame([("g one", 2)], "question string, gain long")
    live, ranking = spark.createDataFrame([("q-live",)], "slug string"), spark.createDataFrame([], "query string")

    def chosen(sources, corpus=None, budget=9):
        ledger = spark.createDataFrame([(i, "post", "shipped", NOW, json.dumps({"source": s, "slug": f"w{i}"})) for i, s in enumerate(sources)], "id long, kind string, status string, created timestamp, meta string")
        return [r.query for r in planning.select_posts(actions, gaps, ledger, live, ranking, LATER, budget, corpus).orderBy("place").collect()]

    assert chosen(["gsc", "aeo"]) == ["q one", "q three", "g one"] and chosen(["aeo", "gsc", "gsc"], budget=2) == ["g one", "q one"]
    assert chosen([], live.limit(0)) == [] and len(chosen([], live)) == 3
    dead, merges = spark.createDataFrame([("p-", 6)], "prefix string, pages long"), spark.createDataFrame([("w", "l", 5.0), ("w2", "l2", 9.0)], "winner string, loser string, shared_impressions double")
    urls = spark.createDataFrame([("s/page/2",), ("s/a",)], "url string")

    def tidy(*queued):
        ledger = spark.createDataFrame([(k, "planned") for k in queued], "kind string, status string")
        return sorted((r.kind, r.target, r.detail) for r in planning.select_hygiene(dead, merges, urls.limit(0), urls, ledger).collect())

    assert tidy() == [("merge", "l2", "w2"), ("prune", "p-", "6"), ("sitemap", "s/page/2", "pagination")]
    assert [k for k, *_ in tidy("merge")] == ["prune", "sitemap"] and tidy("prune") == []
    edits = spark.createDataFrame([("s/blog/a", "faq", 3.0), ("s/blog/b", "meta", 2.0), ("s/blog/c", "faq", 1.0)], "page string, kind string, gain double")
    got = outreach.select_edits(edits, spark.createDataFrame([], "slug string"), 5, spark.createDataFrame([("a",), ("b",)], "slug string")).collect()
    assert [r.slug for r in got] == ["b", "c"]


def test_late_row_rewrites_its_day_alone_and_replays_leave_no_double(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, n, 12)
    kind, out = "ts timestamp, day date, k int, v double", str(tmp_path / "out")
    row = lambda n, k, v: (day(n), day(n).date(), k, v)

    def run(rows, check):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.upsert_batches(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), out, ["day", "k"], str(tmp_path / check), once=True).awaitTermination()
        return {p: sorted(f.name for f in (tmp_path / "out" / p).glob("*.parquet")) for p in ("__day=2024-01-01", "__day=2024-01-02", "__day=2024-01-03")}

    before = run([row(1, 1, 1.0), row(2, 1, 2.0), row(3, 1, 3.0), row(3, 2, 4.0)], "check")
    after = run([row(2, 1, 20.0), row(2, 5, 5.0)], "check")
    assert [before[p] == after[p] for p in before] == [True, False, True]
    want = sorted([(1, 1, 1.0), (2, 1, 20.0), (2, 5, 5.0), (3, 1, 3.0), (3, 2, 4.0)])
    rows = lambda: sorted((r.day.day, r.k, r.v) for r in events.current(spark, out).collect())
    assert rows() == want
    run([row(3, 9, 9.0)], "other")  # a lost checkpoint: everything comes again, in one batch
    assert rows() == sorted([*want, (3, 9, 9.0)])


PAGES = {"a": " ".join(f"w{i}" for i in range(90)), "b": " ".join(f"v{i}" for i in range(90)), "short": "too short"}


def test_corpus_index_is_checked_in_its_buckets(spark):
    pages = spark.createDataFrame([*PAGES.items(), ("a", "older " + PAGES["b"])], "url string, text string").withColumn("at", F.when(F.col("text").startswith("older"), 1).otherwise(2))
    spark.sql("DROP TABLE IF EXISTS corpus_test_v0")
    index = corpus_index.refresh(spark, "corpus_test", pages, at="at", buckets=8)
    assert {r.url for r in index.select("url").distinct().collect()} == {"a", "b"}
    drafts = quality.shingles(spark.createDataFrame([("x", PAGES["a"][:300]), ("y", "other " * 80), ("z", PAGES["b"] + " more")], "draft string, text string"), "draft", "text")
    found = corpus_index.check(drafts, index)
    want = quality.check_drafts(drafts, quality.shingles(pages.where("at = 2"), "url", "text"))
    assert sorted(found.collect()) == sorted(want.collect()) and {(r.draft, r.url) for r in want.collect()} == {("x", "a"), ("z", "b")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = drafts.join(index, "h")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(h") == 1  # the drafts' side
    # Pages come again: one that has changed is replaced, one that is too short now is gone.
    newer = spark.createDataFrame([("a", PAGES["b"] + " x"), ("b", "short now")], "url string, text string")
    index = corpus_index.refresh(spark, "corpus_test", newer, buckets=8)
    assert {r.url for r in index.select("url").distinct().collect()} == {"a"} and sorted(r.url for r in corpus_index.check(drafts, index).collect()) == ["a"]
    assert not spark.catalog.tableExists("corpus_test_v0")
    spark.sql("DROP TABLE corpus_test_v1")


@pytest.mark.parametrize("hot", [200, 2])
def test_bands_find_near_copies(spark, hot):
    """Forty texts around one: nearly all pairs are found, whether or not their bands are split."""
    words = PAGES["a"].split()
    texts = {f"n{i:02d}": " ".join(words[: 89 - i % 9] + [f"x{i}"]) for i in range(40)} | {"b": PAGES["b"], "copy": PAGES["b"]}
    sets = quality.shingles(spark.createDataFrame(list(texts.items()), "url string, text string"), "url", "text")
    heads = {r.url: r["head"] for r in corpus_index.classes(sets).collect()}
    assert heads["copy"] == "b" and len(set(heads.values())) == 41
    found = corpus_index.band_pairs(sets.where("url <> 'copy'").select("url", "n", "h"), hot=hot).collect()
    assert len(found) >= 0.9 * 40 * 39 / 2 and all(r.a < r.b and r.similarity >= 0.28 for r in found)


@pytest.mark.parametrize("batches", [1, 3])
def test_late_rows_are_merged(spark, tmp_path, batches):
    rows = [(datetime.datetime(2024, 1, 1 + i % 9), i % 9, float(i)) for i in range(27)]
    for n in range(batches):
        spark.createDataFrame(rows[n * 27 // batches : (n + 1) * 27 // batches], "ts timestamp, k int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, k int, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = events.upsert_batches(source, str(tmp_path / "out"), ["k"], str(tmp_path / "check"))
    job.processAllAvailable()
    job.stop()
    assert events.current(spark, str(tmp_path / "none")) is None
    assert {r.k for r in events.current(spark, str(tmp_path / "out")).collect()} == set(range(9)) and events.current(spark, str(tmp_path / "out")).count() == 9


def test_repeated_rows_of_a_stream_count_once(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1 + i % 3), i % 3) for i in range(9)]
    spark.createDataFrame(rows, "ts timestamp, id int").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, id int").parquet(str(tmp_path / "in"))
    job = events.deduplicated(source, ["id"]).writeStream.format("memory").queryName("once").start()
    job.processAllAvailable()
    job.stop()
    assert sorted(r.id for r in spark.table("once").collect()) == [0, 1, 2]


def test_ranks_are_dense_over_many_ranges(spark):
    """Sizes of ranges and places in them come from one layout, though bounds are sampled."""
    rows = spark.range(20000).select(F.col("id").alias("query"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("gain"))
    found = search.ranked(rows, F.desc("gain"), F.asc("query")).collect()
    order = sorted(found, key=lambda r: (-r.gain, r.query))
    assert [r.priority for r in order] == list(range(1, 20001))


def test_names_with_signs_are_taken_literally(spark):
    said = spark.createDataFrame([("a+b (c)",), ("aab c",), (None,)], "q string")
    assert [r[0] for r in said.select(X.names_any(F.col("q"), ["b (c)", "x.y"])).collect()] == [True, False, None]


def test_long_flags_in_their_order(spark):
    text = "---\nkind: x\n---\nWe foster a nuanced view; robust, robust. Not this. No that. Done. Fast. Cheap. Go — on — now.\n\n# Next"
    found = [tuple(r) for r in flags.flag_rows(spark.createDataFrame([(1, text), (2, None), (None, "")], "doc_id int, text string"), context="section").collect()]
    assert found == [
        (1, "P0", "truncated", "ends on a heading with no content", "# Next"),
        (1, "P1", "tier1 vocabulary", "'robust' x2", "robust"),
        (1, "P1", "tier2 cluster", "2 in one paragraph: foster, nuanced", "We foster a nuanced view; robust, robust. Not this. No that. Done. Fast. Cheap. "),
        (1, "P1", "em dash overuse", "2 in 18 words", ""),
        (1, "P1", "negative listing", "2 consecutive denials", "No that."),
        (1, "P1", "dramatic fragmentation", "3 consecutive one-beat sentences", "Done."),
    ]


def test_reasons_name_rules_and_pages(spark):
    page = " ".join(f"word{i} of{i}" for i in range(60))
    drafts = spark.createDataFrame([(1, page + " I say so."), (2, "As of my last update, it is so."), (3, "Worth reading, I think.")], "doc_id int, text string")
    corpus = spark.createDataFrame([("a", page), ("b", page + " " + " ".join(f"more{i}" for i in range(200))), ("c", "other " * 80)], "url string, text string")
    found = {r.doc_id: r for r in flags.judge(drafts, corpus, "section").collect()}
    assert found[1].reasons == ["97% overlap with existing page a", "36% overlap with existing page b"] and found[1].copied_from == "a"
    assert found[2].reasons == ["cutoff disclaimer: paste-from-chat fingerprint"] and found[2].warnings == []
    assert found[3].passed and found[3].warnings == ["worth-verbing: structural tell"]


def test_listed_terms_are_whole_words(spark):
    low = "a deep dive into cutting-edge, in order to; robustly robust-robust deep  dive due to the fact that testament to"
    terms = ("deep dive", "cutting-edge", "in order to", "robust", "due to the fact that", "testament to", "unpack")
    assert sorted(value(spark, X.terms_in(F.lit(low), terms))) == ["cutting-edge", "deep dive", "due to the fact that", "in order to", "robust", "robust", "testament to"]
    assert value(spark, X.terms_in(F.lit(""), terms)) == [] and value(spark, X.terms_in(F.lit("one two"), ("three",))) == []


def test_faq_is_indented_as_what_follows_it(spark):
    """The whole page, byte by byte; data as json.dumps() writes it."""
    page = "<head>\n  <title>t</title>\n\t</head>\n<article>\n  <p>x</p>\n    <div class=\"article-cta\">c</div>\n</article>"
    kind = "page_id int, url string, html string"
    rows = spark.createDataFrame([(1, "u", page), (2, "bare", "<article>x</article>"), (3, "none", page), (4, "has", page + '"@type": "FAQPage"'), (5, "both", '"@type":"FAQPage"')], kind)
    block = "### A \"q\" é?\nOne\n\ttwo \\ <b>.\n### Next?\nSo."
    blocks = spark.createDataFrame([("u", block), ("bare", block), ("none", "### Empty"), ("has", block), ("both", "no pairs")], "url string, block string")
    found = {r.url: r for r in pages.append_faq(rows, blocks).collect()}
    assert {k: r.outcome for k, r in found.items()} == {"u": "changed", "bare": "changed", "none": "empty", "has": "present", "both": "empty"}
    pairs = [('A "q" é?', "One two \\ <b>."), ("Next?", "So.")]
    entity = [{"@type": "Question", "name": q, "acceptedAnswer": {"@type": "Answer", "text": a}} for q, a in pairs]
    data = json.dumps({"@context": "https://schema.org", "@type": "FAQPage", "mainEntity": entity}, indent=2, ensure_ascii=False)
    shown = "".join(f"    <h3>{html.escape(q)}</h3>\n    <p>{html.escape(a)}</p>\n" for q, a in pairs)
    want = page.replace("\t</head>", f'\t<script type="application/ld+json">\n{data}\n\t</script>\n\t</head>')
    want = want.replace("    <div", "    <h2>Frequently asked questions</h2>\n" + shown + "\n    <div")
    assert found["u"].html == want and found["none"].html == page
    assert found["bare"].html == "<article>x<h2>Frequently asked questions</h2>\n" + shown.replace("    ", "") + "\n</article>"


def test_all_entities_are_decoded(spark):
    names = [*sorted(html_entities)[::9], "#233;", "#xE9;", "#XE9", "#128;", "#0;", "#x110000;", "notanentity;", "lt", "ampamp;"]
    rows = spark.createDataFrame([(f"<title> a&{n}b </title>",) for n in names] + [(None,)], "html string")
    found = [r.t for r in rows.select(X.page_title(F.col("html")).alias("t")).collect()]
    assert found[:-1] == [html.unescape(f" a&{n}b ").strip(" ") for n in names] and found[-1] is None
