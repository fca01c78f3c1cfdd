"""What a reviewer found on odd inputs and larger tables."""

import datetime

import duckdb
from pyspark.sql import functions as F

from searchloom.functions import text as X
from searchloom.operators import checks, corpus_index, flags, likeness, marks, pages, quality, search, style, tells
from searchloom.plans import views
from searchloom.plans.rules import SQL
from searchloom.plans.search import QUERIES

HTML = "<head><title>{}</title></head><article>a</article>"


def shared_url(spark):
    return spark.createDataFrame([(1, "u", HTML.format("a")), (2, "u", HTML.format("b")), (3, "v", HTML.format("c"))], "page_id long, url string, html string")


def test_faq_goes_to_the_page_that_its_block_names_where_pages_share_a_url(spark):
    rows = shared_url(spark)
    found = pages.append_faq(rows, rows.select("page_id", F.lit("### A?\nb").alias("block")), "page_id").collect()
    assert sorted((r.page_id, r.outcome) for r in found) == [(1, "changed"), (2, "changed"), (3, "changed")]


def test_titles_go_to_the_page_that_the_change_names_where_pages_share_a_url(spark):
    rows = shared_url(spark)
    found = pages.retitle(rows, rows.select("page_id", F.concat(F.lit("t"), "page_id").alias("title"), F.lit("d").alias("description")), "page_id").collect()
    assert sorted((r.page_id, r.html) for r in found) == [(n, HTML.format(f"t{n}")) for n in (1, 2, 3)]


def test_a_file_is_changed_once_where_paths_repeat(spark):
    rows = shared_url(spark).select(F.col("url").alias("path"), F.col("html").alias("content"), "page_id")
    files = rows.withColumn("content", F.when(F.col("page_id") == 1, "new").otherwise(F.col("content")))
    assert [(r.path, r.content) for r in pages.only_changed(files, rows.drop("page_id")).collect()] == [("u", "new")]


def test_references_without_a_semicolon_stay_where_only_ended_ones_count(spark):
    page = spark.createDataFrame([(1, "u", "<title>a &amp;&lt;b &amp</title><article>x &ampy &eacute;</article>")], "page_id long, url string, html string")
    found, loose = pages.facts(page, ended=True).first(), pages.facts(page).first()
    assert (found.title, found.text) == ("a &<b &amp", "a &<b &amp x &ampy é")
    assert (loose.title, loose.text) == ("a &<b &", "a &<b & x &y é")
    assert spark.range(1).select(X.page_text(F.lit("<p>abc &amp;</p>"), 8, True)).first()[0] == "abc &"


def test_style_flags_count_the_rules_of_the_text_gate_too(spark):
    text = "It is not just a plan, it's a start. This may become the next big one.\nThe catch?\nWhat's next\n\U0001f600"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    alone, added = style.flags(rows, alone=True).first(), style.flags(rows).first()
    assert (alone.credibility, alone.tells, alone.minor_tells) == (1, 3, 1)
    assert (added.credibility, added.tells, added.minor_tells) == (0, 0, 0)
    assert "The catch" in SQL["style_flags"] and "The catch" not in SQL["gate_verdict"].split("style AS", 1)[1].split("lexical AS", 1)[0]


def templated(spark, count=60):
    """Pages that share a template of a third of their words, and drafts: copies of some, near copies and others."""
    frame = " ".join(f"t{i}" for i in range(40))
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    texts = {f"p{k:02d}": f"{frame} {body(k)}" for k in range(count)} | {"q0": f"{frame} {body(0)}", "r0": f"{frame} {body(0)} more of it"}
    drafts = {f"d{k}": f"{frame} {body(k)} x" for k in range(5)} | {"e0": f"{frame} {body(0)} x", "own": body(count), "short": "a b"}
    of = lambda rows, key: quality.shingles(spark.createDataFrame(list(rows.items()), f"{key} string, text string"), key, "text")
    return of(drafts, "draft"), of(texts, "url")


def brute_force(drafts, sets, least):
    a, b = ({k: {r.h for r in rows if r[0] == k} for k in {r[0] for r in rows}} for rows in (drafts.collect(), sets.collect()))
    found = {(x, y): len(a[x] & b[y]) / len(a[x] | b[y]) for x in a for y in b if a[x] & b[y]}
    return {k: s for k, s in found.items() if s >= least}


def test_likeness_is_exact_where_pages_share_a_template(spark):
    drafts, sets = templated(spark)
    for least in (0.18, 0.28, 0.6):
        found = {(r.draft, r.url): r.similarity for r in likeness.most_like(drafts, sets, least).collect()}
        assert found == brute_force(drafts, sets, least)
    best = {(r.draft, r.place): r.url for r in quality.check_drafts(drafts, sets).collect()}
    assert [best["e0", n] for n in (1, 2, 3)] == [best["d0", n] for n in (1, 2, 3)] == ["p00", "q0", "r0"]


def test_a_template_is_one_block_and_makes_no_pairs_where_it_cannot_decide(spark):
    """Before, each of its shingles made a row for each draft and page."""
    drafts, sets = templated(spark)
    found = likeness.blocks(drafts, sets)
    assert found.where("df = 62").count() == 1 and found.count() < 20
    heads = [likeness._heads(found, side, 3) for side in ("ds", "us")]
    assert likeness.candidates(*heads, 0.5).count() <= 6 and heads[0].count() == 5


def test_medians_are_exact_on_both_sides_of_the_bound(spark):
    texts = [("one", f"p{k}", " ".join(f"w{i}" for i in range(20)) + f" end{k}") for k in range(5)]
    texts += [("many", f"p{k}", " ".join(f"v{k}x{i}" for i in range(20)) + (" a b c d e" if k < 2 else "")) for k in range(5)]
    rows = spark.createDataFrame(texts, "cluster string, url string, text string")
    found = {r["cluster"]: (r.pages, r.pairs, round(r.median, 6)) for r in quality.cluster_similarity(rows, "cluster").collect()}
    assert found == {"one": (5, 10, round(16 / 18, 6)), "many": (5, 10, 0.0)}
    sets = quality.shingles(rows.select(F.struct("cluster", "url").alias("k"), "text"), "k", "text").select("k.cluster", "k.url", "n", "h")
    totals = rows.groupBy("cluster").agg(F.lit(10).cast("long").alias("pairs"))
    assert {r["cluster"] for r in likeness.median_of_pairs(sets, totals, "cluster", "url").collect()} == {"one"}


def test_verified_bands_equal_brute_force(spark):
    _, sets = templated(spark, 12)
    pairs = sets.select(F.col("url").alias("a"), F.col("n").alias("na")).distinct().crossJoin(sets.select(F.col("url").alias("b"), F.col("n").alias("nb")).distinct()).where("a < b")
    found = {(r.a, r.b): r.similarity for r in likeness.alike(pairs, sets, 0.28).collect()}
    assert found == {k: s for k, s in brute_force(sets, sets, 0.28).items() if k[0] < k[1]}


SMALL, DAY = "/root/testdata/sf0.001", datetime.date(2001, 11, 4)


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prefixes_are_taken_once_for_each_page(spark):
    """Before, each filter on a prefix had all its patterns copied into it and into the scans on both sides of the joins."""
    inventory, status, facts = (views.table(spark, SMALL, t) for t in ("url_inventory", "url_index_status", "search_fact"))
    dead = search.dead_clusters(inventory, status, facts, DAY)
    assert planned(dead).count(r"\.html$") == 1
    assert planned(search.dead_pages(inventory, dead)).count(r"\.html$") == 2


def test_intents_are_asked_for_above_the_groupings(spark):
    """Before, a filter on the intent of a query went below all groupings, to each fact."""
    asked, by_page, facts = (views.table(spark, SMALL, t, True) for t in ("query_daily", "page_query", "search_fact"))
    for found in (search.cannibalised(by_page, DAY), search.actions(asked, by_page, DAY), search.content_gaps(asked, DAY), search.won(facts)):
        assert "RLIKE" in planned(found) and "RLIKE" not in planned(found).rsplit("Aggregate", 1)[1]


def test_the_last_date_is_taken_from_facts_that_are_not_grouped(spark, monkeypatch):
    made = []
    monkeypatch.setattr("searchloom.plans.search.table", lambda *a: made.append(a[2]) or views.table(*a))
    QUERIES["dead_clusters"](spark, SMALL)
    assert made == ["url_inventory", "url_index_status", "search_fact", "search_fact"]


def test_sums_over_facts_equal_those_over_days(spark):
    for wide in (False, True):
        inventory, status, facts, days, asked = (views.table(spark, SMALL, t, wide) for t in ("url_inventory", "url_index_status", "search_fact", "page_daily", "query_daily"))
        dead = [sorted(map(tuple, search.dead_clusters(inventory, status, f, DAY).collect())) for f in (facts, days)]
        assert dead[0] == dead[1] and dead[0]
        won = [search.won(f).select("clicks", F.round("position", 6)).first() for f in (facts, asked)]
        assert won[0] == won[1] and won[0][0] > 0


ODD = ("a​b c", "cite turn0search1 CITE turn1x", "tu​rn contentRef​erence x", "\U0001f468‍\U0001f469 a‍b", "---\nmodel: x\nkind: y\n---\nbody⁠", "---\nmodel: x", "[Your name] 2001-XX-XX", "café — naïve", "", None)


def test_marks_are_looked_for_only_in_texts_that_have_some(spark):
    """Before, each list of marks went over each text several times."""
    rows = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    found = marks.sanitise(rows)
    got = {r.id: (r.clean, r.removed, r.replaced, r.kept, r.pasted, r["keys"], r.blocks) for r in found.collect()}
    assert got[0] == ("ab c", 1, 1, 0, 0, 0, [])
    assert got[1] == (" CITE turn1x", 0, 1, 0, 1, 0, ["marks survived cleaning"])
    assert got[2] == ("turn contentReference x", 2, 0, 0, 0, 0, ["marks survived cleaning"])
    assert got[3] == ("\U0001f468‍\U0001f469 ab", 1, 0, 1, 0, 0, [])
    assert got[4] == ("---\nkind: y\n---\nbody", 1, 0, 0, 0, 1, [])
    assert got[5] == ("---\nmodel: x", 0, 0, 0, 0, 0, [])
    assert got[6] == ("[Your name] 2001-XX-XX", 0, 0, 0, 0, 0, ["unfilled placeholder"])
    assert got[7] == ("café — naïve", 0, 0, 0, 0, 0, []) and got[8] == got[9] == ("", 0, 0, 0, 0, 0, [])
    assert {r.id: r.clean for r in rows.select("id", marks.cleaned(F.col("text")).alias("clean")).collect()} == {k: v[0] for k, v in got.items()} | {9: None}
    assert marks.MARKED in planned(found)


def test_a_narration_is_cleaned_and_judged_in_one_pass(spark):
    """Before, rows met their own reasons by two joins, and each side took the texts anew."""
    rows = spark.createDataFrame([(1, "**Narration:** a​b"), (2, "I hope this helps. " * 40), (3, None)], "id long, text string")
    found = checks.narration_problems(rows.withColumn("text", F.coalesce("text", F.lit(""))))
    assert "Join" not in planned(found)
    got = {r.id: (r.script, r.words, r.problems) for r in found.collect()}
    assert got[1] == ("Narration: a​b", 2, ["length"]) and got[3] == ("", 0, ["length"])
    assert got[2][1] == 160 and any("chatbot artifact" in p for p in got[2][2])


def test_vocabularies_hold_what_texts_hold(spark):
    """Before, each text was searched for each of over a hundred listed strings, and each sentence's words counted twice."""
    needles = [*{n for listed in tells.NEEDLES.values() for n in listed}, *tells.PHRASES]
    texts = [f"x{n}y" for n in needles] + [f"a {n.strip()} b" for n in needles] + ["", "évolving world", "worth it", "the-catch?"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", X.vocabulary(X.tokens(F.lower("t"))))
    pairs = F.array(*(F.struct(X.holds_any(F.lower("t"), F.col("v"), (n,)).alias("a"), F.contains(F.lower("t"), F.lit(n)).alias("b")) for n in needles))
    assert rows.where(F.exists(pairs, lambda p: p["a"] != p["b"])).count() == 0
    docs = spark.createDataFrame([(1, "  One. Two! \n\n# H\nThat's it. That's the way.   ")], "doc_id long, text string")
    assert {r.rule for r in flags.flag_rows(docs).collect()} == {"too short", "truncated", "dramatic fragmentation"}
    for plan in (planned(flags.flagged(docs)), planned(style.flags(docs))):
        assert plan.count("zip_with") == 1


def test_shingles_are_made_once_where_their_number_is_asked_for(spark):
    """Before, filters on the number were pushed down with a copy of all that makes the sets."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b"), (3, None), (4, "a b c d e " * 3)], "doc_id long, text string")
    sets = quality.shingles(docs, "doc_id", "text")
    assert planned(sets.where("n >= 2")).count("<[^>]+>") == 1
    assert {(r.doc_id, r.n) for r in sets.select("doc_id", "n").distinct().collect()} == {(1, 2), (4, 5)}
    assert {(r.doc_id, r.n) for r in quality.sizes(docs, "doc_id", "text").where("n >= 3").collect()} == {(4, 5)}


def test_pages_that_no_draft_is_like_leave_before_the_shuffle(spark, tmp_path):
    """Before, each shingle of each page was dealt out and sorted. What passes is still all that the SQL has."""
    word = lambda i: f"w{i}"
    text = lambda *parts: " ".join(word(i) for a, b in parts for i in range(a, b))
    docs = [(n, text((1000 * n, 1000 * n + 50 + 7 * n))) for n in range(60)] + [(60, text((0, 54))), (61, text((0, 53))), (62, None), (63, ""), (64, "a b c")]
    # Drafts with all, half, a fifth and fewer of a page's shingles, and one with parts of several pages.
    turns = [(n, 0, text((1000 * n, 1000 * n + (50 + 7 * n) * (n % 11) // 10), (10**6 + 1000 * n, 10**6 + 1000 * n + 20))) for n in range(50)]
    turns += [(50, 1, text((0, 30), (1000, 1030), (2000, 2030))), (51, 0, None), (52, 0, "a b c"), (53, 0, text((9 * 10**6, 9 * 10**6 + 300))), (54, 0, text((0, 13))), (55, 0, text((0, 14)))]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted(map(tuple, QUERIES["draft_check"](spark, str(tmp_path)).collect()))
    names = {n: f"read_parquet('{tmp_path}/{n}.parquet/*.parquet')" for n in ("documents", "conversations")}
    want = duckdb.sql(f"WITH documents AS (FROM {names['documents']}), conversations AS (FROM {names['conversations']}), {SQL['draft_check'].removeprefix('WITH ')}").fetchall()
    assert [(a, b, round(c, 9), *r) for a, b, c, *r in found] == [(a, b, round(c, 9), *r) for a, b, c, *r in sorted(want)] and len(found) > 40

    drafts = quality.shingles(spark.createDataFrame(turns, "conv_id long, turn long, text string"), "conv_id", "text")
    kept = likeness.screen(drafts, 0.18)
    sets = quality._sets(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").select("doc_id", kept(F.col("s")).alias("kept"))
    sizes = {r.doc_id: r.kept and len(r.kept) for r in sets.collect()}
    assert all(sizes[n] is None for n in (50, 55, 59, 62, 63, 64)) and sizes[10] == 116 and 26 <= sizes[60] < 32


def test_letters_beyond_ascii_bound_words_as_in_the_sql(spark, tmp_path):
    """Before, Java's word boundary knew them, so that "Noñ" was no denial. Who speaks is told by all letters on both sides."""
    texts = ["Noñ a. No bé.", "éno more. Noté it. Not it.", "- Éléments x\n" * 6, "uñ-dós, trés-cuá, cin-seís.", "éI hope this helpsé. Delveé.", "Iñ andé weñ " * 210, "I am " * 210, "That's ité. That's it. That's theé"]
    spark.createDataFrame([(5 + 6 * n, t) for n, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "u", "2001-XX-XXé")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with_ = "WITH " + ", ".join(f"{n} AS (FROM read_parquet('{tmp_path}/{n}.parquet/*.parquet'))" for n in ("documents", "pages"))
    for name in ("flag_rows", "style_flags", "text_gate"):
        found, want = QUERIES[name](spark, str(tmp_path)), duckdb.sql(f"{with_}, {SQL[name].removeprefix('WITH ')}")
        assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())


def test_shingles_are_runs_of_words_whatever_lies_between(spark, monkeypatch):
    """Before, each shingle was joined to a string of its own. Texts longer and shorter than what is looked at together."""
    import re

    texts = ["", None, "a b c d", "A-b_c dée f", "x" * 300 + " b c d e", "x" * 299 + " b c d e", "a b c d e " * 9, "e d c b a", "b a c d e", "a <b c> d <> e <<f> g h", "é€1 2 3 4 5 \U0001f600 6"]
    texts += [" ".join("abé<>"[(i * j * j + j) % 5] * (1 + j % 3) for j in range(i)) for i in range(40)]
    words = lambda t: re.sub("[^a-zA-Z0-9]+", " ", re.sub("<[^>]+>", " ", t or "")).lower().split()
    want = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(2)
    found = {r.k: r.s for r in quality._sets(rows, "k", "text").collect()}
    assert [len(found[k] or ()) for k in range(len(texts))] == [len(w) for w in want] and found[2] is None
    names = {}
    assert all(names.setdefault(frozenset(w), found[k]) == found[k] for k, w in enumerate(want) if w)
    assert len({h for s in found.values() for h in s or ()}) == len(set().union(*want))
    from searchloom.functions import shingles

    monkeypatch.setattr(shingles, "AT_ONCE", 64)
    import pyarrow as pa

    again = list(shingles._batches(pa.array(["zz", *(re.sub("<[^>]+>", " ", t or "") for t in texts)]).slice(1), 5))
    assert all((s is None and not found[k]) or s.tolist() == found[k] for k, s in enumerate(again))


def test_pairs_of_a_table_with_itself_are_exact(spark, monkeypatch):
    """Before, shingles of one page alone were blocks too, and texts were cut anew for each side of each join."""
    _, sets = templated(spark, 12)
    want = {k: s for k, s in brute_force(sets, sets, 0.28).items() if k[0] < k[1]}
    for met in (likeness.MET, 40):  # a template then reaches over several looks
        monkeypatch.setattr(likeness, "MET", met)
        pairs = likeness.pairs_of(sets, 0.28)
        assert {(r.a, r.b): r.similarity for r in pairs.collect()} == want
    assert likeness.blocks(None, sets).where("size(us) < 2").count() == 0
    found = {(r.a, r.b) for r in corpus_index.recalled(pairs, sets, hot=3).collect()}
    assert found == {(r.a, r.b) for r in corpus_index.band_pairs(sets, hot=3).collect()} and found


def test_an_index_that_is_checked_once_is_not_ordered(spark, monkeypatch):
    """Before, shingles were counted, joined to their counts and dealt by page for an order that the check does not use."""
    monkeypatch.setattr(corpus_index, "ranked", None)
    found = {(r.draft, r.url, r.place) for r in QUERIES["index_check"](spark, SMALL).collect()}
    tables = "WITH " + ", ".join(f"{n} AS (FROM '{SMALL}/{n}.parquet')" for n in ("documents", "conversations"))
    assert found == {(r[0], r[1], r[3]) for r in duckdb.sql(f"{tables}, {SQL['index_check'].removeprefix('WITH ')}").fetchall()} and found


def test_best_pages_are_found_from_the_top_and_unlike_drafts_are_not_dealt(spark, monkeypatch):
    """Before, each draft was held against all that share a template, and each shingle of each draft was dealt and sorted."""
    frame = " ".join(f"t{i}" for i in range(40))
    body = lambda k, n=80: " ".join(f"w{k}x{i}" for i in range(n))
    pages = [(f"p{k:02d}", f"{frame} {body(k // 4, 60 + 7 * (k % 4))}") for k in range(40)] + [("none", None)]
    texts = [(k, f"{frame} {body(k)}") for k in range(9)] + [(20, body(900)), (21, "a b"), (22, f"{frame} {body(500)}"), (23, f"{body(901, 400)} {frame}")]
    corpus, drafts = spark.createDataFrame(pages, "url string, text string"), spark.createDataFrame(texts, "draft long, t string")
    want = quality.check_drafts(quality.shingles(drafts, "draft", "t"), quality.shingles(corpus, "url", "text"), top=2)
    met, dealt = likeness._met, []
    monkeypatch.setattr(likeness, "_met", lambda a, b: dealt.append({r.k for r in a.collect()}) or met(a, b))
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(quality.check_texts(drafts, corpus, top=2))
    assert 0 in dealt[0] and not dealt[0] & {20, 21, 23}
    monkeypatch.setattr(likeness, "LEVELS", ())
    assert found == rows(want) == rows(quality.check_texts(drafts, corpus, top=2)) and len(found) > 18
    shingled = quality.shingles(drafts, "draft", "t"), quality.shingles(corpus, "url", "text")
    best = {}
    for (d, u), s in sorted(brute_force(*shingled, 0.18).items(), key=lambda x: (-x[1], x[0][1])):
        if u != "none" and len(best.setdefault(d, [])) < 2:
            best[d].append((u, s))
    assert {(d, u, round(s, 9)) for d, us in best.items() for u, s in us} == {(d, u, round(s, 9)) for d, u, s, *_ in found}


def test_pages_meet_within_their_group_alone(spark, monkeypatch):
    """Before, a list was made for each shingle of each group, those of one page too, and texts were cut twice."""
    text = lambda k: " ".join(f"w{i}" for i in range(20)) + f" end{k}"
    rows = spark.createDataFrame([(g, f"p{k}", text(k)) for g in ("one", "two") for k in range(4)] + [("three", "p0", text(0)), ("three", "p1", "a b c d e f")], "cluster string, url string, text string")
    met, lists = likeness._met, []

    def seen(a, b):
        found = met(a, b)
        lists.extend(r.us for r in found.collect())
        return found

    monkeypatch.setattr(likeness, "_met", seen)
    found = quality.cluster_similarity(rows, "cluster")
    assert {r["cluster"]: (r.pairs, round(r.median, 6)) for r in found.collect()} == {"one": (6, round(16 / 18, 6)), "two": (6, round(16 / 18, 6)), "three": (1, 0.0)}
    assert len(lists) == 2 and all(len(us) == 4 and len({x.k.g for x in us}) == 1 for us in lists)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
