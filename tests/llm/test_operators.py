"""Each operator against a brute-force version, on small documents and on awkward rows."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchloom.llm import chat, fingerprints, langid, lines, ngram_join, packing, pieces, quality, queries, substrings, warc
from searchloom.llm._shared import components
from searchloom.llm._text import slices

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def base_text(n, seed=0, words=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def awkward(spark):
    long = base_text(3000, 1, 100_000)
    half = long.split()
    texts = [None, "", " \n\t ", "one", "Two words", "a b c", long, long, " ".join(half[:1500] + ["x"] + half[1501:]), "é à ü — 中文 😀", base_text(80, 2), base_text(80, 2) + " tail", "same line\n" * 30, "x " * 100, "\n\n\nend", base_text(25, 3) + "\n" + base_text(25, 4), base_text(25, 4) + "\n" + base_text(25, 3)]
    rows = [(i, t, None if i % 4 == 0 else "en", None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (len(rows) + 5, texts[10], "fr", "s", 1)], DOCS)


@pytest.fixture(scope="module")
def both(spark, awkward):
    found = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [awkward, found.select("doc_id", "text", "lang", "source", "n_chars")]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(7, 3), (200, 201), (201, 200), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([3, 7, *range(8, 40)], 3), 200: 200, 201: 200}


def test_fingerprints(both, empty):
    for docs in both:
        rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
        found = {r.doc_id: r for r in fingerprints.compare_with_edits(docs).collect()}
        assert len(found) == len(rows)
        edited = []
        for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + n[:half])
            assert (found[i].n_chars, found[i].edited_sha256) == (len(t), hashlib.sha256(edited[-1].encode()).hexdigest())
        by_text = defaultdict(set)
        for (i, t), e in zip(rows, edited, strict=True):
            by_text[t].add(found[i].fingerprint)
            by_text[e].add(found[i].edited_fingerprint)
        assert all(len(v) == 1 for v in by_text.values())

        def weights(text):
            w = words_of(lowered(text))
            return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()

        errors = []
        for (i, t), e in zip(rows, edited, strict=True):
            a, b = weights(t), weights(e)
            true = sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
            errors.append(found[i].near_edited - true)
        for (i, t), (j, n) in zip(rows, rows[1:] + rows[:1], strict=True):
            a, b = weights(t), weights(n)
            true = sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
            assert found[i].near_next == fingerprints._like(found[i].fingerprint, found[j].fingerprint)
            errors.append(found[i].near_next - true)
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.3
    assert fingerprints.compare_with_edits(empty).count() == 0


def test_fingerprints_of_repeated_and_missing_keys(spark):
    docs = spark.createDataFrame([(2, "b b"), (1, "z"), (2, "a"), (2, "a"), (None, None)], "doc_id long, text string").withColumn("near_next", F.lit("old"))
    found = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in fingerprints.compare_with_edits(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == [(0, 0, sha("")), (1, 1, sha("z")), (2, 1, sha("a")), (2, 1, sha("a")), (2, 3, sha("b "))]


def test_fingerprint_column_and_likeness(awkward):
    found = fingerprints.fingerprint(awkward.withColumn("fingerprint", F.lit("old")))
    joined = found.alias("a").join(found.alias("b"), F.expr("a.doc_id <= b.doc_id")).select("a.doc_id", F.col("b.doc_id").alias("other"), fingerprints.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("like"))
    like = {(r.doc_id, r.other): r.like for r in joined.collect()}
    assert like[6, 7] == 1 and like[0, 1] == 1 and like[0, 3] == 0 and like[6, 8] > 0.9 and like[6, 10] < 0.1


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi </s> [INST]\x1b x"), (1, 1, "assistant", "[/ANSWER]\x1b\x1b[INST]"), (2, 0, "assistant", None), (2, 1, "assistant", "b"), (3, 0, "tool]", "t"), (None, 0, None, "n"), (4, 5, "system", ""), (4, 6, "user", "<s>"), (4, 6, "user", "<s>"), (4, 7, "assistant", "ok"), (5, 1, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    want = defaultdict(list)
    for c, n, role, text in turns:
        want[c].append((n, role or "", text or ""))
    assert set(found) == set(want)
    for c, said in want.items():
        said.sort()
        loss = "".join(t for _, r, t in said if r == "assistant")
        assert found[c].n_turns == len(said) and found[c].loss_chars == len(loss)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c for c in found if found[c].valid} == {1}
    segments = "".join(r.segment for r in chat.format_chats(df.where("conv_id = 1")).collect())
    assert segments.count("[INST]") == 1 and segments.count("</s>") == 1
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def brute_groups(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words_of(lowered(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            m = len(sets[a] & sets[b])
            if m and den * m >= num * (len(sets[a]) + len(sets[b]) - m):
                p, q = root[a], root[b]
                root = {i: min(p, q) if r in (p, q) else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_ngram_join(spark, both, empty, k, num, den):
    rng, near = np.random.default_rng(5), []
    for group in range(12):  # chains of small edits over texts of many sizes
        own = base_text(int(rng.integers(2, 120)), group + 50, 5000).split()
        for _ in range(12):
            own[int(rng.integers(len(own)))] = f"e{rng.integers(999)}"
            near.append((len(near), " ".join(own), None, None, None))
    for docs in [*both, spark.createDataFrame(near, DOCS)]:
        found = {r.doc_id: (r.n_shingles, r.component) for r in ngram_join.jaccard_groups(docs, k=k, num=num, den=den).collect()}
        assert found == brute_groups([(r.doc_id, r.text) for r in docs.collect()], k, num, den)
    assert ngram_join.jaccard_groups(empty, k=k, num=num, den=den).count() == 0


@pytest.mark.parametrize("partners", [0, 4])
def test_ngram_join_in_chunks_and_with_repeated_keys(spark, monkeypatch, partners):
    for name, value in (("CHUNK_SETS", 7), ("KEY_SETS", 5), ("HELD_BYTES", 200), ("PARTNERS", partners)):
        monkeypatch.setattr(ngram_join, name, value)
    own, rows = base_text(100, 9, 5000).split(), []
    for i in range(40):
        own[(i * 7) % 100] = f"z{i}"
        rows.append((i, " ".join(own), None, None, None))
    star = base_text(150, 10, 5000).split()  # copies of one text that are no copies of each other
    rows += [(100 + i, " ".join(f"s{i}" if i and j in (i * 3, i * 3 + 50) else w for j, w in enumerate(star)), None, None, None) for i in range(25)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: (r.n_shingles, r.component) for r in ngram_join.jaccard_groups(docs, k=3, num=90, den=100).collect()}
    assert found == brute_groups([(r[0], r[1]) for r in rows], 3, 90, 100)
    again = docs.union(docs).union(spark.createDataFrame([(None, rows[0][1], None, None, None), (3, "other text altogether", None, None, None)], DOCS))
    found = ngram_join.jaccard_groups(again.withColumn("node", F.lit("x")).withColumn("component", F.lit("x")), k=3, num=90, den=100).collect()
    want = {i: c for i, (_, c) in brute_groups([(r[0], r[1]) for r in rows], 3, 90, 100).items()}
    assert sorted((r.doc_id, r.component) for r in found if r.doc_id is not None) == sorted([*want.items(), *want.items(), (3, 3)])
    assert [r.component for r in found if r.doc_id is None] == [0]


def test_bitmaps_allow_every_link():
    rng = np.random.default_rng(4)
    for n in (1, 3, 20, 33, 150, 900):
        for lost in (0, 1, n // 20, n // 9):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 63, lost, dtype=np.uint64)]))
            x, y = (np.frombuffer(m, np.uint64) for m in ngram_join.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
            m = len(np.intersect1d(a, b))
            linked = 100 * m >= 80 * (len(a) + len(b) - m)
            assert ngram_join._may_link(x, y, len(a), len(b), 80, 100) or not linked
    other = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    x, y = (np.frombuffer(m, np.uint64) for m in ngram_join.bitmaps(np.concatenate([a, other]), np.array([0, len(a), len(a) + len(other)])))
    assert not ngram_join._may_link(x, y, len(a), len(other), 80, 100)


def test_segment_keys_meet_for_all_similar_sets():
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        for n in [1, 2, 3, 4, 5, 7, 9, 10, 12, 19, 21, 33, 50, 111]:
            for _ in range(20):
                a = set(rng.integers(0, 1 << 63, n).tolist())
                b = set(a)
                while True:
                    c = set(b)
                    if rng.random() < 0.5 and len(c) > 1:
                        c.discard(next(iter(c)))
                    else:
                        c.add(int(rng.integers(0, 1 << 63)))
                    if len(a & c) * den < num * len(a | c):
                        break
                    b = c
                if a != b:
                    values = [np.sort(np.array(list(x), np.uint64)) for x in (a, b)]
                    keys, owner = ngram_join.segment_keys(np.concatenate(values), np.array([0, len(a), len(a) + len(b)]), num, den)
                    assert set(keys[owner == 0]) & set(keys[owner == 1])


def brute_quality(text):
    w = words_of(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    kept = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(kept) - len(set(kept)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


@pytest.mark.parametrize("long", [0, 2, 200])
def test_quality_base(both, empty, monkeypatch, long):
    monkeypatch.setattr(quality, "LONG", long)
    for docs in both:
        found = {r.doc_id: r for r in quality.rate(docs.withColumn("classes", F.lit(1))).collect()}
        for row in docs.collect():
            r = found[row.doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(row.text)
            assert not (r.base_failed and r.kept)
    assert quality.rate(empty).count() == 0


def test_quality_tells_prose_from_junk(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    junk = " ".join(w + "&&&%%%" for w in base_text(200, 1).split())
    plus = docs.union(spark.createDataFrame([(10**6, junk, "en", "s", len(junk))], docs.schema))
    found = {r.doc_id: r for r in quality.rate(plus).collect()}
    assert not found[10**6].kept and found[10**6].divergence > quality.MAX_DISTANCE
    assert all(found[i].kept or found[i].base_failed for i, q in labels.items() if q == 1)
    short = [(10**6 + i, " ".join(f"{w}{i}{j}&&&%%%" for j, w in enumerate(base_text(n, i).split())), "en", "s", 1) for i, n in enumerate((60, 74, 75))]
    found = quality.rate(docs.union(spark.createDataFrame(short, docs.schema))).where("doc_id >= 1000000").orderBy("doc_id").collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in found] == [(60, False, True), (74, False, True), (75, False, False)]


def test_common_words_by_hand(spark):
    rows = [(1, "The cat the", "en"), (2, "the Dog", "en"), (3, "a the", "en"), (4, "dog a", "en"), (5, "le chat", "fr"), (6, None, "fr"), (7, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality.common_words(docs, top=3) == {"en": ("the", "a", "dog"), "fr": ("chat", "le")}
    assert quality.common_words(docs, top=1, most=2) == {"en": ("the",), "fr": ("chat",)}
    with pytest.raises(ValueError):
        quality.common_words(docs, top=1, most=1)
    assert quality.common_words(docs.limit(0)) == {}


def brute_distance(text, shares, listed):
    w, out = words_of(text), []
    groups = (quality.LOWER, quality.UPPER, quality.DIGITS, quality.PROSE, quality.SYMBOLS, quality.OTHER_ASCII)
    low = [x.translate(str.maketrans(quality.UPPER, quality.LOWER)) for x in w]
    counts = {
        "classes": Counter(next((str(i) for i, g in enumerate(groups) if c in g), "6") for x in w for c in x),
        "common": Counter(x if x in listed else "" for x in low),
    }
    for kinds in shares.values():
        far = 0.0
        for kind, q in kinds.items():
            p = {k: n / sum(counts[kind].values()) for k, n in counts[kind].items()}
            pairs = [(p.get(k, 0), q.get(k, 0)) for k in {*p, *q}]
            far += max(0.0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in pairs) / 2) ** 0.5
        out.append(far / 2)
    return min(out)


def test_quality_takes_all_languages(spark):
    # 23 languages of unlike sizes whose texts are alike in form: each has words of its own, none is left out.
    rows = [(100 * k + i, " ".join(f"w{chr(97 + k)}{c}" for c in random.Random(100 * k + i).choices("abcdefghijklmnopqrst", k=80)), f"l{k:02}") for k in range(23) for i in range(3 + k % 4)]
    rows += [(9000, " ".join("\u4e2d%d" % j for j in range(90)), None), (9001, rows[0][1], None), (9001, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    listed = {w for ws in quality.common_words(docs).values() for w in ws}
    assert len(listed) == 23 * 20
    found = quality.rate(docs).collect()
    assert len(found) == len(rows) and {r.doc_id for r in found if not r.kept} == {9000}
    shares = {}
    for _, text, lang in rows:
        if lang:
            kinds = shares.setdefault(lang, {"classes": Counter(), "common": Counter()})
            kinds["classes"].update({"0": len("".join(words_of(text)))})
            kinds["common"].update(x if x in listed else "" for x in words_of(text))
    shares = {k: {kind: {i: n / sum(c.values()) for i, n in c.items()} for kind, c in v.items()} for k, v in shares.items()}
    texts = {i: t for i, t, _ in rows}
    for r in found:
        assert r.divergence == pytest.approx(brute_distance(texts[r.doc_id], shares, listed), abs=1e-6)


def test_quality_without_languages(spark):
    docs = spark.createDataFrame([(1, "a b " * 40, None), (1, "x y z " * 30, None)], "doc_id long, text string, lang string")
    assert [r.divergence for r in quality.rate(docs).collect()] == [None, None]
    # Texts that share neither a character class nor a word with any language lie at distance 1.
    plus = docs.union(spark.createDataFrame([(2, " ".join(f"{a}{b}" for a in "abcdefghi" for b in "abcdefghi" if a != b), "en"), (3, " ".join("\u4e2d" * k for k in range(1, 90)), None)], docs.schema))
    assert {r.doc_id: r.kept for r in quality.rate(plus).where("doc_id > 1").collect()} == {2: True, 3: False}


def test_language_id(spark, both, empty):
    docs = both[1].withColumn("held_out", langid.held_out(F.col("doc_id"))).withColumn("score", F.lit("old"))
    model = langid.train(docs.where("not held_out"))
    assert model.languages == tuple(sorted(r[0] for r in docs.where("not held_out").select("lang").distinct().collect()))
    found = langid.predict(docs, model).collect()
    tested = [r for r in found if r.held_out and len(r.text) > 100]
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r for r in langid.predict(both[0], model).collect()}
    assert all(odd[i].lang_pred == "und" for i in (0, 1, 2)) and odd[3].lang_pred != "und"
    alone = spark.createDataFrame([(1, "123 !?", None, None, None)], DOCS)
    assert langid.predict(alone, model).first().lang_pred == "und"
    assert langid.predict(empty, model).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(both[0], nothing).collect()} == {"und"}


def test_language_scores_by_hand(spark):
    """Counts, log probabilities, the posterior and the fit, worked out with plain integers and dictionaries."""

    def grams(text):
        folded = [c.lower() if c.isalpha() else " " for c in text]
        for k in langid.ORDERS:
            for j in range(len(folded) - k + 1):
                part = folded[j : j + k]
                if any(c != " " for c in part):
                    h = k * 0x9E3779B1 % (1 << 32)
                    for c in part:
                        h = (h ^ ord(c)) * 0x85EBCA6B % (1 << 32)
                        h ^= h >> 13
                    yield h % langid.BUCKETS

    seen = [("the cat and the dog", "en"), ("the end of a day", "en"), ("der Hund und die Katze", "de"), ("le chat, la fête", "fr")]
    model = langid.train(spark.createDataFrame([(i, t, g, None, None) for i, (t, g) in enumerate(seen)], DOCS))
    asked = ["the hound", "die Katze sah 3 Hunde", "la fête et le chat noir", "Ø", "und the", "½ ² Ⅷ", "٣ 12", ""]
    found = {r.text: r for r in langid.predict(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(asked)], DOCS), model).collect()}
    counts = {g: Counter(b for t, h in seen if h == g for b in grams(t)) for g in ("de", "en", "fr")}
    logs = {g: {b: np.log((c[b] + 1) / (sum(c.values()) + langid.BUCKETS)) for b in range(langid.BUCKETS)} for g, c in counts.items()}
    rows = Counter(g for _, g in seen)
    for text in asked:
        own = list(grams(text))
        if not own:
            assert (found[text].lang_pred, found[text].score, found[text].fit) == ("und", 0, 0)
            continue
        total = {g: np.log((rows[g] + 1) / (len(seen) + 3)) + sum(logs[g][b] for b in own) for g in counts}
        best = max(sorted(total), key=total.get)
        assert found[text].lang_pred == best
        assert found[text].score == pytest.approx(1 / sum(np.exp(x - total[best]) for x in total.values()), abs=1e-4)
        usual = sum(np.exp(x) * x for x in logs[best].values())
        assert found[text].fit == pytest.approx(sum(logs[best][b] for b in own) / len(own) - usual, abs=1e-3)


def test_language_model_counts(spark):
    """The counts behind the model against counting by hand."""
    docs = spark.createDataFrame([(1, "Ab ab", "x", None, None), (2, "é1é", "y", None, None)], DOCS)
    model = langid.train(docs)
    for i, text in enumerate(("ab ab", "é é")):
        column = pa.array([text])
        want = np.ones(langid.BUCKETS)
        for _, _, data, offsets in slices(column):
            for bucket, _ in langid.ngram_buckets(data, offsets):
                np.add.at(want, bucket, 1)
        assert np.allclose(model.weights[i], np.log(want / want.sum()), atol=1e-5)
        n = sum(any(c.isalpha() for c in text[j : j + k]) for k in langid.ORDERS for j in range(len(text) - k + 1))
        assert want.sum() - langid.BUCKETS == n


def test_pieces_of_wide_alphabets_match_the_library():
    import random

    import sentencepiece

    path, some = public_tokenizers.path("piece_bpe_32k.model"), random.Random(1)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(chr(some.choice([32, 32, 97, 98, 101, some.randrange(33, 0x500), some.randrange(0x4E00, 0x6000), 0x1F600 + some.randrange(50)])) for _ in range(2000)), "a" * 3000, " " * 40 + "x", "", "internationalization \n\n é"]
    raw = [t.encode() for t in texts]
    ids, bounds = pieces.PieceModel(path).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t) for t in texts]


def test_pieces_match_the_library(spark, both, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in both:
        coded = pieces.decode(pieces.encode(docs.withColumn("ids", F.lit("old")), path), path).collect()
        for r in coded:
            assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert pieces.decode(pieces.encode(empty, path), path).count() == 0


def brute_repeats(rows, window):
    seen, first = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words_of(t)
        for j in range(len(w) - window + 1):
            first.append((i, j, seen.setdefault(tuple(w[j : j + window]), (i, j))))
    gone = defaultdict(set)
    for i, j, f in first:
        if f != (i, j):
            gone[i].update(range(j, j + window))
    return {i: (len(words_of(t)), len(gone[i]), " ".join(x for p, x in enumerate(words_of(t)) if p not in gone[i])) for i, t in rows}


@pytest.mark.parametrize("window", [8, 20, 27])
def test_substring_dedup(spark, both, empty, window):
    passage, rng = base_text(60, 77, 10**6), np.random.default_rng(8)
    planted = []
    for i in range(60):
        a, b = sorted(rng.integers(0, 60, 2))
        middle = " ".join(passage.split()[a:b]) if i % 3 else passage
        planted.append((i * 3, f"{base_text(30, 100 + i, 10**6)}\n{middle}  {base_text(30, 300 + i, 10**6)} {'r ' * (i % 5 * 12)}", None, None, None))
    for docs in [*both, spark.createDataFrame(planted, DOCS)]:
        found = substrings.drop_repeats(docs.withColumn("n_words", F.lit("old")), window=window).collect()
        want = brute_repeats([(r.doc_id, r.text) for r in found], window)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == want
    assert substrings.drop_repeats(empty, window=window).count() == 0
    twice = spark.createDataFrame([(1, passage, None, None, None)] * 2 + [(None, passage, None, None, None)], DOCS)
    assert sorted(r.n_removed for r in substrings.drop_repeats(twice, window=window).collect()) == [0, 0, 60]


def test_occurrences_come_from_the_automata(monkeypatch):
    passage = base_text(45, 5, 10**6)
    ids, places = np.array([4, 2, 9]), np.array([0, 3, 0])
    texts = pa.array([f"a b {passage} c", passage, base_text(50, 6, 10**6)])
    found = [x.tolist() for x in substrings.match_passages(ids, places, texts, 20)]
    assert found == [[4], [2], [47]]
    unlike = substrings.Passages(*substrings.utf8(texts), ids, places, 20)
    unlike.hashes[:] = 7  # all windows of one hash: words decide
    first, count = unlike.settle(np.arange(len(unlike.at)))
    assert (first != np.arange(len(first))).sum() == 26 and count.max() == 2
    monkeypatch.setattr(substrings.Passages, "occurrences", lambda self, patterns: np.zeros(0, np.int64))
    assert not len(substrings.match_passages(ids, places, texts, 20)[0])


def test_common_windows_are_sent_once_a_task():
    passage, sent = base_text(30, 7, 10**6), substrings.Sent()
    slice_of = lambda *ids: substrings.Passages(*substrings.utf8(pa.array([passage] * len(ids))), np.array(ids), np.zeros(len(ids), np.int64), 20)
    one = slice_of(5, 6)
    lead = np.arange(11)
    assert not len(sent.sift(one, lead, lead))
    assert sent.sift(slice_of(7), lead[:0], lead).tolist() == lead.tolist()
    assert not len(sent.sift(slice_of(3), lead[:0], lead)) and not len(sent.sift(slice_of(5), lead[:0], lead))


def brute_lines(rows, min_docs):
    key = lambda x: lowered(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return {i: (len((t or "").split("\n")), sum(n[key(x)] >= min_docs for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if n[key(x)] < min_docs)) for i, t in rows}


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, 0])
def test_line_dedup(spark, both, empty, limit):
    common = [(i, f"Own line {i}\n {'KEEP me' if i % 2 else 'keep ME'}\t\n\nlast {i % 3}", None, None, None) for i in range(40)]
    for docs in [*both, spark.createDataFrame(common, DOCS)]:
        for least in (2, 10):
            found = lines.drop_frequent_lines(docs.withColumn("n_lines", F.lit("old")), min_docs=least, broadcast_bytes=limit).collect()
            want = brute_lines([(r.doc_id, r.text) for r in docs.collect()], least)
            assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in found} == want
    assert lines.drop_frequent_lines(empty, broadcast_bytes=limit).count() == 0


def test_line_index_finds_its_keys_and_no_others():
    keys = np.random.default_rng(1).integers(1, 1 << 63, (50_000, 2), dtype=np.uint64)
    keys[1, 0] = keys[0, 0]  # half of the hash in common
    for most, limit, whole in ((10, 65_535, False), (1 << 20, (1 << 32) - 1, True)):
        index = lines.LineIndex(keys, 2 * np.arange(len(keys)) + 1, most, whole)
        assert (index.count(keys) == np.minimum(2 * np.arange(len(keys)) + 1, limit)).all() and len(index.prints) == len(keys)
        assert not index.count(keys + np.uint64(1 << 63)).any()


def test_packing(spark, both, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for docs in both:
        for length in (64, 2048):
            packed = packing.pack_documents(docs, path, length=length, with_ids=True)
            rows = packed.collect()
            by_doc, by_sequence = defaultdict(list), defaultdict(list)
            for r in rows:
                by_doc[r.doc_id].append(r)
                by_sequence[r.sequence_id].append(r)
            for d in docs.collect():
                own = sorted(by_doc[d.doc_id], key=lambda r: r.start)
                assert [i for r in own for i in r.ids] == [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
                assert all(r.doc_tokens == sum(x.length for x in own) for r in own)
            assert sorted(by_sequence) == list(range(len(by_sequence)))
            for own in by_sequence.values():
                at = 0
                for r in sorted(own, key=lambda r: r.offset):
                    assert r.offset == at
                    at += r.length
                assert at <= length
            total = sum(r.length for r in rows)
            assert len(by_sequence) <= max(total / length * 1.06, total / length + 1)
            laid = packing.sequences(packed, length).collect()
            assert all(len(r.ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else length) for r in laid)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_of_repeated_keys_and_ties(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two three " * 400, "a b", "a b", None, "", "x"]
    docs = spark.createDataFrame([(i % 2 if i < 4 else None, t) for i, t in enumerate(texts * 5)], "doc_id long, text string").withColumn("length", F.lit("old"))
    rows = packing.pack_documents(docs, path, length=64).collect()
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len(rows) == packing.token_pieces(docs, path, 64, 1).count() and sum(r.length == 64 for r in rows) > 50
    for (s, at, n), (t, then, _) in zip(spans, spans[1:], strict=False):
        assert (t, then) in ((s, at + n), (s + 1, 0)) and at + n <= 64


def test_pattern_counts_hold_every_piece():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 101, 20), rng.integers(1, 500, 20), strict=True)}
        patterns = packing.pack_histogram(counts, 100)
        held = Counter()
        for times, pattern in patterns:
            assert sum(s * n for s, n in pattern) <= 100
            for s, n in pattern:
                held[s] += times * n
        assert held == Counter(counts)


def test_warc(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (7, "u", "own\r\n\r\nWARC/1.1\r\n"), (9, "u", "<p>é</p>"), (9, "u", "<p>é</p>"), (None, "u", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("old"))
    path = str(tmp_path / "warc")
    warc.write_archives(warc.resolve_revisits(pages), path, file_bytes=900)
    files = sorted((tmp_path / "warc").iterdir())
    assert len(files) > 1 and sum(len(gzip.decompress(f.read_bytes()).split(b"WARC-Record-ID:")) - 1 for f in files) == len(rows)
    assert sum(f.read_bytes().count(b"\x1f\x8b\x08") for f in files) == len(rows)  # a member for each record
    records = warc.read_archives(spark, path)
    found = sorted((r.page_id or "", r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.with_payload_size(records).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    best = {t or "": max((i or 0) for i, _, u in rows if (u or "") == (t or "")) for _, _, t in rows}
    want = sorted((str(i) if i else "", "revisit" if i and i < best[t or ""] else "response", len((t or "").encode()), digest(t), str(best[t or ""]) if i and i < best[t or ""] else None) for i, _, t in rows)
    assert found == want
    assert {r.payload.decode() for r in records.where("record_type = 'response'").collect()} == {t or "" for _, _, t in rows}
    for f in files:  # the same archives in one member each
        f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes())))
    assert warc.read_archives(spark, path).count() == len(rows)
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    (files[0].parent / "bad.warc.gz").write_bytes(gzip.compress(whole.replace(b"null id", b"null di")))
    with pytest.raises(Exception, match="is not what its digest says"):
        warc.read_archives(spark, path).collect()
    monkeypatch.setattr(warc, "FEW_BYTES", 0)
    again = sorted((str(r.page_id or ""), r.record_type) for r in warc.resolve_revisits(pages).collect())
    assert again == sorted((i, kind) for i, kind, *_ in want)
    large = {r.page_id: r.record_type for r in warc.resolve_revisits(pages, least_bytes=9).collect() if r.page_id}
    assert large[3] == large[4] == "response" and large[1] == "revisit"
    warc.write_archives(warc.resolve_revisits(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_queries_have_the_contract_columns(spark):
    want = {
        "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op2": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op3": "doc_id n_shingles component_id",
        "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op5": "doc_id held_out lang_pred score",
        "op6": "doc_id n_ids",
        "op7": "doc_id n_words n_removed kept_sha256",
        "op8": "doc_id n_lines n_dropped kept_sha256",
        "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op10": "page_id payload_bytes payload_digest record_type refers_to",
    }
    for name, query in queries.queries().items():
        assert query(spark, SMALL).columns[: len(want[name.split("_")[0]].split())] == want[name.split("_")[0]].split()
