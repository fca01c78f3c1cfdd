"""SimHash groups, fill-in-middle and alignment against brute-force versions, on small documents and on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from searchloom.llm import alignment, infilling, queries, simhash

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, fingerprint string, form string"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"w{x}" for x in rng.integers(0, 5000, 6000))
    texts = [None, "", " \n\t ", "one", "Two words", "two  WORDS", "a b c d", "a b c d e", long, long, long + " more", "é à ü — 中文 😀\n😀", "x <P> y\nz", "a<S>", "line\n" * 30, "\n\n\nend", "no end\n", "▁ blank", "tab\tand <s> </s> <|endoftext|> <0x41>", "\x00\x01", "ﬁ Å ½"]
    rows = [(i, t, None, "old", "old") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (8, long, "x", None, None), (3, "other text of row three", None, None, None), (None, "two words", None, None, None), (None, "null key alone in its group of links", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def both(spark, awkward):
    found = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [awkward, found]


def brute_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most):
    """The label of each distinct fingerprint: the smallest one that links lead to."""
    fps = sorted(set(fps))
    label = {f: f for f in fps}
    while True:
        low = {f: min(label[g] for g in fps if (f ^ g).bit_count() <= most) for f in fps}
        if low == label:
            return label
        label = low


def test_simhash_groups(both):
    for docs in both:
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
        label = brute_components([f for _, f in rows], 4)
        least = defaultdict(list)
        for i, f in rows:
            least[label[f]].append(i)
        want = Counter((i, f"{f:016x}", min((x for x in least[label[f]] if x is not None), default=None)) for i, f in rows)
        found = simhash.near_groups(docs)
        assert found.columns == ["doc_id", "fingerprint", "component"]
        assert Counter(map(tuple, found.collect())) == want
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group, hot_keys", [(1 << 20, 100), (24, 0), (3, 100_000)])
def test_links_of_dense_groups(spark, group, hot_keys):
    """Centres with chains of near values around them: every split of large keys, and the flips, give the same components."""
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(6):
        now = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                now ^= 1 << int(b)
            fps.append(now)
    fps += [fps[0] ^ (1 << b) for b in range(40)] + [0, 1, 31, 63, (1 << 64) - 1]
    docs = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fingerprint long")
    scratch = simhash.Scratch(spark)
    roots = {r.node: r.root for r in simhash.components(simhash.links(docs, 4, scratch, group, hot_keys)).collect()}
    label = brute_components(fps, 4)
    signed = lambda f: int(np.uint64(f).astype(np.int64))
    found = {f: roots.get(signed(f), signed(f)) for f in set(fps)}
    groups = lambda named: sorted(sorted(f for f in named if named[f] == root) for root in set(named.values()))
    assert groups(found) == groups(label)


def test_every_near_pair_shares_a_key():
    rng = np.random.default_rng(1)
    for most in (2, 4):
        for _ in range(300):
            bits = rng.choice(64, most, replace=False) if rng.random() < 0.5 else rng.integers(0, 24, most)
            differ = {int(b) // 8 for b in bits}
            weight = Counter(int(b) // 8 for b in set(map(int, bits)))
            starts = [s for s in range(8) if all(sum(weight[(s + i) % 8] for i in range(n)) <= x for n, x in enumerate(simhash.budgets(most)))]
            assert starts
            for s in starts:
                assert any(all((s + p) % 8 not in differ for p in q) for q in simhash.patterns(4, most))


def units(text, unit):
    return re.findall({"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^ \t-\r]*[ \t-\r]|[^ \t-\r]+", "char": r"(?s)."}[unit], text)


@pytest.mark.parametrize("unit", ["line", "sentence", "word", "char"])
def test_fill_in_middle(both, unit):
    for docs in both:
        found = infilling.fill_in_middle(docs.withColumn("row", F.monotonically_increasing_id()), unit=unit, spm_percent=50, fim_percent=80)
        found = found.withColumn("back", infilling.restored(F.col("fim_text"), F.col("form"))).collect()
        assert len(found) == docs.count()
        forms = Counter()
        for r in found:
            text, h = r.text or "", hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
            n = len(units(text, unit))
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            pre, mid, suf = ("".join(units(text, unit)[p:q]) for p, q in ((0, a), (a, b), (b, n)))
            form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 80 else "spm" if h4 % 100 < 50 else "psm"
            want = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
            assert (r.n_units, r.form, r.fim_text, r.back) == (n, form, want, text)
            assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(pre), len(mid)))
            forms[form] += 1
        assert len(forms) == 3
    assert infilling.fill_in_middle(docs.limit(0), unit=unit).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 5, n).astype(np.uint8)
        wavelets = infilling.WaveletMatrix(codes)
        for c in range(6):
            places = np.flatnonzero(codes == c)
            assert wavelets.rank(c, np.arange(n + 1)).tolist() == [int((codes[:i] == c).sum()) for i in range(n + 1)]
            assert wavelets.select(c, np.arange(len(places))).tolist() == places.tolist()


def test_common_places():
    rng = np.random.default_rng(4)
    for n, m in ((0, 0), (0, 9), (1, 500), (300, 5000), (900, 1000), (700, 20)):
        a, b = (np.unique(rng.integers(0, 6000, x)) for x in (n, m))
        p, q = alignment.common(a, b)
        assert a[p].tolist() == b[q].tolist() == np.intersect1d(a, b).tolist()


def brute_alignment(text):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in seen)}
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def one(text):
        whole = (" " + (text or "")).encode()
        x, y = a.encode(whole.decode(), add_special_tokens=False).ids, b.encode(text or "")
        p, q = [bytes(byte[c] for c in a.id_to_token(i)) for i in x], [spell_b(i) for i in y]
        if not text or b"".join(p) != whole or b"".join(q) != whole:
            return 0, 0, [], []
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (p, q)]
        groups, links, at = [], [], (0, 0)
        places = [{end: i for i, end in enumerate(side, 1)} for side in ends]
        for end in sorted(set(ends[0]) & set(ends[1])):
            i, j = (side[end] for side in places)
            groups.append(",".join(map(str, x[at[0] : i])) + "|" + ",".join(map(str, y[at[1] : j])))
            links.append((x[i - 1], y[j - 1]))
            at = i, j
        return len(x), len(y), groups, links

    return [one(t) for t in text]


@pytest.mark.parametrize("rare", [False, True])
def test_alignment(spark, both, rare, monkeypatch):
    for docs in both:
        rows = docs.select("doc_id", "text").collect()
        want = brute_alignment([r.text for r in rows])
        count = Counter(link for w in want for link in w[3])
        best = Counter()
        for (_, y), n in count.items():
            best[y] = max(best[y], n)
        expected = Counter()
        for r, (n_a, n_b, groups, links) in zip(rows, want, strict=True):
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            expected[r.doc_id, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha] += 1
        aligned = alignment.align(docs, BYTES, PIECES)
        for r in aligned.select("n_a", "n_b", "a_ids", "b_ids", "a_cuts", "b_cuts", "links", "groups").limit(50).collect():
            a, b = [0, *r.a_cuts], [0, *r.b_cuts]
            spans = [",".join(map(str, r.a_ids[p:q])) + "|" + ",".join(map(str, r.b_ids[s:t])) for p, q, s, t in zip(a, a[1:], b, b[1:], strict=False)]
            assert ";".join(spans) == r.groups and (a[-1], b[-1]) == (r.n_a, r.n_b) == (len(r.a_ids), len(r.b_ids))
        aligned = aligned.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "links", alignment.digest(F.col("groups")).alias("sha"))
        if rare:
            monkeypatch.setattr(alignment, "TOP_PAIRS", 20)
        found = alignment.score_links(aligned, alignment.link_counts(aligned)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")
        assert Counter(map(tuple, found.collect())) == expected
    assert alignment.align(docs.limit(0), BYTES, PIECES).count() == 0


def test_texts_that_a_side_does_not_spell():
    class Wrong(alignment.Pieces):
        def encode(self, units):
            return [[] if u == " dropped" else super(Wrong, self).encode([" other"])[0] if u == " swap!" else super(Wrong, self).encode([u])[0] for u in units]

    found = list(alignment.aligned(pa.array(["fine one", "dropped", "a swap!", "fine two"]), alignment.ByteLevel(BYTES), Wrong(PIECES)))
    sizes = np.diff(found[0][2][1])
    assert (sizes > 0).tolist() == [True, False, False, True]


def test_units_are_coded_like_whole_texts(monkeypatch):
    """Random mixtures of blanks, letters, digits, marks and wide characters, with a cache that starts anew often."""
    monkeypatch.setattr(alignment, "UNITS", 50)
    rng = np.random.default_rng(7)
    parts = [" ", "  ", "   ", "\n", "\t ", " \u00a0", "\u00a0 ", "\u3000", "a", "Über", "É", " é", "'s", " 'll", "12", " 3.4", "...", " !?", "中", " 文", "\x7f", "\x7f x", "the", " the", "ing", "😀", " \x00", "\u0085 b"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(400)]
    a, b = alignment.ByteLevel(BYTES), alignment.Pieces(PIECES)
    for lo, hi, (a_ids, a_bounds, b_ids, b_bounds, *_) in alignment.aligned(pa.array(texts), a, b):
        for i in range(lo, hi):
            if a_bounds[i - lo] < a_bounds[i - lo + 1]:
                assert a_ids[a_bounds[i - lo] : a_bounds[i - lo + 1]].tolist() == a.encode([" " + texts[i]])[0], texts[i]
                assert b_ids[b_bounds[i - lo] : b_bounds[i - lo + 1]].tolist() == b.encode([" " + texts[i]])[0], texts[i]


def test_queries_of_the_three(spark):
    for name, columns in {"op11_simhash": 3, "op12_fill_in_middle": 7, "op13_alignment": 8}.items():
        found = queries.queries()[name](spark, SMALL)
        assert len(found.columns) == columns and found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_sizes_of_repeated_ids_go_by_digest(spark, tmp_path):
    from searchloom.llm import warc

    pages = spark.createDataFrame([(5, "aa"), (5, "bbbb"), (3, "aa"), (2, "bbbb"), (1, "c")], "page_id long, html string").withColumn("url", F.lit("u"))
    warc.write_archives(warc.resolve_revisits(pages), str(tmp_path / "warc"))
    found = warc.with_payload_size(warc.read_archives(spark, str(tmp_path / "warc"))).collect()
    assert sorted((int(r.page_id), r.payload_bytes, r.record_type) for r in found) == [(1, 1, "response"), (2, 4, "revisit"), (3, 2, "revisit"), (5, 2, "response"), (5, 4, "response")]
