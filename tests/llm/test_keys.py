"""Rows without a key and rows that share one."""

import corpus_pipeline
from searchloom.llm import ngram_join
from tests.llm.test_operators import DOCS, base_text


def changed(words, *places):
    return " ".join(f"z{i}" if i in places else w for i, w in enumerate(words))


def test_sets_of_keyless_rows_are_compared(spark):
    a, b = base_text(200, 9, 5000).split(), base_text(200, 10, 5000).split()
    # 1 and 2 are linked through a row without a key alone; two rows without keys are near copies of each other.
    chain = [changed(a), changed(a, *range(0, 8)), changed(a, *range(0, 16))]
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (None, changed(b)), (None, changed(b, 5)), (2, changed(b, 5, 9)), (3, "other text altogether"), (3, chain[0])]
    found = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90, den=100).collect()
    assert sorted((r.component, r.doc_id or 0, r.n_shingles) for r in found) == [(1, 0, 198), (1, 1, 198), (1, 2, 198), (1, 3, 198), (2, 0, 198), (2, 0, 198), (2, 2, 198), (3, 3, 1)]


def test_near_dedup_decides_by_row(spark):
    a, b, c = (base_text(200, i, 5000).split() for i in (11, 12, 13))
    rows = [
        (1, changed(a), "en", "s", 1),
        (2, changed(a, 7), "en", "s", 1),  # a near copy of 1, which shares its id with an unlike text
        (2, changed(b), "en", "s", 1),
        (3, changed(c), "en", "s", 1),
        (3, changed(c), "en", "s", 1),  # an equal row
        (None, changed(b, 4), "en", "s", 1),
        (None, "one of its own without an id", "en", "s", 1),
        (None, "one of its own without an id", "en", "s", 1),
        (4, "", "en", "s", 0),
    ]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    want = [rows[0], rows[2], rows[3], rows[6], rows[8]]
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == sorted(repr(w[:2]) for w in want)
