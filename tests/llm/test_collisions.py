"""Texts that collide under a sum of bytes by place are told apart."""

import numpy as np

from searchloom.llm import lines, ngram_join, substrings
from searchloom.llm._text import spans
from tests.llm.test_operators import DOCS


def doubled(steps=10):
    """Two words of 2^steps letters whose sums of letters times powers of an odd base are equal modulo 2^64."""
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def test_spans_tell_the_doubling_sequence_apart():
    for steps in (5, 8, 10):
        a, b = doubled(steps)
        data = np.frombuffer((a + b).encode(), np.uint8)
        n = len(a)
        for seed in (0, 1):
            x, y = spans(data, np.array([0, n]), np.array([n, 2 * n]), seed)
            assert x != y


def test_lines_words_and_sets_of_colliding_texts_stay_apart(spark):
    a, b = doubled()
    rows = [(i, a if i < 5 else b, None, None, None) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.n_dropped for r in lines.drop_frequent_lines(docs, min_docs=10).collect()} == {0}
    found = {r.doc_id: r.component for r in ngram_join.jaccard_groups(docs, k=3, num=90, den=100).collect()}
    assert found == {i: 0 if i < 5 else 5 for i in range(10)}
    tail = " ".join(f"t{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {tail}", None, None, None), (2, f"{b} {tail}", None, None, None), (3, f"{b} {tail}", None, None, None)], DOCS)
    assert {r.doc_id: r.n_removed for r in substrings.drop_repeats(docs, window=20).collect()} == {1: 0, 2: 0, 3: 20}
