"""The pipeline, stage by stage, against brute force on what its predecessor kept."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from searchloom.llm import langid
from searchloom.llm._shared import stage
from tests.llm.test_operators import DOCS, SMALL, brute_groups, brute_lines, brute_repeats


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # Junk in Latin letters is not among them: 200 documents teach too little to tell its n-grams from rare ones.
    unlearned = ["это простой русский текст о погоде и людях " * 5, "½ ² Ⅷ"]
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34", "en", "s", 5), (10**6 + 2, "", None, None, 0), *((10**6 + 3 + i, t, None, "s", 9) for i, t in enumerate(unlearned))], DOCS)
    docs = stage(docs.union(odd.select(docs.columns)), "test")
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(step(spark, docs.withColumn("n_words", F.lit(1)).withColumn("score", F.lit("x")), SMALL), "test")
        rows = docs.collect()
        kept[name] = {r.doc_id: r for r in rows}
        texts = [(i, r.text) for i, r in before.items()]
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and len(rows) == len(kept[name])
        if name == "language_id":
            assert set(before) - set(kept[name]) == {i for i, r in before.items() if i >= 10**6 or not langid.has_letter(r.text)}
        elif name == "line_dedup":
            assert {i: r.text or "" for i, r in kept[name].items()} == {i: t for i, (_, _, t) in brute_lines(texts, 10).items()}
        elif name == "near_dedup":
            assert set(kept[name]) == {i for i, (_, root) in brute_groups(texts, 5, 80, 100).items() if i == root}
        elif name == "substring_dedup":
            for i, (_, gone, text) in brute_repeats(texts, 20).items():
                assert kept[name][i].text == (text if gone else before[i].text)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            n = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts}
            assert {r.doc_id: r.doc_tokens for r in rows} == n and sum(r.length for r in rows) == sum(n.values())


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SMALL)
        assert docs.count() == 0
