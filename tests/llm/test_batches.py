"""The size of what passes between the JVM and workers."""

import pyarrow as pa
import pytest

import corpus_pipeline
from searchloom.llm._shared import BATCH, bound_batches, small_batches


@pytest.mark.parametrize("most", [None, 1000])
def test_stages_of_the_pipeline_read_small_batches(spark, most):
    """Before, texts came to workers in batches of 10,000, whose memory stayed with executors through all stages."""
    before = spark.conf.get(BATCH)
    try:
        if most:
            spark.conf.set(BATCH, most)
        docs = spark.createDataFrame([(n, "a b c " * 500, "en", "web", 3000) for n in range(3000)], "doc_id long, text string, lang string, source string, n_chars long")
        for name, step in corpus_pipeline.STAGES:
            if name in ("line_dedup", "packing"):
                step(spark, docs.limit(5), "")
                sizes = docs.coalesce(1).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.nbytes])], ["b"]) for b in bs), "b long").collect()
                assert max(r.b for r in sizes) < (4 << 20) + 10_000 and len(sizes) > 1
        with small_batches(spark):
            assert int(spark.conf.get(BATCH)) == (most or 4 << 20)
        assert bound_batches(spark) == str(most or 4 << 20)
    finally:
        spark.conf.set(BATCH, before)
