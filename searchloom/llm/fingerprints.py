"""Document fingerprints by consistent weighted sampling.

A text's terms are its hashed word shingles, weighted by how often they occur. For each of `samples` positions every
term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash, and the term of the smallest log(c) - r (t - b + 1), with
t = floor(log(weight) / r + b), is the sample; (term, t) is kept as 32 bits. Two texts agree at a position with the
probability of their generalised Jaccard similarity, sum of minima over sum of maxima of weights.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm._shared import spread
from searchloom.llm._text import LOWER, grams, inside, mix, slices, spans, words

SAMPLES, WORDS = 64, 5
EMPTY = "-"
_SLOTS = 1 << 16
_draws: list = []


def _tables():
    """Draws at _SLOTS slots: r, b, log(c), and the order-preserving bits of a weight-1 term's value, shifted by 32."""
    if not _draws:
        rng = np.random.default_rng(7)
        r, b, c = rng.gamma(2, 1, _SLOTS).astype(np.float32), rng.random(_SLOTS, np.float32), np.log(rng.gamma(2, 1, _SLOTS)).astype(np.float32)
        ones = rng.integers(1, 1 << 31, (2, 4096), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        _draws.append((r, b, c, _ordered(c - r * (1 - b)), ones))
    return _draws[0]


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 as uint64 whose upper half sorts like it."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


def terms(data: np.ndarray, offsets: np.ndarray, k: int = WORDS):
    """(32-bit term, weight, bounds of rows): a text of fewer than k words is one term; one without words has none."""
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets)
    h = spans(low, starts, ends)
    at, rows = inside(bounds, k)
    values = grams(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for n in range(1, k):
            mine = np.flatnonzero(counts[short] == n)
            if len(mine):
                extra[mine] = grams(h, n)[bounds[short[mine]]]
        values, rows = np.concatenate([values, extra]), np.concatenate([rows, short])
    both = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    fresh = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    weight = np.diff(np.append(fresh, len(both)))
    both = both[fresh]
    term = mix(both & np.uint64((1 << 48) - 1)) >> np.uint64(32)
    return term.astype(np.uint32), weight, np.searchsorted(both >> np.uint64(48), np.arange(len(offsets)).astype(np.uint64))


def signatures(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES, k: int = WORDS) -> list[str]:
    """Each row's fingerprint: 8 hex digits per sample, or EMPTY for a text without words."""
    term, weight, bounds = terms(data, offsets, k)
    r, b, c, ones, odd = _tables()
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((samples, len(some)), np.uint32)
    heavy = np.flatnonzero(weight > 1)
    logs, low = np.log(weight[heavy]).astype(np.float32), term.astype(np.uint64)
    for i in range(samples if len(some) else 0):
        slot = (term * odd[0, i] + odd[1, i]) >> np.uint32(16)
        value = ones[slot] | low
        if len(heavy):
            at = slot[heavy]
            t = np.floor(logs / r[at] + b[at])
            seen = (mix(low[heavy] + (t.astype(np.int64).astype(np.uint64) << np.uint64(32))) >> np.uint64(32)).astype(np.uint32)
            value[heavy] = _ordered(c[at] - r[at] * (t - b[at] + 1)) | np.where(t == 0, term[heavy], seen)
        out[i] = np.minimum.reduceat(value, bounds[some]).astype(np.uint32)
    prints = [EMPTY] * (len(offsets) - 1)
    for row, print_ in zip(some.tolist(), out.T.astype(">u4"), strict=True):
        prints[row] = print_.tobytes().hex()
    return prints


def fingerprint(docs: DataFrame, text: str = "text", samples: int = SAMPLES, k: int = WORDS) -> DataFrame:
    """docs with `fingerprint`; a null text is as an empty one, equal texts have equal fingerprints."""
    docs = docs.drop("fingerprint")
    at, names = docs.columns.index(text), [*docs.columns, "fingerprint"]

    def sign(batches):
        for batch in batches:
            prints = [p for _, _, data, offsets in slices(batch.column(at)) for p in signatures(data, offsets, samples, k)]
            yield pa.record_batch([*batch.columns, pa.array(prints, pa.string())], names)

    return docs.mapInArrow(sign, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints: 1 for two texts without words, 0 for one of them."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, i: n + F.when(F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8)), 1).otherwise(0))
    return F.when((a == EMPTY) | (b == EMPTY), (a == b).cast("double")).otherwise(same / F.lit(float(samples)))


def _like(a: str, b: str) -> float:
    if EMPTY in (a, b):
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), ">u4"), np.frombuffer(bytes.fromhex(b), ">u4")
    return float((x == y).mean())


def with_successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, __bucket, __tail) sorted by key, ties by text, within buckets of consecutive keys; null keys first.

    Ranges of keys are cut at estimated quantiles. The first row of each range is also sent, as __tail, to the end of
    the range before it (that of the first range to the last), so that every row is followed by its successor after
    one shuffle of the texts. One key per range is all that comes to the driver.
    """
    ranges = 4 * spread(docs.sparkSession)
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    cuts = np.array(sorted(set(docs.select(order.cast("double").alias("k")).stat.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.002))))
    bucket_of = F.pandas_udf(lambda k: pd.Series(np.searchsorted(cuts, k.to_numpy(np.float64), "right")), "int")
    firsts = sorted((r["b"], r["k"]) for r in docs.select(order.alias("k")).withColumn("b", bucket_of("k")).groupBy("b").agg(F.min("k").alias("k")).collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    tail_of = F.pandas_udf(lambda k: k.map(before).fillna(-1).astype(int), "int")
    rows = docs.select(F.col(key), F.col(text), order.alias("__k")).withColumns({"__own": bucket_of("__k"), "__before": tail_of("__k")})
    homes = F.array(F.struct(F.col("__own").alias("b"), F.lit(0).alias("t")), F.struct(F.col("__before").alias("b"), F.lit(1).alias("t")))
    placed = rows.select(key, text, F.explode(F.filter(homes, lambda h: h["b"] >= 0)).alias("__to"))
    placed = placed.select(key, text, F.col("__to.b").alias("__bucket"), F.col("__to.t").alias("__tail"))
    return placed.repartition(ranges, "__bucket").sortWithinPartitions("__bucket", "__tail", key, text)


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, k: int = WORDS) -> DataFrame:
    """Fingerprints every text and its edited text, and likens the text to that and to the next document's text.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next
    row by key, that of the last row being the first; a table of one row is its own successor. Rows that repeat a
    key go by text. A null text is empty. Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; others are not carried. Empty input gives an empty result.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [docs.schema[key].dataType, T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]

    def prints(texts):
        return [p for _, _, data, offsets in slices(pa.array(texts, pa.string())) for p in signatures(data, offsets, samples, k)]

    def worked(rows, kind):
        """The rows but the last, each followed by its successor unless it is a tail."""
        own, edited, at = [r[1] for r in rows], [], []
        for i, (now, then) in enumerate(zip(rows, rows[1:], strict=False)):
            if not now[3] and now[2] == then[2]:
                half = len(now[1]) // 2
                edited.append(now[1][: len(now[1]) - half] + then[1][:half])
                at.append(i)
        if not at:
            return None
        own, new = prints(own), prints(edited)
        out = [[rows[i][0], len(rows[i][1]), hashlib.sha256(e.encode()).hexdigest(), own[i], f, _like(own[i], f), _like(own[i], own[i + 1])] for i, e, f in zip(at, edited, new, strict=True)]
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def run(batches):
        held, size, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((row[0], row[1] or "", row[2], row[3]))
                size += len(held[-1][1])
                if size > 1_000_000:
                    if (out := worked(held, kind)) is not None:
                        yield out
                    held, size = held[-1:], len(held[-1][1])
        if held and (out := worked(held, kind)) is not None:
            yield out

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])
    return with_successors(docs, key, text).mapInArrow(run, schema)
