"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) in every task over all labelled rows; Spark adds the counts. The matrix of log
probabilities has languages x buckets entries whatever the corpus size and is broadcast. Scoring gathers the columns
of a text's n-grams and adds them up by row, in numpy, a slice of a batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm._shared import stage
from searchloom.llm._text import inside, slices

BUCKETS = 1 << 14
SLICE = 1 << 18  # bytes of text at once: an order of n-grams takes some forty times that
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 500
UNKNOWN = "und"
_fold: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """Code points below 0x10000 lowered; what is no letter is a blank."""
    if not _fold:
        table = np.full(0x10000, 32, np.uint32)
        for i in range(0x10000):
            if chr(i).isalpha():
                low = chr(i).lower()
                table[i] = ord(low) if len(low) == 1 else i
        _fold.append(table)
    return _fold[0]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, orders=ORDERS, buckets: int = BUCKETS):
    """(bucket, row) arrays of the n-grams of all rows, one pair of arrays per order."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    bounds = starts[offsets]
    codes = np.where(points < 0x10000, _lower()[np.minimum(points, 0xFFFF)], points)
    for n in orders:
        at, rows = inside(bounds, n)
        h = np.full(len(at), n * 0x9E3779B1 % (1 << 32), np.uint32)
        for j in range(n):
            h = (h ^ codes[at + j]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        letters = codes[at] != 32
        for j in range(1, n):
            letters |= codes[at + j] != 32
        yield (h[letters] % np.uint32(buckets)).astype(np.int64), rows[letters]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # languages x buckets, log probabilities
    prior: np.ndarray

    def usual(self) -> np.ndarray:
        """Each language's mean log probability of its own n-grams."""
        return (np.exp(self.weights.astype(np.float64)) * self.weights).sum(1) if self.languages else np.zeros(0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Fits on all rows of docs with a language and a text. MAX_LANGUAGES bounds the matrix; more are an error."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        rows_of: dict[str, int] = {}

        def out():
            for name, n in held.items():
                some = np.flatnonzero(n)
                yield pa.record_batch([pa.array([name] * (len(some) + 1)), pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(n[some], rows_of[name]))], ["lang", "bucket", "n"])
            held.clear()
            rows_of.clear()

        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, offsets in slices(batch.column(0), SLICE):
                mine, code = np.unique(names[lo:hi].astype(str), return_inverse=True)
                for i, name in enumerate(mine):
                    held.setdefault(name, np.zeros(buckets, np.int64))
                    rows_of[name] = rows_of.get(name, 0) + int((code == i).sum())
                for bucket, rows in ngram_buckets(data, offsets, buckets=buckets):
                    both = np.bincount(code[rows] * buckets + bucket, minlength=len(mine) * buckets).reshape(len(mine), buckets)
                    for i, name in enumerate(mine):
                        held[name] += both[i]
            if len(held) > MAX_LANGUAGES:
                yield from out()
        yield from out()

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stage(counts, "ngram-counts")
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    weights, prior = np.ones((len(names), buckets)), np.ones(len(names))
    at = {name: i for i, name in enumerate(names)}
    for name, bucket, n in counts.toPandas().itertuples(index=False):  # at most languages x (buckets + 1) rows
        if bucket < 0:
            prior[at[name]] += n
        else:
            weights[at[name], bucket] += n
    weights = np.log(weights / weights.sum(1, keepdims=True))
    return Model(tuple(names), weights.astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and fit: the likeliest language, its posterior probability, and how likely the text's
    n-grams are in it: their mean log probability, less the mean of that language itself.

    score nears 1 for some language on any text of more than a few words; fit is about 0 on texts in that language and
    well below on others. A null text, or one without a letter, is `und` with score and fit 0, and so is every text
    where the model knows no language. Ties go to the first language by name. Columns of these names are replaced;
    empty input stays empty.
    """
    docs = docs.drop("lang_pred", "score", "fit")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text), [*docs.columns, "lang_pred", "score", "fit"]
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])

    def score(batches):
        model = held.value
        known, usual = np.array([*model.languages, UNKNOWN], object), model.usual()
        for batch in batches:
            best, sure, fit = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            column = batch.column(at)
            for lo, hi, data, offsets in slices(column, SLICE) if model.languages else ():
                total, grams = np.tile(model.prior, (hi - lo, 1)), np.zeros(hi - lo, np.int64)
                for bucket, rows in ngram_buckets(data, offsets, buckets=model.weights.shape[1]):
                    grams += np.bincount(rows, minlength=hi - lo)
                    for i, row in enumerate(model.weights):
                        total[:, i] += np.bincount(rows, row[bucket], hi - lo)
                top = total.max(1, keepdims=True)
                lettered = np.array([has_letter(t) for t in column.slice(lo, hi - lo).to_pylist()], bool)
                first = total.argmax(1)
                best[lo:hi] = np.where(lettered, first, len(model.languages))
                sure[lo:hi] = np.where(lettered, 1 / np.exp(total - top).sum(1), 0)
                fit[lo:hi] = np.where(lettered, (top[:, 0] - model.prior[first]) / np.maximum(grams, 1) - usual[first], 0)
            yield pa.record_batch([*batch.columns, pa.array(known[best].tolist(), pa.string()), pa.array(sure), pa.array(fit)], names)

    return docs.mapInArrow(score, schema)


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo folds. A null id is kept from it."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))
