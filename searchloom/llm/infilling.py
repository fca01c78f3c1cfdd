"""Fill-in-middle transformation: a wavelet matrix over character classes finds the cuts.

A task writes the class of each byte of a slice of texts (newline, blank, full stop, other, continuation of a code
point) into one wavelet matrix. Ranks of a class at the bounds of a text give how many units end in it and how many code
points lie between two places; where one class ends a unit, select gives the end of unit k, and where several do,
bisection on the sum of their ranks. All texts of a slice are cut at once. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm._text import slices

CONTINUED, NEWLINE, BLANK, STOP, OTHER = range(5)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x80:0xC0] = CONTINUED
CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
CLASSES[0x0A] = NEWLINE
CLASSES[np.frombuffer(b".!?", np.uint8)] = STOP
#: The classes whose bytes end a unit; a text's last unit may end without one. A code point begins with a byte of its unit.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, BLANK), "char": (NEWLINE, BLANK, STOP, OTHER)}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Bits:
    """A bit vector in words of 64, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.size, self.ones = len(bits), int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one or zero, from 0."""
        if one:
            word = np.searchsorted(self.before, k, "right") - 1
            left = k - self.before[word]
        else:
            zeros = np.arange(len(self.before)) * 64 - self.before
            word = np.searchsorted(zeros, k, "right") - 1
            left = k - zeros[word]
        held = self.words[word] if one else ~self.words[word]
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the place within its word
            low = np.bitwise_count((held >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)).astype(np.int64)
            far = left >= low
            left, at = np.where(far, left - low, left), np.where(far, at + half, at)
        return word * 64 + at


class WaveletMatrix:
    """Ranks and selects over codes below 2 ** levels: each level deals the codes by one bit, zeros before ones."""

    def __init__(self, codes: np.ndarray, levels: int = 3):
        self.size, self.levels = len(codes), []
        for level in reversed(range(levels)):
            bits = (codes >> level & 1).astype(bool)
            self.levels.append((level, Bits(bits)))
            codes = np.concatenate([codes[~bits], codes[bits]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How many codes before each place are `code`."""
        ends = np.append(np.asarray(at, np.int64), 0)
        for level, bits in self.levels:
            ones = bits.rank(ends)
            ends = ones + (bits.size - bits.ones) if code >> level & 1 else ends - ones
        return ends[:-1] - ends[-1]

    def select(self, code: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th `code`, from 0; k must be below its number."""
        first = np.zeros(1, np.int64)
        for level, bits in self.levels:
            ones = bits.rank(first)
            first = ones + (bits.size - bits.ones) if code >> level & 1 else first - ones
        at = first + np.asarray(k, np.int64)
        for level, bits in reversed(self.levels):
            one = bool(code >> level & 1)
            at = bits.select(at - (bits.size - bits.ones) if one else at, one)
        return at

    def bisect(self, codes: tuple[int, ...], count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in low..high before which at least `count` of the codes lie."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = sum(self.rank(c, middle) for c in codes) >= count
            low, high = np.where(enough | (low >= high), low, middle + 1), np.where(enough, middle, high)
        return low


def unit_ends(wavelets: WaveletMatrix, unit: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many codes that end a unit lie before each text, and how many units each has."""
    ending = UNITS[unit]
    before = sum(wavelets.rank(c, starts) for c in ending)
    found = sum(wavelets.rank(c, ends) for c in ending) - before
    if unit == "char":
        return before, found
    last = np.maximum(ends - 1, 0)
    closed = sum(wavelets.rank(c, ends) - wavelets.rank(c, last) for c in ending)
    return before, found + ((ends > starts) & (closed == 0))


def cut(wavelets: WaveletMatrix, unit: str, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, counts: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place after the first k units of each text."""
    ending, places = UNITS[unit], np.where(k >= counts, ends, starts)
    inner = np.flatnonzero((k > 0) & (k < counts))
    if not len(inner):
        return places
    wanted = before[inner] + k[inner]
    if len(ending) == 1:
        places[inner] = wavelets.select(ending[0], wanted - 1) + 1
    elif unit == "char":  # a code point ends where the next one begins
        places[inner] = wavelets.bisect(ending, wanted + 1, starts[inner], ends[inner]) - 1
    else:
        places[inner] = wavelets.bisect(ending, wanted, starts[inner], ends[inner])
    return places


def _draws(key: str, seed: int) -> list[Column]:
    """Four unsigned numbers below 2 ** 32 from a hash of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """docs with fim_text, form (plain, psm or spm), n_units, prefix_chars and middle_chars.

    A hash of seed and key draws the two cuts among the bounds of the text's units, and the form. prefix_chars and
    middle_chars are null where the form is plain: for null or empty texts (which give an empty fim_text), for texts that
    hold one of the marks, and beyond fim_percent. A null key draws as an empty one; rows that repeat a key draw alike.
    Units: lines, sentences (up to a full stop or newline), words (up to a blank) or code points. Other columns stay;
    columns of the names given here are replaced. Empty input gives an empty result.
    """
    added = ["fim_text", "form", "n_units", "prefix_chars", "middle_chars"]
    kept = [c for c in docs.columns if c not in added]
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = _draws(key, seed)
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    plain = (whole == "") | marked | (h3 % 100 >= fim_percent)
    form = F.when(plain, PLAIN).when(h4 % 100 < spm_percent, SPM).otherwise(PSM)
    asked = docs.select(*kept, whole.alias("__whole"), h1.alias("__h1"), h2.alias("__h2"), form.alias("__form"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        for batch in batches:
            draws = [np.asarray(batch.column(len(kept) + i)) for i in (1, 2)]
            forms = batch.column(len(kept) + 3)
            for lo, hi, data, offsets in slices(batch.column(len(kept))):
                wavelets = WaveletMatrix(CLASSES[data])
                starts, ends = offsets[:-1], offsets[1:]
                before, counts = unit_ends(wavelets, unit, starts, ends)
                one, two = (d[lo:hi] % (counts + 1) for d in draws)
                a = cut(wavelets, unit, starts, ends, before, counts, np.minimum(one, two))
                b = cut(wavelets, unit, starts, ends, before, counts, np.maximum(one, two))
                chars = lambda p, q: (q - p) - (wavelets.rank(CONTINUED, q) - wavelets.rank(CONTINUED, p))  # noqa: E731, B023
                raw, texts = data.tobytes(), []
                mine = forms.slice(lo, hi - lo)
                for form, s, p, q, e in zip(mine.to_pylist(), starts.tolist(), a.tolist(), b.tolist(), ends.tolist(), strict=True):
                    if form == PLAIN:
                        texts.append(raw[s:e])
                    elif form == PSM:
                        texts.append(b"".join((marks[0], raw[s:p], marks[1], raw[q:e], marks[2], raw[p:q])))
                    else:
                        texts.append(b"".join((marks[1], raw[q:e], marks[0], raw[s:p], marks[2], raw[p:q])))
                none = np.array([f == PLAIN for f in mine.to_pylist()], bool)
                numbers = [pa.array(counts, pa.int64()), pa.array(chars(starts, a), pa.int64(), mask=none), pa.array(chars(a, b), pa.int64(), mask=none)]
                yield pa.record_batch([*(c.slice(lo, hi - lo) for c in batch.columns[: len(kept)]), pa.array(texts, pa.binary()).cast(pa.string()), mine, *numbers], kept + added)

    fields = [*docs.select(*kept).schema.fields, T.StructField("fim_text", T.StringType()), T.StructField("form", T.StringType())]
    return asked.mapInArrow(run, T.StructType(fields + [T.StructField(n, T.LongType()) for n in added[2:]]))


def restored(output: Column, form: Column) -> Column:
    """The text that a fim_text of this form was made from; marks never overlap or arise where parts meet."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
