"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, by galloping intersection.

Both tokenizers encode a text, and the byte offsets at which their tokens end are two ascending lists. The shorter one
drives: each of its offsets is sought in the longer one by doubling steps from where an earlier one was found, then by
bisection. Common offsets slice both id lists into groups of equal bytes; ranks on both sides of a cut tell which tokens
a group spans. Texts are coded one slice of a batch at a time, and each slice counts its pairs before they are shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm._text import slices, spans

HEAD = 64  # every how many offsets one is sought first
TOP_PAIRS = 500_000  # the most common pairs, which every task holds: at most 8 MB
SLICE_TEXT = 1 << 18
UNITS = 200_000  # encoded units that a worker keeps
_coders: dict[tuple[str, str], Coder] = {}


def gallop(wanted: np.ndarray, among: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place in ascending `among` that holds `wanted` or more, for each of `wanted`, at `start` or later.

    Steps double from `start` until they reach that far; bisection finds the place within the last step.
    """
    low, step = start.copy(), np.ones(len(wanted), np.int64)
    live = np.arange(len(wanted))
    end = len(among)
    while len(live):
        far = low[live] + step[live] - 1
        short = (far < end) & (among[np.minimum(far, end - 1)] < wanted[live]) if end else np.zeros(len(live), bool)
        live = live[short]
        low[live] += step[live]
        step[live] *= 2
    high = np.minimum(low + step - 1, end)
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        less = among[middle] < wanted[live]
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
        live = live[low[live] < high[live]]
    return low


def common(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the numbers that both ascending lists hold, in each; the shorter list drives.

    One number in HEAD is sought from the first place on by doubling steps, the others from the place of that one before.
    """
    if len(short) > len(long):
        there, here = common(long, short)
        return here, there
    heads = gallop(short[::HEAD], long, np.zeros(-(-len(short) // HEAD), np.int64))
    at = gallop(short, long, np.repeat(heads, HEAD)[: len(short)])
    found = np.flatnonzero(at < len(long))
    found = found[long[at[found]] == short[found]]
    return found, at[found]


class Coder:
    """A tokenizer that encodes each distinct unit once; what it keeps is bounded by UNITS and does not change results."""

    spelled: pa.BinaryArray  # the bytes that each id stands for

    def __init__(self):
        self.sizes = np.asarray(pc.binary_length(self.spelled)).astype(np.int64)
        self.clear()

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of texts that begin with a blank."""
        raise NotImplementedError

    def clear(self):
        self.uses = np.zeros(0, np.int32)  # how many slices had each unit since it was learnt or kept
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of known units, by key
        self.begin, self.count, self.fits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0

    def shrink(self):
        """Forgets units of one slice, or all where the others are too many."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > UNITS // 2:
            return self.clear()
        count = self.count[kept]
        cuts = np.concatenate([[0], np.cumsum(count)])
        flat = self.flat[np.arange(cuts[-1]) + np.repeat(self.begin[kept] - cuts[:-1], count)]
        number = np.full(len(self.uses), -1, np.int64)
        number[kept] = np.arange(len(kept))
        known = number[self.numbers] >= 0
        self.keys, self.numbers = self.keys[known], number[self.numbers[known]]
        self.begin, self.count, self.fits, self.uses = cuts[:-1], count, self.fits[kept], np.ones(len(kept), np.int32)
        self.flat[: len(flat)], self.used = flat, len(flat)

    def _learn(self, units: list[bytes]):
        lists = self.encode([u.decode() for u in units])
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        cuts = np.concatenate([[0], np.cumsum(count)])
        said = self.spelled.take(pa.array(ids))
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[cuts].tolist()
        raw = said.buffers()[2].to_pybytes() if len(ids) else b""
        fits = np.array([raw[p:q] == u for p, q, u in zip(at[:-1], at[1:], units, strict=True)], bool)
        self.begin, self.count, self.fits = np.concatenate([self.begin, self.used + cuts[:-1]]), np.concatenate([self.count, count]), np.concatenate([self.fits, fits])
        self.used += len(ids)

    def code(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, first: np.ndarray, inverse: np.ndarray, bounds: np.ndarray):
        """(ids, each row's bounds in them, where each token ends, which rows the ids spell) of rows of units.

        keys are the distinct units, ascending, first is one place of each, inverse which one a unit is, bounds the rows' units.
        """
        if len(self.keys) + len(keys) > UNITS:
            self.shrink()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((at == len(self.keys)) | (np.append(self.keys, np.uint64(0))[at] != keys))
        if len(new):
            numbers = len(self.begin) + np.arange(len(new))
            self._learn([raw[p:q] for p, q in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.keys, self.numbers = np.insert(self.keys, at[new], keys[new]), np.insert(self.numbers, at[new], numbers)
            at = np.searchsorted(self.keys, keys)
            self.uses = np.append(self.uses, np.zeros(len(new), np.int32))
        self.uses[self.numbers[at]] += 1
        unit = self.numbers[at][inverse]
        total = np.concatenate([[0], np.cumsum(self.count[unit])])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begin[unit] - total[:-1], self.count[unit])]
        misses = np.concatenate([[0], np.cumsum(~self.fits[unit])])[bounds]
        sizes = np.cumsum(self.sizes[ids])
        before = np.concatenate([[0], sizes])[total[bounds[:-1]]]  # bytes that the rows before spell
        token_bounds = total[bounds]
        return ids, token_bounds, sizes + np.repeat(starts[bounds[:-1]] - before, np.diff(token_bounds)), np.diff(misses) == 0


class ByteLevel(Coder):
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Byte-level entries write bytes that are printable characters as themselves, others as the characters from 256 on.
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(seen)))}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            spelled[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.spelled = pa.array(spelled, pa.binary())
        super().__init__()

    def encode(self, units: list[str]) -> list[list[int]]:
        return [got.ids for got in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class Pieces(Coder):
    """A SentencePiece model with byte fallback, which puts a blank before what it is given."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.spelled = pa.array([bytes([int(n[1:-1], 16)]) if sp.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)], pa.binary())
        super().__init__()

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode([u[1:] for u in units], num_threads=1)


def coder(kind: type, path: str) -> Coder:
    """The worker's coder for this file; workers serve many tasks."""
    if (kind.__name__, path) not in _coders:
        _coders[kind.__name__, path] = kind(path)
    return _coders[kind.__name__, path]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows' bounds of units: data holds a blank before each row, and every unit begins with one.

    A blank begins a unit where no blank is before it and a graphic ASCII character or a Latin letter of two bytes
    follows. Both tokenizers always part their tokens there: the splitting pattern of the one leaves such a blank to
    what follows, and no piece of the other has a blank after another character.
    """
    begin = np.zeros(len(data), bool)
    if len(data) > 2:
        begin[1:-1] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & (((data[2:] > 0x20) & (data[2:] < 0x7F)) | (data[2:] == 0xC3))
    begin[offsets[:-1]] = True
    after = offsets[:-1] + 1  # a blank that begins a text follows the row's own
    begin[after[after < offsets[1:]]] = False
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def aligned(batch_texts: pa.Array, a, b) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For runs of rows: (first row, end row, [a's ids, their bounds, b's ids, their bounds, a's cuts, b's cuts, their bounds]).

    Bounds have a row's first entry, and one more at the end. A cut is how many tokens of its row lie before it.
    """
    for lo, hi, data, offsets in slices(batch_texts, SLICE_TEXT):
        wide = np.full(len(data) + hi - lo, 0x20, np.uint8)
        new = offsets + np.arange(hi - lo + 1)
        solid = np.ones(len(wide), bool)
        solid[new[:-1]] = False
        wide[solid] = data
        starts, ends, bounds = units(wide, new)
        keys, first, inverse = np.unique(spans(wide, starts, ends), return_index=True, return_inverse=True)
        (a_ids, a_bounds, a_ends, a_fits), (b_ids, b_bounds, b_ends, b_fits) = (x.code(wide.tobytes(), starts, ends, keys, first, inverse, bounds) for x in (a, b))
        live = a_fits & b_fits & (np.diff(offsets) > 0)
        sides = []
        for ids, bounds, ends in ((a_ids, a_bounds, a_ends), (b_ids, b_bounds, b_ends)):
            sizes = np.diff(bounds)
            keep = np.repeat(live, sizes)
            sides.append((ids[keep], np.concatenate([[0], np.cumsum(np.where(live, sizes, 0))]), ends[keep]))
        (a_ids, a_bounds, a_ends), (b_ids, b_bounds, b_ends) = sides
        less = np.diff(a_bounds) <= np.diff(b_bounds)  # texts whose first list is the shorter one
        cuts = [np.zeros(0, np.int64)] * 2
        for mine in (less, ~less):
            here, there = np.flatnonzero(np.repeat(mine, np.diff(a_bounds))), np.flatnonzero(np.repeat(mine, np.diff(b_bounds)))
            p, q = common(a_ends[here], b_ends[there])
            cuts = [np.concatenate([cuts[0], here[p]]), np.concatenate([cuts[1], there[q]])]
        order = np.argsort(cuts[0], kind="stable")
        at_a, at_b = cuts[0][order], cuts[1][order]
        cut_bounds = np.searchsorted(at_a, a_bounds)
        rows = np.repeat(np.arange(hi - lo), np.diff(cut_bounds))
        yield lo, hi, [a_ids, a_bounds, b_ids, b_bounds, at_a + 1 - a_bounds[rows], at_b + 1 - b_bounds[rows], cut_bounds]


def numbers_with_marks(size: int) -> pa.StringArray:
    """The decimal ids below `size`, each followed by nothing, a comma, a bar and a semicolon."""
    return pa.array([f"{i}{mark}" for i in range(size) for mark in ("", ",", "|", ";")], pa.string())


def group_texts(table: pa.StringArray, a_ids, a_bounds, b_ids, b_bounds, a_cuts, b_cuts, cut_bounds) -> pa.Array:
    """Each row's groups as `a1,a2|b1;a3|b2,b3`, empty for a row without tokens."""
    rows = np.repeat(np.arange(len(cut_bounds) - 1), np.diff(cut_bounds))
    a_end, b_end = a_bounds[rows] + a_cuts, b_bounds[rows] + b_cuts  # of each group
    a_own, b_own = np.arange(len(a_ids)), np.arange(len(b_ids))
    # Tokens of both sides in the order of the text: those of a group's first side, then those of its second.
    a_place = a_own + np.concatenate([[0], b_end])[np.searchsorted(a_end, a_own, "right")]
    b_place = b_own + a_end[np.searchsorted(b_end, b_own, "right")] if len(b_own) else b_own
    codes = np.zeros(len(a_ids) + len(b_ids), np.int32)
    codes[a_place], codes[b_place] = 4 * a_ids + 1, 4 * b_ids + 1
    codes[a_place[a_end - 1]] += 1
    codes[b_place[b_end - 1]] += 2
    codes[b_place[b_end[cut_bounds[1:][np.diff(cut_bounds) > 0] - 1] - 1]] -= 3
    said = table.take(pa.array(codes))
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(said)))])[a_bounds + b_bounds].astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), said.buffers()[2] or pa.py_buffer(b""))


def align(docs: DataFrame, byte_level: str, piece_model: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_a, n_b, n_groups, groups, links[, a_ids, b_ids, a_cuts, b_cuts]) of each row.

    Ids are those of a byte-level BPE file on a blank and the text, and of a SentencePiece file on the text. A cut is
    where tokens of both end: a_cuts and b_cuts count the tokens before it, so group i spans the tokens from cut i - 1
    up to cut i. `groups` writes the groups as `a1,a2|b1;a3|b2,b3`; `links` holds the pair of tokens that end at each cut,
    as a's id * 2 ** 32 + b's id. A null or empty text, or one that either side does not spell byte by byte, has no
    tokens, empty lists and an empty `groups`. Rows that repeat a key stay rows. Other columns are not carried; empty
    input gives an empty result.
    """
    lists = ["a_ids", "b_ids", "a_cuts", "b_cuts"] if with_ids else []
    names = [key, "n_a", "n_b", "n_groups", "groups", "links", *lists]

    def run(batches):
        a, b = coder(ByteLevel, byte_level), coder(Pieces, piece_model)
        table = numbers_with_marks(max(len(a.spelled), len(b.spelled)))
        for batch in batches:
            for lo, hi, found in aligned(batch.column(1), a, b):
                a_ids, a_bounds, b_ids, b_bounds, a_cuts, b_cuts, cut_bounds = found
                rows = np.repeat(np.arange(hi - lo), np.diff(cut_bounds))
                pairs = (a_ids[a_bounds[rows] + a_cuts - 1].astype(np.int64) << 32) | b_ids[b_bounds[rows] + b_cuts - 1]
                sets = lambda values, bounds, kind: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
                columns = [*(pa.array(np.diff(x), pa.int64()) for x in (a_bounds, b_bounds, cut_bounds)), group_texts(table, *found), sets(pairs, cut_bounds, pa.int64())]
                columns += [sets(a_ids, a_bounds, pa.int32()), sets(b_ids, b_bounds, pa.int32()), sets(a_cuts, cut_bounds, pa.int32()), sets(b_cuts, cut_bounds, pa.int32())] if lists else []
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *columns], names)

    kinds = [T.LongType()] * 3 + [T.StringType(), T.ArrayType(T.LongType())] + [T.ArrayType(T.IntegerType())] * len(lists)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, t) for n, t in zip(names[1:], kinds, strict=True))])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of all rows hold each pair of ids, and whether no pair of its second id has more.

    Every batch counts its own links first. The highest count of a second id is one row per id of the vocabulary.
    """

    def count(batches):
        for batch in batches:
            pairs, n = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            yield pa.record_batch([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    counts = rows.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return counts.join(most, second == F.col("second")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(rows: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows(links, ...) with n_best (links whose pair is its second id's best) and count_sum (counts of all links).

    Every task holds the TOP_PAIRS most common pairs and looks most links up there. What is left, rare pairs, is counted
    per row and joined with their counts; no rare pair is a large group, as TOP_PAIRS others are at least as common.
    Rows are told apart by a number of their own, so that repeated keys stay rows.
    """
    spark = rows.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(TOP_PAIRS)
    held = top.toPandas().sort_values("pair")
    known = spark.sparkContext.broadcast((held["pair"].to_numpy(np.int64), held["n"].to_numpy(np.int64), held["best"].to_numpy(bool)))
    others = [c for c in rows.columns if c not in ("links", "n_best", "count_sum")]
    names = [*others, "n_best", "count_sum", "__rare"]

    def look(batches):
        pairs, n, best = known.value
        for batch in batches:
            links = batch.column(batch.schema.get_field_index("links"))
            flat, bounds = np.asarray(links.flatten()), np.concatenate([[0], np.cumsum(np.asarray(links.value_lengths()), dtype=np.int64)])
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            hit = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])  # noqa: E731, B023
            sums = [total(np.where(hit, x[at], 0)) if len(pairs) else np.zeros(batch.num_rows, np.int64) for x in (best, n)]
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~hit)])[bounds].astype(np.int32)), pa.array(flat[~hit], pa.int64()))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in others), *map(pa.array, sums), left], names)

    fields = [*(rows.schema[c] for c in others), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("__rare", T.ArrayType(T.LongType()))]
    found = rows.select(*others, "links").mapInArrow(look, T.StructType(fields))
    if len(held) < TOP_PAIRS:  # the table holds all pairs
        return found.drop("__rare")
    return _with_rare(found, counts)


def _with_rare(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the links in __rare to the sums, by a join on the pair; a row's links carry its other columns as its name."""
    others = [c for c in found.columns if c not in ("n_best", "count_sum", "__rare")]
    whole = found.select(*others, "n_best", "count_sum").where(F.size("__rare") == 0)
    rare = found.where(F.size("__rare") > 0).withColumn("__row", F.monotonically_increasing_id())
    links = rare.select("*", F.explode("__rare").alias("pair")).join(counts.select("pair", "n", F.col("best").cast("long").alias("b")), "pair")
    first = [F.first(c).alias(c) for c in others]
    summed = links.groupBy("__row").agg(*first, (F.first("n_best") + F.sum("b")).alias("n_best"), (F.first("count_sum") + F.sum("n")).alias("count_sum"))
    return whole.union(summed.select(*whole.columns))


def digest(groups: Column) -> Column:
    """The SHA-256 of `groups`, empty where it is."""
    return F.when(groups == "", "").otherwise(F.sha2(groups, 256))
