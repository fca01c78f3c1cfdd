"""Packing: token sequences of bounded length with little padding, by shortest-pack-first over the length histogram.

Documents are tokenized in parallel, cut at multiples of the sequence length, and only (id, start, length) rows go on.
The histogram of piece lengths has at most `length` rows whatever the corpus size; it alone comes to the driver, where
packing patterns (how many pieces of which lengths share a sequence, and how often) are counted. Pieces then join the
patterns by their length and rank. Ranks come from windows over (length, one of BUCKETS), so no length is one group;
pieces that fill a sequence, most of those of long texts, need none and are numbered where they are read.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from searchloom.llm._shared import stage
from searchloom.llm._text import LOWER, slices, spans, words

UNITS = 400_000
BUCKETS = 16
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts by a tokenizers file that treats white-space separated words one by one, each distinct word once.

    Words are found by their hash in an open table, all words of a slice at a time. It holds at most UNITS words, or those
    of one slice, and starts anew beyond that; results do not depend on it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores; further threads of each would wait for them
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self, most: int = UNITS):
        size = 1 << int(2 * most).bit_length()
        self.keys, self.units = np.zeros(size, np.uint64), np.full(size, -1, np.int32)  # by place; no unit: free
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.count, self.n = np.zeros(most, np.int64), np.zeros(most, np.int64), 0

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The unit of each key, -1 where it is not known."""
        at = (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)
        unit = self.units[at]
        live = np.flatnonzero((unit >= 0) & (self.keys[at] != keys))
        while len(live):  # the place has another key: on to the next
            at[live] = (at[live] + 1) & (len(self.keys) - 1)
            unit[live] = self.units[at[live]]
            live = live[(unit[live] >= 0) & (self.keys[at[live]] != keys[live])]
        return unit

    def _learn(self, keys: np.ndarray, strings: list[str]):
        """Takes in distinct keys that are not known."""
        for a in range(0, len(strings), 20_000):
            ids = [got.ids for got in self.tokenizer.encode_batch_fast(strings[a : a + 20_000], add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(count.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.begin[self.n : self.n + len(ids)] = self.used + np.cumsum(count) - count
            self.count[self.n : self.n + len(ids)] = count
            own, at, unit = keys[a : a + 20_000], (keys[a : a + 20_000] & np.uint64(len(self.keys) - 1)).astype(np.int64), np.arange(self.n, self.n + len(ids), dtype=np.int32)
            while len(own):
                free = np.flatnonzero(self.units[at] < 0)
                self.keys[at[free]], self.units[at[free]] = own[free], unit[free]  # of several that want a place, the last has it
                out = self.units[at] != unit
                own, at, unit = own[out], (at[out] + 1) & (len(self.keys) - 1), unit[out]
            self.used, self.n = self.used + total, self.n + len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows and each row's bounds in them."""
        starts, ends, bounds = words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        low = LOWER[data]
        angle = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == ord("<"), out=angle[1:])
        for i in np.flatnonzero(angle[ends] > angle[starts]):  # may hold a special token, which is matched before case folding
            low[starts[i] : ends[i]] = data[starts[i] : ends[i]]
        # A word's one closing mark is a token of its own where a letter or digit is before it.
        last, long = low[ends - 1], ends - starts > 1
        one, two = low[np.maximum(ends - 2, 0)], low[np.maximum(ends - 3, 0)]
        plain = ((one >= 97) & (one <= 122)) | ((one >= 48) & (one <= 57)) | ((ends - starts > 2) & (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
        split = long & np.isin(last, np.frombuffer(b",.;:!?", np.uint8)) & plain
        parts = 1 + split.astype(np.int64)
        at = np.cumsum(parts) - parts
        s, e = np.repeat(starts, parts), np.repeat(ends, parts)
        e[at[split]] -= 1
        s[at[split] + 1] = e[at[split]]
        keys = spans(low, s, e)
        unit = self._found(keys)
        miss = np.flatnonzero(unit < 0)
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            if self.n + len(new) > len(self.begin):
                new, first = np.unique(keys, return_index=True)
                self.clear(max(UNITS, len(new)))
                miss = np.arange(len(keys))
            raw, a, b = low.tobytes(), s[miss[first]].tolist(), e[miss[first]].tolist()
            self._learn(new, [raw[i:j].decode() for i, j in zip(a, b, strict=True)])
            unit[miss] = self._found(keys[miss])
        count = self.count[unit]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begin[unit] - total[:-1], count)]
        part_bounds = np.concatenate([at, [len(s)]])
        return ids, total[part_bounds[bounds]]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file; workers serve many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and end_id, cut every `length` ids: (key, start, length, ids_crc32, doc_tokens[, ids array]).

    A null or empty text is its end_id alone. Other input columns are not carried.
    """
    names = [key, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in names[1:5])] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def cut(batches):
        model = encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), 1 << 18):
                ids, bounds = model.encode(data, offsets)
                owners, start, size, crc, tokens, own = [], [], [], [], [], []
                for r in range(hi - lo):
                    mine = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(mine), length):
                        piece = mine[at : at + length]
                        owners.append(lo + r)
                        start.append(at)
                        size.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        tokens.append(len(mine))
                        own.append(piece.astype(np.int32)) if with_ids else None
                columns = [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, tokens))]
                yield pa.record_batch(columns + [pa.array(own, pa.list_(pa.int32()))] * with_ids, names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema)


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (how many sequences, [(piece length, pieces of it in each), ...]) that hold all pieces.

    Lengths are placed longest first, each into the shortest packs that have room, that is those with most room left;
    what finds none opens new packs, filled with as many pieces of that length as fit.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left and (fits := [r for r in room if r >= size]):
            space = max(fits)
            times, pattern = room[space].pop()
            if not room[space]:
                del room[space]
            each = min(space // size, max(1, left // times))
            used = min(times, left // each)
            if used < times:
                room.setdefault(space, []).append((times - used, pattern))
            room.setdefault(space - each * size, []).append((used, [*pattern, (size, each)]))
            left -= used * each
        if left:
            each = max(1, min(length // size, left))
            if left // each:
                room.setdefault(length - each * size, []).append((left // each, [(size, each)]))
            if left % each:
                room.setdefault(length - left % each * size, []).append((1, [(size, left % each)]))
    return [p for r in sorted(room) for p in room[r]]


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows of staged files, numbered from 0 in the order in which they are read, without a shuffle.

    Both reads of the files are cut into the same partitions. What is broadcast has one row for each of them.
    """
    placed = rows.withColumn("__m", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__m", 33))
    sizes = placed.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.expr("__m & 8589934591")).drop("__m", "__part", "__before")


def pack(pieces: DataFrame, length: int, key: str = "doc_id") -> DataFrame:
    """pieces(key, start, length, ...) with sequence_id and offset (long): pieces of a sequence follow without gaps.

    pieces must be a staged table, which gives the same rows each time it is read. Rows may repeat; each is placed
    once. Ties of length go by bucket, key, start and ids_crc32. Empty input gives an empty result. A piece longer than
    `length` is an error.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    if counts and max(counts) > length:
        raise ValueError("a piece is longer than a sequence")
    full = counts.pop(length, 0)
    slots, base, placed = [], 0, dict.fromkeys(counts, 0)
    for times, pattern in pack_histogram(counts, length):
        offset = 0
        for size, each in pattern:
            slots.append((size, placed[size], placed[size] + times * each, each, base, offset))
            placed[size] += times * each
            offset += size * each
        base += times
    # A row for each length of each pattern: some thousands, as each length opens few patterns, however many pieces.
    table = spark.createDataFrame(slots, "length long, lo long, hi long, each long, base long, first long")
    others = [c for c in ("ids_crc32",) if c in pieces.columns]
    bucketed = pieces.where(F.col("length") < length).withColumn("__bucket", F.pmod(F.xxhash64(F.col(key), F.col("start")), F.lit(BUCKETS)).cast("int"))
    before = bucketed.groupBy("length", "__bucket").count()  # at most BUCKETS * length rows, as broadcast below
    before = before.select("length", "__bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("count")).alias("__before"))
    own = Window.partitionBy("length", "__bucket").orderBy(key, "start", *others)
    ranked = bucketed.withColumn("__own", F.row_number().over(own) - 1).join(F.broadcast(before), ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__own"))
    placed_at = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (ranked["__rank"] >= table["lo"]) & (ranked["__rank"] < table["hi"]))
    rank = F.col("__rank") - F.col("lo")
    mixed = placed_at.select(*(ranked[c] for c in pieces.columns), (F.col("base") + F.floor(rank / F.col("each"))).cast("long").alias("sequence_id"), (F.col("first") + F.pmod(rank, F.col("each")) * ranked["length"]).alias("offset"))
    if not full:
        return mixed
    whole = _numbered(pieces.where(F.col("length") == length), "__n")
    return mixed.unionByName(whole.select(*pieces.columns, (F.lit(base) + F.col("__n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs docs: one row per piece, with its sequence_id and offset in it."""
    return pack(stage(token_pieces(docs, tokenizer, length, end_id, key, text, with_ids), "pieces"), length, key)


def sequences(packed: DataFrame, length: int, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences of packed pieces that carry ids, padded to `length`.

    A sequence whose token count is a power of two is left at that count.
    """
    ordered = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["ids"]))
    exact = F.expr("n_tokens & (n_tokens - 1)") == 0
    return ordered.select("sequence_id", "n_tokens", F.when(exact, flat).otherwise(F.concat(flat, F.array_repeat(F.lit(pad_id), F.lit(length) - F.col("n_tokens").cast("int")))).alias("ids"))
