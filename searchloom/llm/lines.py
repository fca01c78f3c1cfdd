"""Line dedup: all distinct lines are indexed by sharded minimal perfect hashes, and documents probe the counts.

1. Every task hashes the distinct lines of its documents to 128 bits and counts documents per hash; Spark adds up.
2. All distinct lines go to shards by hash, as many as their number asks for. A task per shard builds a minimal
   perfect hash over them (levels of bits with ranks) and, at each slot, a compact fingerprint and a count.
3. Documents probe these arrays and drop lines whose count is large enough; no lines are joined. While all shards
   together are under BROADCAST_BYTES they are broadcast. Beyond that, the index of the HEAVY most common lines, which
   has a bounded size, is broadcast and probed in place, and the other hashes are dealt to their shards in blocks and
   probed there; only hits return to their documents.
Lines are told apart by the XXH3 hash of their key in 128 bits.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm._shared import Scratch
from searchloom.llm._text import LOWER, SPACE, mix, slices

BROADCAST_BYTES = 16 << 20
SHARD_LINES = 1 << 20
HEAVY = 50_000


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """(row, start, end, key start, key end) of the lines of all rows; an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    every = np.arange(len(offsets) - 1)
    rows = np.concatenate([every, owner])
    order = np.lexsort((np.concatenate([offsets[:-1], breaks + 1]), rows))
    starts = np.concatenate([offsets[:-1], breaks + 1])[order]
    ends = np.concatenate([breaks, offsets[1:]])
    ends = ends[np.lexsort((ends, np.concatenate([owner, every])))]
    solid = np.flatnonzero(~SPACE[data])
    left, right = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = left < right
    first, last = starts.copy(), starts.copy()
    first[some], last[some] = solid[left[some]], solid[right[some] - 1] + 1
    return rows[order], starts, ends, first, last


def _keys(data, offsets, min_chars):
    """line_spans and each line's 128-bit key hash as two columns, both 0 where its key has fewer than min_chars code points."""
    rows, starts, ends, first, last = line_spans(data, offsets)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    keys = np.zeros((len(rows), 2), np.uint64)
    some = np.flatnonzero(chars[last] - chars[first] >= max(1, min_chars))
    raw, digest = LOWER[data].tobytes(), xxhash.xxh3_128_digest
    keys[some] = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return rows, starts, ends, keys


def _per_row(rows, keys):
    """The distinct (row, key) pairs of lines that have a key."""
    some = keys.any(1)
    rows, keys = rows[some], keys[some]
    order = np.lexsort((keys[:, 1], keys[:, 0], rows))
    rows, keys = rows[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]).any(1) | (rows[1:] != rows[:-1])
    return rows[fresh], keys[fresh]


def line_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(hi, lo, n): how many rows have a line with this key; hi and lo hash the stripped, lowered line."""

    def count(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                rows, _, _, keys = _keys(data, offsets, min_chars)
                keys = _per_row(rows, keys)[1]
                keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
                head = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)
                keys, n = keys[head].view(np.int64), np.diff(np.append(head, len(keys)))
                yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), n], ["hi", "lo", "n"])

    return docs.select(F.col(text)).mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


class LineIndex:
    """A minimal perfect hash over distinct 128-bit keys, with a 32-bit fingerprint and a count at each slot.

    Counts stop at 65,535, or at 2^32 - 1 where min_docs is larger. `whole` keeps whole keys in place of fingerprints,
    for an index that is asked for keys which it may not hold.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, min_docs: int = 1, whole: bool = False):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, taken = keys, 0
        while len(left):
            size = max(64, (int(len(left) * 1.3) + 63) // 64 * 64)
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = np.zeros(size // 64 + 1, np.int64)
            np.cumsum(alone.reshape(-1, 64).sum(1), out=ranks[1:])
            self.levels.append((size, np.packbits(alone), (ranks[:-1] + taken).astype(np.uint32)))
            taken += int(ranks[-1])
            left = left[~alone[at]]
        slots = self._slots(keys)
        kind = np.uint16 if min_docs < 1 << 16 else np.uint32
        self.whole, self.counts = whole, np.zeros(len(keys), kind)
        self.prints = np.zeros((len(keys), 2), np.uint64) if whole else np.zeros(len(keys), np.uint32)
        self.prints[slots] = self._print(keys)
        self.counts[slots] = np.minimum(counts, np.iinfo(kind).max)

    @staticmethod
    def _at(keys, level, size):
        with np.errstate(over="ignore"):
            return (mix(keys[:, 0] + mix(keys[:, 1] + np.uint64((level + 1) * 0x632BE59BD9B4E019 % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    def _print(self, keys):
        return keys if self.whole else (keys[:, 1] >> np.uint64(32)).astype(np.uint32)

    def _slots(self, keys):
        """Each key's slot; -1 for some keys that are not indexed."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self._at(keys[left], level, size)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            mine = at[hit]
            if len(mine):
                block = np.unpackbits(bits.reshape(-1, 8)[mine >> 6], axis=1)
                before = np.arange(64)[None, :] < (mine & 63)[:, None]
                out[left[hit]] = ranks[mine >> 6] + (block * before).sum(1)
            left = left[~hit]
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Each key's count; 0 for keys that are not indexed, but for one in 2^32 of them where fingerprints are kept."""
        out = np.zeros(len(keys), np.int64)
        slots = self._slots(keys)
        found = np.flatnonzero(slots >= 0)
        if len(found):
            same = self.prints[slots[found]] == self._print(keys[found])
            found = found[same.all(1) if self.whole else same]
            out[found] = self.counts[slots[found]]
        return out


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (np.ascontiguousarray(keys[:, 0]).view(np.int64) % shards).astype(np.int32)


def build_index(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """(shard, index): each shard's pickled LineIndex over all its lines, with their counts."""

    def build(batches):
        held, now = [], None

        def out():
            hi, lo, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            index = LineIndex(np.stack([hi, lo], 1).view(np.uint64), n, min_docs)
            held.clear()
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([pickle.dumps(index)], pa.binary())], ["shard", "index"])

        for batch in batches:  # sorted by shard: one is held at a time
            shard, hi, lo, n = (np.asarray(c) for c in batch.columns)
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True) if len(shard) else ():
                if held and shard[a] != now:
                    yield from out()
                now = int(shard[a])
                held.append((hi[a:b], lo[a:b], n[a:b]))
        if held:
            yield from out()

    placed = counts.select(F.pmod(F.col("hi"), F.lit(shards)).cast("int").alias("shard"), "hi", "lo", "n")
    return placed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, index binary")


def _edit(batch: pa.RecordBatch, at: int, min_chars: int, doomed) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The text column without doomed lines, lines before, lines dropped. doomed(first row, rows, keys) -> bool array."""
    column = batch.column(at)
    out, before, gone = [], [], []
    for lo, hi, data, offsets in slices(column):
        rows, starts, ends, keys = _keys(data, offsets, min_chars)
        drop = np.zeros(len(keys), bool)
        some = np.flatnonzero(keys.any(1))
        drop[some] = doomed(lo, rows[some], keys[some])
        lines = np.bincount(rows, minlength=hi - lo)
        lost = np.bincount(rows[drop], minlength=hi - lo)
        texts = column.slice(lo, hi - lo)
        if lost.any():
            texts, bounds = texts.to_pylist(), np.searchsorted(rows, np.arange(hi - lo + 1))
            raw = data.tobytes()
            for r in np.flatnonzero(lost):
                a, b = bounds[r], bounds[r + 1]
                keep = np.flatnonzero(~drop[a:b]) + a
                texts[r] = b"\n".join(raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)).decode()
            texts = pa.array(texts, pa.string())
        out.append(texts.cast(pa.string()))
        before.append(lines)
        gone.append(lost)
    if not out:
        return column.cast(pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return pa.concat_arrays(out), np.concatenate(before), np.concatenate(gone)


def drop_frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the lines whose key is found in at least min_docs rows, with n_lines and n_dropped (long) added.

    A line's key is the line with ASCII white space stripped at both ends and A-Z lowered; keys of fewer than
    min_chars (1 at least) code points stay. Every row counts as a document, repeated rows too; a null text counts
    as one empty line and stays null; an empty table gives an empty result. Input columns named n_lines or
    n_dropped are replaced. `key` names the row's id and need not be unique or non-null.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    counts = scratch.stage(line_counts(docs, text, min_chars), "line-counts")
    distinct, total = counts.agg(F.count("*"), F.sum("n")).first()
    shards = max(1, -(-distinct // SHARD_LINES))
    index = scratch.stage(build_index(counts, min_docs, shards), "line-index")
    fields = [*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    schema, at, names = T.StructType(fields), docs.columns.index(text), docs.columns

    def rebuilt(batch, doomed, width):
        texts, before, gone = _edit(batch, at, min_chars, doomed)
        columns = [texts if i == at else batch.column(i) for i in range(width)]
        return pa.record_batch([*columns, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    if (index.agg(F.sum(F.octet_length("index"))).first()[0] or 0) <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r[0]: r[1] for r in index.collect()})
        scratch.close()

        def probe(batches):
            loaded = {s: pickle.loads(x) for s, x in held.value.items()}

            def doomed(_, rows, keys):
                out, shard = np.zeros(len(keys), bool), _shard(keys, shards)
                for s, x in loaded.items():
                    mine = np.flatnonzero(shard == s)
                    out[mine] = x.count(keys[mine]) >= min_docs
                return out

            for batch in batches:
                yield rebuilt(batch, doomed, len(names))

        return docs.mapInArrow(probe, schema)

    # No more than HEAVY keys are in so many rows, whatever their number: the sum of all counts is `total`.
    common = counts.where(F.col("n") >= max(min_docs, -(-total // HEAVY))).toPandas()
    heavy = spark.sparkContext.broadcast(LineIndex(np.ascontiguousarray(common[["hi", "lo"]].to_numpy(np.int64)).view(np.uint64), common["n"].to_numpy(), min_docs, whole=True))

    def ask(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.string()))
            for lo, _, data, offsets in slices(batch.column(1)):
                rows, _, _, keys = _keys(data, offsets, min_chars)
                rows, keys = _per_row(rows, keys)
                rare = heavy.value.count(keys) == 0
                rows, keys = rows[rare], keys[rare]
                shard = _shard(keys, shards)
                for s in np.unique(shard):
                    mine = shard == s
                    owners, local = np.unique(rows[mine], return_inverse=True)
                    yield pa.record_batch([pa.array([s], pa.int32()), pa.array([None], pa.binary()), pa.array([ids[lo + owners].tolist()], pa.list_(pa.string())), pa.array([local.astype(np.uint16).tobytes()], pa.binary()), pa.array([keys[mine].tobytes()], pa.binary())], ["shard", "index", "ids", "owners", "keys"])

    def answer(batches):
        shard = loaded = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["index"] is not None:
                    shard, loaded = row["shard"], pickle.loads(row["index"])
                elif row["shard"] == shard:
                    keys, owners = np.frombuffer(row["keys"], np.uint64).reshape(-1, 2), np.frombuffer(row["owners"], np.uint16)
                    hit = loaded.count(keys) >= min_docs
                    if hit.any():
                        yield pa.record_batch([pa.array([row["ids"][o] for o in owners[hit]], pa.string()), pa.array(keys[hit].view(np.int64)[:, 0]), pa.array(keys[hit].view(np.int64)[:, 1])], ["id", "hi", "lo"])

    asked = docs.select(F.col(key), F.col(text)).mapInArrow(ask, "shard int, index binary, ids array<string>, owners binary, keys binary")
    both = asked.unionByName(index, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("shard", F.col("index").isNull())
    hits = both.mapInArrow(answer, "id string, hi long, lo long").groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.struct("hi", "lo")).alias("__keys"))
    hits = scratch.stage(hits, "line-hits")
    scratch.close("line-hits")
    joined = docs.join(hits, docs[key].cast("string").eqNullSafe(hits["__id"]), "left").drop("__id")

    def drop(batches):
        for batch in batches:
            lists = batch.column(len(names))
            lens, flat = np.asarray(lists.value_lengths().fill_null(0)), lists.flatten()
            own, bounds = np.stack([np.asarray(flat.field(i)) for i in range(2)], 1).view(np.uint64), np.concatenate([[0], np.cumsum(lens)])

            def doomed(lo, rows, keys, own=own, bounds=bounds):
                out = heavy.value.count(keys) >= min_docs
                cuts = np.searchsorted(rows, np.arange(rows[-1] + 2)) if len(rows) else [0]
                for r in range(len(cuts) - 1):
                    mine = own[bounds[lo + r] : bounds[lo + r + 1]]
                    if len(mine):
                        part = keys[cuts[r] : cuts[r + 1]]
                        found = np.flatnonzero(np.isin(part[:, 0], mine[:, 0]))
                        listed = set(map(tuple, mine.tolist()))
                        out[cuts[r] + found] |= [tuple(k) in listed for k in part[found].tolist()]
                return out

            yield rebuilt(batch, doomed, len(names))

    return joined.mapInArrow(drop, schema)
