"""SentencePiece encoding and decoding with a BPE model, by suffix-array matching.

A task cuts a slice of its batch into units (a run of blanks and what follows it up to the next one; pieces never
reach beyond one) and encodes each distinct unit once. The units are concatenated and indexed by a suffix array; a
binary search of every piece gives its range of occurrences; the occurrences are edges of a lattice, sorted by end
position and relaxed from left to right. A piece may follow the best path to its start if byte-pair merging would
keep the boundary between the two, which makes one path per position and the same ids as merging.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from searchloom.llm._text import slices, spans

BLANK = "▁"
UNITS = 200_000  # encoded units that a worker keeps
PAIRS = 1 << 20  # pairs of pieces whose boundary it has judged
BATCH = 20_000  # units matched at once
OTHER = 0xFFFF  # the code of characters in no piece
_models: dict[tuple[type, str], Spelling] = {}


class Spelling:
    """The bytes that each id of a SentencePiece BPE model with byte fallback stands for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = np.zeros(256, np.int32)
        spelled = [b""] * (self.size + 1)
        for i in plain:
            spelled[i] = names[i].replace(BLANK, " ").encode()
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][1:-1], 16)] = i
                spelled[i] = bytes([int(names[i][1:-1], 16)])
        self.spelled_size = np.array([len(x) for x in spelled])
        self.spelled_at, self.spelled = np.cumsum(self.spelled_size) - self.spelled_size, np.frombuffer(b"".join(spelled), np.uint8)
        self._read(sp, names, plain)

    def _read(self, sp, names: list[str], plain: list[int]):
        """Other tables of a model, for those that need them."""

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of rows of ids: what encode() was given, but that BLANK comes back as a blank.

        Unknown ids give nothing, and bytes that are no UTF-8 the replacement character.
        """
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        size = self.spelled_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.spelled[np.arange(total[-1]) + np.repeat(self.spelled_at[ids] - total[:-1], size)].tobytes()
        ends = total[bounds].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") if a < b else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]


class PieceModel(Spelling):
    """The tables that encoding needs as well, and a bounded cache of encoded units."""

    def _read(self, sp, names: list[str], plain: list[int]):
        self.ids = {names[i]: i for i in plain}
        self.pieces = sorted((names[i] for i in plain), key=len)
        self.longest = max(map(len, self.pieces))
        score = {i: sp.get_score(i) for i in plain}
        order = {i: n for n, i in enumerate(sorted((i for i in plain if len(names[i]) > 1), key=lambda i: -score[i]))}
        self.rank = np.full(self.size, -1, np.int64)
        for i, n in order.items():
            self.rank[i] = n
        self.never = len(order) + 1
        pairs = {}
        for name in self.pieces:
            for cut in range(1, len(name)):
                a, b = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = self.ids[name]
        merges = {k: order[v] for k, v in pairs.items()}
        parents = {self.ids[name]: self._last_merge(name, merges) for name in self.pieces if len(name) > 1}
        self.right, self.right_until = self._spine(plain, parents, 1)
        self.left, self.left_until = self._spine(plain, parents, 0)
        keys = np.array([a * self.size + b for a, b in merges], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[by], np.array(list(merges.values()), np.int64)[by]
        letters = sorted(set("".join(self.pieces)))
        self.code_of = np.full(0x110000, OTHER, np.uint16)
        self.code_of[[0, *map(ord, letters)]] = np.arange(len(letters) + 1)
        self.codes = np.zeros((len(self.pieces), max(16, 1 << (self.longest - 1).bit_length())), np.uint16)
        for n, name in enumerate(self.pieces):
            self.codes[n, : len(name)] = self.code_of[[ord(c) for c in name]]
        self.lengths = np.array([len(p) for p in self.pieces], np.int32)
        self.piece_ids = np.array([self.ids[p] for p in self.pieces], np.int32)
        self.seen, self.kept = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.clear()

    def clear(self):
        self.units: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint16 if self.size <= 1 << 16 else np.uint32), 0
        self.begin, self.count = np.zeros(UNITS + 1, np.int64), np.zeros(UNITS + 1, np.int32)

    def _remember(self, keys: list[int], ids: np.ndarray, bounds: np.ndarray):
        n, m = len(self.units), len(self.units) + len(keys)
        if m > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros(m, x.dtype)]) for x in (self.begin, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.flat.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n:m], self.count[n:m] = self.used + bounds[:-1], np.diff(bounds)
        self.units.update(zip(keys, range(n, m), strict=True))
        self.used += len(ids)

    def _last_merge(self, name, merges):
        """The two parts that byte-pair merging joins last to make this piece, or None if it never makes it."""
        parts = [self.ids.get(c) for c in name]
        if None in parts:
            return None
        while len(parts) > 1:
            best = min(((merges.get((a, b), self.never), n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == self.never:
                return None
            n = best[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            a, b = parts[n : n + 2]
            parts[n : n + 2] = [self.by_rank(best[0])]
        return None

    def by_rank(self, rank):
        if not hasattr(self, "_by_rank"):
            self._by_rank = {int(r): i for i, r in enumerate(self.rank) if r >= 0}
        return self._by_rank[rank]

    def _spine(self, plain, parents, side):
        """Per piece, the parts that stand at its outer end while it grows, and the rank at which each is merged."""
        rows = {}
        for i in plain:
            row, until = [(i, self.never)], i
            while parents.get(until):
                part = parents[until][side]
                row.append((part, int(self.rank[until])))
                until = part
            rows[i] = row
        depth = max(map(len, rows.values()))
        part, until = np.full((self.size, depth), -1, np.int32), np.zeros((self.size, depth), np.int32)
        for i, row in rows.items():
            for d, (p, u) in enumerate(row):
                part[i, d], until[i, d] = p, u
        self.unmade = getattr(self, "unmade", np.zeros(self.size, bool))
        for i in plain:
            if self.rank[i] >= 0 and not parents.get(i):
                self.unmade[i] = True
        return part, until

    def keeps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps the boundary between pieces a and b; always so next to an unknown character (-1)."""
        out = np.ones(len(a), bool)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo].astype(np.int64) * self.size + b[todo]
        slot = ((key * 0x9E3779B1) >> 12) & (PAIRS - 1)  # answers are kept in a table of fixed size; a later pair takes the place of an earlier one
        found, new = self.kept[slot], np.flatnonzero(self.seen[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            found[new] = self._keeps(pairs // self.size, pairs % self.size)[back]
            self.seen[slot[new]], self.kept[slot[new]] = key[new], found[new]
        out[todo] = found
        return out

    def _keeps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for d in range(self.right.shape[1]):
            for e in range(self.left.shape[1]):
                p, q = self.right[x, d], self.left[y, e]
                some = np.flatnonzero((p >= 0) & (q >= 0) & ok)
                if not len(some):
                    continue
                pair = p[some].astype(np.int64) * self.size + q[some]
                at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
                hit = self.pair_keys[at] == pair
                some, at = some[hit], at[hit]
                when = np.maximum(np.maximum(self.pair_ranks[at], self.rank[p[some]]), self.rank[q[some]])
                ok[some[(when < self.right_until[x[some], d]) & (when <= self.left_until[y[some], e])]] = False
        return ok

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, in which blanks are BLANK, and each unit's bounds in them."""
        sizes = np.array([len(u) for u in units])
        base = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le"), np.uint32)
        start, which = self._occurrences(text)
        piece, size = self.piece_ids[which], self.lengths[which]
        fine = ~self.unmade[piece]
        start, piece, size = start[fine], piece[fine], size[fine]
        known = np.zeros(len(text) + 1, bool)
        known[start[size == 1]] = True
        strange = np.flatnonzero(~known[: len(text)] & (text != 0)).astype(np.int32)  # no piece of their own: spelled as bytes
        start, piece, size = np.concatenate([start, strange]), np.concatenate([piece, np.full(len(strange), -1, np.int32)]), np.concatenate([size, np.ones(len(strange), np.int32)])
        end = start + size
        longest = int(sizes.max(initial=0)) + 1
        place = end - np.repeat(base, sizes + 1)[start]
        place = place.astype(np.uint16 if longest < 1 << 16 else np.int32)  # numpy sorts short integers by radix
        order = np.argsort(place, kind="stable")
        start, piece, end = start[order], piece[order], end[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=longest))])[1 : longest + 1]
        last = np.full(len(text) + 1, -2, np.int32)  # the piece that ends a path here; -2 none yet
        came = np.zeros(len(text) + 1, np.int32)
        is_base = np.zeros(len(text) + 1, bool)
        is_base[base] = True
        for a, b in pairwise(cuts):
            s, p, e = start[a:b], piece[a:b], end[a:b]
            fresh = is_base[s]
            open_ = fresh | (last[s] != -2)
            s, p, e, fresh = s[open_], p[open_], e[open_], fresh[open_]
            good = fresh | self.keeps(np.where(fresh, -1, last[s]), p)
            last[e[good]], came[e[good]] = p[good], s[good]
        # Back from every unit's end at once: one column of ids a step.
        at, steps, left = base + sizes, [], np.flatnonzero(sizes)
        while len(left):
            steps.append((left, last[at[left]], at[left]))
            at[left] = came[at[left]]
            left = left[at[left] > base[left]]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(units) + 1, np.int64)
        owner, ids, stop = (np.concatenate([s[i] for s in reversed(steps)]) for i in range(3))
        order = np.argsort(owner.astype(np.uint16 if len(units) < 1 << 16 else np.int64), kind="stable")
        owner, ids, stop = owner[order], ids[order], stop[order]
        times = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids == -1)
        if len(unknown):  # unknown characters are spelled as bytes
            spelled = [chr(c).encode() for c in text[stop[unknown] - 1].tolist()]
            times[unknown] = [len(b) for b in spelled]
            ids = np.repeat(ids, times)
            ids[ids == -1] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=times, minlength=len(units)).astype(np.int64))])
        return ids, bounds

    def _occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces occur in the text, and which: the range of each in the suffix array, found by binary search.

        Suffixes are ranked by a word of their first characters, then by pairs of ranks until a piece's length is
        covered; a piece's range of ranks follows from those of its parts at every step.
        """
        codes, n = self.code_of[text], len(text)
        present = np.zeros(OTHER + 1, bool)
        present[codes] = True
        some = np.flatnonzero(present[self.codes].all(1))  # pieces of characters that occur; 0 pads pieces and ends units
        used = np.flatnonzero(present[:OTHER])
        bits, top = (8, 0xFF) if len(used) < 0xFF else (16, OTHER)
        short = np.full(OTHER + 1, top, np.uint64)
        short[used] = np.arange(len(used))
        width = 64 // bits

        def word(columns):
            out = np.zeros(columns[0].shape, np.uint64)
            for c in columns:
                out = out << np.uint64(bits) | c
            return out

        padded = np.concatenate([short[codes], np.zeros(width, np.uint64)])
        keys, rank = np.unique(word([padded[i : i + n] for i in range(width)]), return_inverse=True)
        chars, inside = short[self.codes[some]], np.arange(self.codes.shape[1]) < self.lengths[some, None]
        ends = np.where(inside, chars, np.uint64(top))
        low = np.searchsorted(keys, word([chars[:, i::width] for i in range(width)]))
        high = np.searchsorted(keys, word([ends[:, i::width] for i in range(width)]), "right")
        filled, reach = inside[:, ::width], width
        while True:
            following = np.zeros(n, np.int64)
            following[:-reach] = rank[reach:] + 1
            step = len(keys) + 1
            pairs = rank * step + following
            first, more = low[:, ::2] * step, filled[:, 1::2]
            from_ = np.where(more, first + low[:, 1::2] + 1, first)
            to = np.where(more, np.where(high[:, ::2] > low[:, ::2], first + high[:, 1::2] + 1, from_), high[:, ::2] * step)
            if low.shape[1] == 2:
                break
            keys, rank = np.unique(pairs, return_inverse=True)
            low, high, filled, reach = np.searchsorted(keys, from_), np.searchsorted(keys, to), filled[:, ::2], reach * 2
        suffixes = np.argsort(pairs)
        pairs = pairs[suffixes]
        low, high = np.searchsorted(pairs, from_[:, 0]), np.searchsorted(pairs, to[:, 0])
        count = high - low
        at = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        return suffixes[at].astype(np.int32), np.repeat(some, count)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of UTF-8 bytes and each row's bounds in them."""
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[full], 32)  # the blank that stands before every text
        extra = np.zeros(len(offsets), np.int64)
        extra[1:] = np.cumsum(np.diff(offsets) > 0)
        offsets = offsets + extra
        blank, line = data == 32, data == 10
        begin = line.copy()
        begin[1:] |= (blank[1:] & ~blank[:-1]) | line[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        keys, back = np.unique(spans(data, starts, ends), return_inverse=True)
        first = np.zeros(len(keys), np.int64)
        first[back] = np.arange(len(back))
        known = keys.tolist()
        new = [i for i, k in enumerate(known) if k not in self.units]
        if len(self.units) + len(new) > UNITS:
            self.clear()
            new = range(len(known))
        raw = data.tobytes()
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            self._remember([known[i] for i in part], *self.encode_units([raw[a:b].decode().replace(" ", BLANK) for a, b in zip(starts[first[part]].tolist(), ends[first[part]].tolist(), strict=True)]))
        unit = np.fromiter((self.units[k] for k in known), np.int64, len(known))[back]
        count = self.count[unit]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begin[unit] - total[:-1], count)]
        return ids.astype(np.int32), total[np.searchsorted(starts, offsets)]


def model(path: str, kind: type = PieceModel):
    """The worker's model of this kind for this file; workers serve many tasks."""
    if (kind, path) not in _models:
        _models[kind, path] = kind(path)
    return _models[kind, path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array<int> column of ids, as the model's own encoder gives them; empty for a null or empty text.

    A column of that name is replaced. Empty input gives an empty result.
    """
    docs = docs.drop(ids)
    at, names = docs.columns.index(text), [*docs.columns, ids]

    def run(batches):
        pieces = model(path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(at), 1 << 19):
                flat, bounds = pieces.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                yield pa.record_batch([*(c.slice(lo, hi - lo) for c in batch.columns), lists], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give an empty text. A column of that name is replaced."""
    rows = rows.drop(text)
    at, names = rows.columns.index(ids), [*rows.columns, text]

    def run(batches):
        spelling = model(path, Spelling)
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(lo, 500)
                lists = part.column(at)
                bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
                texts = spelling.decode(np.asarray(lists.flatten()), bounds)
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))
