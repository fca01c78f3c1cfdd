"""Substring dedup: word windows that also start earlier in the corpus are found by phrase automata and removed.

1. Every window of `window` words has an anchor: the 8-word phrase of smallest hash in it. Equal windows have equal
   anchors. Anchors go to shards by hash, and rows learn which of theirs recur. Nothing else of a unique text moves.
2. A task compiles the recurring phrases of a slice of documents into an Aho-Corasick automaton (pyahocorasick, one
   symbol a word) and streams the documents of the slice through it. Its hits are where phrases occur; windows around
   hits are compared word by word, and all but the first, by document and position, are to be removed. First ones are
   cut out as passages of at most 13 windows and go on to the shard of their anchor.
3. A shard does the same with the passages that meet there: their phrases make its automaton, and all of its passages
   are streamed through it.
Automata are thus sharded by slice first and by anchor then; a document meets those that hold its recurring phrases.
Words are told apart by 128 bits of hash.
"""

from __future__ import annotations

from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm._shared import spread, text_bytes
from searchloom.llm._text import grams, inside, mix, slices, spans, utf8, words

WINDOW, PHRASE = 20, 8
LAST = (1 << 63) - 1
SYMBOLS = 1_000_000  # different words of one automaton
HELD_BYTES = 24 << 20  # postings that a task holds before it combines them
COMMON = 100_000  # common windows that a task remembers having sent on


def _heads(*columns) -> np.ndarray:
    """Where a run of equal values begins, for sorted columns."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _windows(data, offsets, window):
    """(word starts, word ends, word bounds of rows, window starts, their rows, window, anchor, phrase and word hashes)."""
    starts, ends, bounds = words(data, offsets)
    h = spans(data, starts, ends)
    at, rows = inside(bounds, window)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return starts, ends, bounds, at, rows, none, none, none, h
    phrases = grams(h, PHRASE)
    low, width, span = phrases, 1, window - PHRASE + 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return starts, ends, bounds, at, rows, grams(h, window)[at], low[at], phrases, h


def _anchors(data, offsets, window):
    """(row, anchor, occurrences in the row), without repeats."""
    _, _, _, at, rows, _, anchors, phrases, _ = _windows(data, offsets, window)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = np.flatnonzero(_heads(anchors, rows))
    length = np.diff(np.append(head, len(at)))
    first, value, row = at[head], anchors[head], rows[head]
    last, seen = first + length - 1 + window - PHRASE, np.zeros(len(head), np.int64)
    j = 0
    while (more := np.flatnonzero(first + j <= last)).size:  # most runs have a window's width at most
        seen[more] += phrases[first[more] + j] == value[more]
        j += 1
        if j > 2 * window:
            seen[first + j <= last] = 2  # a longer run holds its anchor more than once
            break
    order = np.lexsort((row, value))
    row, value, seen = row[order], value[order], seen[order]
    head = _heads(row, value)
    return row[head], value[head], np.add.reduceat(seen, np.flatnonzero(head))


def _ids(column: pa.Array) -> np.ndarray:
    """Row ids as int64; nulls come after all others."""
    return np.asarray(column.cast(pa.int64()).fill_null(LAST))


def _with_id(docs: DataFrame, key: str) -> DataFrame:
    return docs.withColumn("__id", F.coalesce(F.col(key).cast("long"), F.lit(LAST)))


def recurring_anchors(docs: DataFrame, key: str, text: str, window: int, shards: int) -> DataFrame:
    """(__id, anchor): the anchors of each row that occur at two or more places of the corpus."""
    names = ["shard", "known", "ids", "owners", "anchors", "often"]

    def block(shard, known, ids, owners, anchors, often):
        kinds = pa.int32(), pa.bool_(), *(pa.binary(),) * 4
        return pa.record_batch([pa.array([x if i < 2 else x.tobytes()], k) for i, (x, k) in enumerate(zip((shard, known, ids, owners, anchors, often), kinds, strict=True))], names)

    def post(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            for lo, _, data, offsets in slices(batch.column(1)):
                rows, values, seen = _anchors(data, offsets, window)
                if not len(values):
                    continue
                head = _heads(values)
                group = np.cumsum(head) - 1
                often = np.add.reduceat(seen, np.flatnonzero(head)) > 1
                # Rows whose anchor meets another in this slice know that it recurs; one posting tells the shard so.
                kinds = [(False, np.flatnonzero(head)), (True, np.flatnonzero(~head))]
                for known, some in kinds:
                    shard = (values[some] >> np.uint64(40)) % np.uint64(shards) if not known else (values[some] ^ rows[some].astype(np.uint64)) % np.uint64(shards)
                    order = np.argsort(shard, kind="stable")
                    cuts = np.flatnonzero(_heads(shard[order]))
                    for a, b in pairwise([*cuts, len(some)]):
                        part = some[order[a:b]]
                        mine, local = np.unique(rows[part], return_inverse=True)
                        yield block(int(shard[order[a]]), known, ids[lo + mine], local.astype(np.uint16), values[part], often[group[part]].astype(np.uint8))

    def meet(batches):
        now, held = None, []

        def out(ids, anchors):
            for a in range(0, len(ids), 50_000):
                yield pa.record_batch([pa.array(ids[a : a + 50_000]), pa.array(anchors[a : a + 50_000].view(np.int64))], ["__id", "anchor"])

        def matched(last):
            ids, anchors, often = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            order = np.argsort(anchors)
            ids, anchors, often = ids[order], anchors[order], often[order]
            head = np.flatnonzero(_heads(anchors))
            size = np.diff(np.append(head, len(anchors)))
            many = (size > 1) | (np.maximum.reduceat(often, head) > 0)
            again = np.repeat(many, size)
            yield from out(ids[again], anchors[again])
            if not last:  # one posting of each anchor stays
                held.append((ids[head], anchors[head], many.astype(np.uint8)))

        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if held:
                        yield from matched(True)
                    now, size = row["shard"], 0
                ids = np.frombuffer(row["ids"], np.int64)[np.frombuffer(row["owners"], np.uint16)]
                anchors = np.frombuffer(row["anchors"], np.uint64)
                if row["known"]:
                    yield from out(ids, anchors)
                elif len(ids):
                    held.append((ids, anchors, np.frombuffer(row["often"], np.uint8)))
                    size += 17 * len(ids)
                    if size > HELD_BYTES:
                        yield from matched(False)
                        size = 17 * len(held[0][0]) // 2
        if held:
            yield from matched(True)

    blocks = docs.select(key, text).mapInArrow(post, "shard int, known boolean, ids binary, owners binary, anchors binary, often binary")
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(meet, "__id long, anchor long")


def _runs(ids, at, window):
    """(id, first word, end word) of the words that windows at sorted (id, position) cover."""
    head = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + window)])) if len(ids) else np.zeros(0, int)
    last = np.append(head[1:], len(ids)) - 1 if len(head) else head
    return ids[head], at[head], at[last] + window


class Passages:
    """Texts with the row and the word position they start at, their words and the windows in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, places: np.ndarray, window: int):
        self.window = window
        self.starts, self.ends, self.bounds, self.at, self.owner, self.hashes, self.anchors, self.phrases, h = _windows(data, offsets, window)
        self.words = h, spans(data, self.starts, self.ends, 1)
        self.who, self.place = ids[self.owner], places[self.owner] + self.at - self.bounds[self.owner]

    def recurring(self, some: np.ndarray) -> np.ndarray:
        """A word position of each phrase that is the anchor of windows in `some` and stands at two or more places: the
        phrases to compile."""
        # Where a window's anchor stands: the first word of its phrase of smallest hash.
        span = np.arange(self.window - PHRASE + 1)
        spot = np.zeros(len(some), np.int64)
        for a in range(0, len(some), 50_000):
            at = self.at[some[a : a + 50_000]]
            spot[a : a + 50_000] = at + np.argmin(self.phrases[at[:, None] + span], 1)
        anchors = self.anchors[some]
        order = np.lexsort((spot, anchors))
        anchors, spot = anchors[order], spot[order]
        fresh = _heads(anchors, spot)
        anchors, spot = anchors[fresh], spot[fresh]
        head = np.flatnonzero(_heads(anchors))
        size = np.diff(np.append(head, len(anchors)))
        spot = spot[np.repeat(size > 1, size)]
        # Phrases of one hash that are unlike are compiled each.
        names = np.stack([grams(h, PHRASE)[spot] for h in self.words], 1) if len(spot) else np.zeros((0, 2), np.uint64)
        order = np.lexsort((spot, names[:, 1], names[:, 0]))
        return spot[order][_heads(names[order, 0], names[order, 1])]

    def occurrences(self, patterns: np.ndarray):
        """Word positions at which one of the phrases at `patterns` starts: the hits of automata over all passages."""
        symbols = np.unique(self.words[0][(patterns[:, None] + np.arange(PHRASE)).ravel()]) if len(patterns) else np.zeros(0, np.uint64)
        found = [np.zeros(0, np.int64)]
        while len(patterns):
            # As many phrases as their words leave symbols for; words of no phrase are symbol 1, passages end with 0.
            count = len(patterns) if len(symbols) <= SYMBOLS else max(1, SYMBOLS // PHRASE)
            part, patterns = patterns[:count], patterns[count:]
            known = np.unique(self.words[0][(part[:, None] + np.arange(PHRASE)).ravel()])
            near = np.minimum(np.searchsorted(known, self.words[0]), len(known) - 1)
            coded = np.where(known[near] == self.words[0], near + 2, 1).astype(np.uint32)
            coded[coded >= 0xD800] += 0x800  # past the surrogates
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in part.tolist():
                automaton.add_word(coded[p : p + PHRASE].tobytes().decode("utf-32-le"))
            automaton.make_automaton()
            for p in range(0, len(self.bounds) - 1, 2000):
                q = min(p + 2000, len(self.bounds) - 1)
                lo, count = self.bounds[p], np.diff(self.bounds[p : q + 1])
                place = np.arange(self.bounds[q] - lo) + np.repeat(np.arange(q - p), count)
                stream = np.zeros(self.bounds[q] - lo + q - p, np.uint32)
                stream[place] = coded[lo : self.bounds[q]]
                stops = np.fromiter((end for end, _ in automaton.iter(stream.tobytes().decode("utf-32-le"))), np.int64)
                found.append(lo + np.searchsorted(place, stops) - PHRASE + 1)
        return np.unique(np.concatenate(found))

    def around(self, hits: np.ndarray) -> np.ndarray:
        """The windows that hold one of these occurrences."""
        total = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(total, hits + 1, 1)
        total = np.cumsum(total)
        return np.flatnonzero(total[self.at + self.window - PHRASE + 1] > total[self.at])

    def settle(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first window of the same words for each of the windows `some`, how many such): equal by every word."""
        order = some[np.lexsort((self.place[some], self.who[some], self.hashes[some]))]
        head = np.flatnonzero(_heads(self.hashes[order]))
        size = np.diff(np.append(head, len(order)))
        lead = np.repeat(order[head], size)
        same = np.ones(len(order), bool)
        for j in range(self.window):
            for h in self.words:
                same &= h[self.at[order] + j] == h[self.at[lead] + j]
        if not same.all():  # unlike windows of one hash: their words decide
            for a, n in zip(head.tolist(), size.tolist(), strict=True):
                if not same[a : a + n].all():
                    seen = {}
                    for i in range(a, a + n):
                        w = self.at[order[i]]
                        lead[i] = seen.setdefault(b"".join(h[w : w + self.window].tobytes() for h in self.words), order[i])
        count = np.zeros(len(self.at), np.int64)
        np.add.at(count, lead, 1)
        first = np.zeros(len(self.at), np.int64)
        first[order] = lead
        return first[some], count[first[some]]

    def later(self, some: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which of the windows `some` start after their first one; the same row and place is no later one."""
        return some[(self.who[some] != self.who[first]) | (self.place[some] != self.place[first])]

    def runs(self, some: np.ndarray):
        """(id, first word, end word) of what windows cover."""
        some = some[np.lexsort((self.place[some], self.who[some]))]
        return _runs(self.who[some], self.place[some], self.window)


def match_passages(ids: np.ndarray, places: np.ndarray, passages: pa.Array, window: int = WINDOW):
    """(id, first word, end word) of spans covered by windows of passages that also start earlier in one of them.

    A passage is a text with the row and the word position it starts at. Occurrences are the hits of the automata.
    """
    data, offsets = utf8(passages)
    held = Passages(data, offsets, ids, places, window)
    patterns = held.recurring(np.arange(len(held.at)))
    some = held.around(held.occurrences(patterns))
    return held.runs(held.later(some, held.settle(some)[0]))


def repeated_spans(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(__id, first, end): spans of words, which may overlap, covered by windows that also start earlier."""
    shards = spread(docs.sparkSession, text_bytes(docs, text))
    marks = recurring_anchors(docs, key, text, window, shards).groupBy("__id").agg(F.collect_set("anchor").alias("__anchors"))
    cased = _with_id(docs, key)  # with all columns, as drop_repeats() has it, so that Spark shuffles the texts once
    text_at, id_at = cased.columns.index(text), cased.columns.index("__id")
    names = ["shard", "ids", "at", "passages", "end"]
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]

    def block(*values):
        return pa.record_batch([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names)

    def cut(batches):
        sent = Sent()
        for batch in batches:
            ids, lists = np.asarray(batch.column(id_at)), batch.column(batch.num_columns - 1)
            lens = np.asarray(lists.value_lengths().fill_null(0))
            owner, flat = np.repeat(np.arange(len(lens)), lens), np.asarray(lists.flatten()).view(np.uint64)
            for lo, hi, data, offsets in slices(batch.column(text_at)):
                held = Passages(data, offsets, ids[lo:hi], np.zeros(hi - lo, np.int64), window)
                mine = (owner >= lo) & (owner < hi)
                salt = lambda r: r.astype(np.uint64) << np.uint64(48)
                marked = np.isin(mix(held.anchors ^ salt(held.owner)), mix(flat[mine] ^ salt(owner[mine] - lo)))
                if not marked.any():
                    continue
                some = held.around(held.occurrences(held.recurring(np.flatnonzero(marked))))
                first, count = held.settle(some)
                gone = held.later(some, first)
                again = sent.sift(held, np.unique(first[count > 1]), np.setdiff1d(np.flatnonzero(marked), some[first != some]))
                a, b, c = held.runs(np.concatenate([gone, again]))
                if len(a):
                    yield block(int(a[0] % shards), a, b, None, c)
                marked[some[first != some]] = False
                marked[again] = False
                go = np.flatnonzero(marked)
                if not len(go):
                    continue
                new = _heads(held.anchors[go], held.owner[go], held.at[go] - np.arange(len(go)))
                nth = np.arange(len(go)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                begin = np.flatnonzero(nth % (window - PHRASE + 1) == 0)
                last = np.append(begin[1:], len(go)) - 1
                shard = ((held.anchors[go[begin]] >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
                left, right = held.starts[held.at[go[begin]]].tolist(), held.ends[held.at[go[last]] + window - 1].tolist()
                raw, place, who = data.tobytes(), held.place[go[begin]], held.who[go[begin]]
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(_heads(shard[order]))
                for a, b in pairwise([*cuts, len(order)]):
                    part = order[a:b]
                    yield block(int(shard[part[0]]), who[part], place[part], [raw[left[i] : right[i]].decode() for i in part], None)

    def locate(batches):
        now, held = None, []

        def settled():
            passages = [p for h in held for p in h[2]]
            found = match_passages(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.array(passages, pa.string()), window)
            held.clear()
            if len(found[0]):
                yield pa.record_batch([pa.array(x, pa.int64()) for x in found], ["__id", "first", "end"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if held:
                        yield from settled()
                    now = row["shard"]
                if row["passages"] is None:
                    yield pa.record_batch([pa.array(row[c], pa.int64()) for c in ("ids", "at", "end")], ["__id", "first", "end"])
                else:
                    held.append((np.array(row["ids"], np.int64), np.array(row["at"], np.int64), row["passages"]))
        if held:
            yield from settled()

    cut_out = cased.join(marks.withColumnRenamed("__id", "__row"), F.col("__id") == F.col("__row")).drop("__row").mapInArrow(cut, "shard int, ids array<long>, at array<int>, passages array<string>, end array<int>")
    return cut_out.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(locate, "__id long, first long, end long")


class Sent:
    """Common windows that a task has sent on: of later ones the shard need not hear. At most COMMON are remembered."""

    def __init__(self):
        self.first: dict[bytes, tuple[int, int]] = {}
        self.keys = np.zeros(0, np.uint64)

    def sift(self, held: Passages, common: np.ndarray, going: np.ndarray) -> np.ndarray:
        """Those of the windows `going` whose words were sent from an earlier row or place; `common` ones are remembered."""
        again = []
        words = lambda i: b"".join(h[held.at[i] : held.at[i] + held.window].tobytes() for h in held.words)
        for i in going[np.isin(held.hashes[going], self.keys)].tolist():
            own, before = (int(held.who[i]), int(held.place[i])), self.first.get(words(i))
            if before is not None and before < own:
                again.append(i)
        if len(self.first) > COMMON:
            self.first, self.keys = {}, self.keys[:0]
        for i in common.tolist():
            own, text = (int(held.who[i]), int(held.place[i])), words(i)
            self.first[text] = min(own, self.first.get(text, own))
        self.keys = np.union1d(self.keys, held.hashes[common])
        return np.array(again, np.int64)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text: words in a window that starts earlier too are left out.

    A window is `window` (PHRASE to 255) consecutive words, runs of characters other than ASCII white space; earlier
    is a smaller key, or the same key and an earlier word. kept_text joins the words that stay by single spaces.
    Windows are judged on the input. Keys are whole numbers; null ones come last and count as one. Rows that repeat
    a key count as one document at the same place, so they do not remove each other. A null text has no words.
    Input columns named n_words, n_removed or kept_text are replaced; empty input gives an empty result.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    gone = repeated_spans(docs, key, text, window).groupBy("__id").agg(F.collect_list(F.struct("first", "end")).alias("__gone"))
    joined = _with_id(docs, key).join(gone.withColumnRenamed("__id", "__row"), F.col("__id") == F.col("__row"), "left").drop("__id", "__row")
    at, names = docs.columns.index(text), [*docs.columns, "n_words", "n_removed", "kept_text"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def rebuild(batches):
        for batch in batches:
            lists = batch.column(len(names) - 3)
            lens, flat = np.asarray(lists.value_lengths().fill_null(0)), lists.flatten()
            first, end = (np.asarray(flat.field(i)) for i in range(2))
            owner = np.repeat(np.arange(len(lens)), lens)
            total, lost, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for lo, hi, data, offsets in slices(batch.column(at)):
                starts, ends, bounds = words(data, offsets)
                mine = np.flatnonzero((owner >= lo) & (owner < hi))
                base = bounds[owner[mine] - lo]
                limit = bounds[owner[mine] - lo + 1]
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, np.minimum(base + first[mine], limit), 1)
                np.add.at(cover, np.minimum(base + end[mine], limit), -1)
                keep = np.cumsum(cover)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])
                total.append(np.diff(bounds))
                lost.append(np.diff(bounds) - np.diff(kept[bounds]))
                # Bytes of kept words stay, and one blank after each but a row's last.
                step = np.zeros(len(data) + 1, np.int64)
                s, e = starts[keep], ends[keep]
                np.add.at(step, s, 1)
                np.add.at(step, e, -1)
                out = np.cumsum(step)[:-1] > 0
                row = np.searchsorted(bounds, np.flatnonzero(keep), "right") - 1
                gap = e[:-1][row[1:] == row[:-1]] if len(e) else e
                data = data.copy()
                data[gap], out[gap] = 32, True
                places = np.concatenate([[0], np.cumsum(out)])[offsets].astype(np.int32)
                texts.append(pa.StringArray.from_buffers(hi - lo, pa.py_buffer(places.tobytes()), pa.py_buffer(data[out].tobytes())))
            texts = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
            yield pa.record_batch([*batch.columns[: len(names) - 3], pa.array(np.concatenate(total)), pa.array(np.concatenate(lost)), texts], names)

    return joined.mapInArrow(rebuild, schema)
