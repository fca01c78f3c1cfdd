"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets, and the groups that its links make.

1. Each text's set of hashed shingles is cut into segments by hash. Two sets of similarity t differ in so few elements
   that, with one segment more than that, some segment is equal in both (pigeonhole), so sets that share no segment
   key need no comparison. Segment keys hold several shingles each: unrelated texts that share a passage or common
   words seldom meet. Keys go to shards in blocks; keys that repeat inside a slice are combined before the shuffle.
2. A set carries a bitmap of the parities of its elements by hash. Two bitmaps differ in no more bits than the sets in
   elements, so a pair whose bitmaps differ too much is no link. First every set of a key is held against one other;
   then the keys that still hold several groups are looked at pair by pair. What is left are pairs that are nearly all
   links, so that the sets which they connect, a block, are about the sets that links will connect.
3. In a block the shingles are ordered globally, most common first, the sets are stored in a prefix tree, and each set
   walks the tree, sharing the overlap of common paths and leaving a subtree when what remains of the set or of the
   subtree cannot reach the required overlap. A task gives a forest of its links, so a group of copies never becomes
   all of its pairs. A block beyond the size of a task is first joined around the partners found in step 2, which
   connects a group of copies in tasks of bounded size; only if that leaves it in parts, its chunks meet pairwise.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from searchloom.llm._shared import Scratch, by_group, components, small_batches, spread
from searchloom.llm._text import mix, shingles, slices

FAMILIES = 6
CHUNK_SETS, CHUNK_TOKENS = 2048, 4_000_000
KEY_SETS = 4096  # sets of one key whose bitmaps meet in a task
PARTNERS = 4  # partners of a set around which a large block is joined first
HELD_BYTES = 24 << 20  # keys that a task holds before it combines them
POSTED_KEYS, POSTED_SETS = 500_000, 60_000  # keys and sets that a task gathers before it deals them to shards


def size_classes(num: int, den: int, most: int) -> np.ndarray:
    """First sizes of classes such that similar sets lie in the same or in adjacent classes."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def _digests(values: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit value per set; equal for equal sets. An empty set has 0."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A + seed * 0x1234567)), bounds[some]) + sizes[some].astype(np.uint64))
    return out


def bitmaps(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set, the parity of its elements at each of 2^m places, at least one place an element and 64 in all."""
    sizes = np.diff(bounds)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.cumsum(width) - width
    at = (values & (np.repeat(width, sizes) - 1).astype(np.uint64)).astype(np.int64) + np.repeat(base, sizes)
    raw = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(np.uint8)).tobytes()
    return [raw[a // 8 : (a + w) // 8] for a, w in zip(base.tolist(), width.tolist(), strict=True)]


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of 64-bit words, as it would be with fewer places."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def segment_keys(values: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) such that any two different sets with den * intersection >= num * union share a key.

    Segments that are empty give no key. A set with no more segments in use than it may differ in could meet a
    similar one in empty segments only; it takes further families of segments, and at last keys for empty ones.
    """
    sizes = np.diff(bounds)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = size_classes(num, den, int(sizes.max()) * 2)
    own = np.searchsorted(first, sizes, "right") - 1
    keys, owners = [], []
    for shift in (0, 1):  # a set meets its own class and, as the smaller one, the next
        sets = np.flatnonzero(sizes)
        meet = own + shift
        top = first[np.minimum(meet + 1, len(first) - 1)] - 1
        differ = 2 * top * (den - num) // (den + num)
        segments = differ + 1 + differ // 20
        least = (sizes + np.minimum(sizes * den // num, top)) * (den - num) // (den + num)
        for family in range(FAMILIES):
            if not len(sets):
                break
            count = sizes[sets]
            at = np.arange(count.sum()) + np.repeat(bounds[sets] - (np.cumsum(count) - count), count)
            h = values[at] if not family else mix(values[at] + np.uint64(family * 0x9E3779B97F4A7C15 % (1 << 64)))
            own_segments = segments[sets]
            base = np.cumsum(own_segments) - own_segments
            cell = np.repeat(base, count) + (((h >> np.uint64(32)) * np.repeat(own_segments, count).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            if family:
                order = np.argsort(cell, kind="stable")
                cell, h = cell[order], h[order]
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            cells = cell[start]
            which = np.searchsorted(base, cells, "right") - 1
            place = ((meet[sets[which]] * 64 + family) << 32) + (cells - base[which])
            with np.errstate(over="ignore"):
                content = np.add.reduceat(mix(h ^ np.uint64(0x3C6EF372FE94F82B)), start)
                keys.append(mix(content + mix(place.astype(np.uint64))))
            owners.append(sets[which])
            used = np.bincount(which, minlength=len(sets))
            unsafe = used <= least[sets]
            if family == FAMILIES - 1:
                for i in np.flatnonzero(unsafe):
                    gaps = np.setdiff1d(np.arange(own_segments[i]), cells[which == i] - base[i])
                    place = ((int(meet[sets[i]]) * 64 + family) << 32) + gaps
                    keys.append(mix(place.astype(np.uint64) ^ np.uint64(0x1B873593CC9E2D51)))
                    owners.append(np.full(len(gaps), sets[i]))
            sets = sets[unsafe]
    return np.concatenate(keys), np.concatenate(owners)


def shingle_sets(docs: DataFrame, key: str, text: str, k: int, seed: int = 0) -> DataFrame:
    """(key, n_shingles, node, proof, bits) of each row; node stands for the set and is null for an empty one, proof is a
    second hash of the set, bits its bitmap."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                values, bounds, _ = shingles(data, offsets, k)
                none = np.diff(bounds) == 0
                node, proof = (pa.array(_digests(values, bounds, x).view(np.int64), mask=none) for x in (seed, seed + 99))
                bits = [None if n else b for n, b in zip(none.tolist(), bitmaps(values, bounds), strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), node, proof, pa.array(bits, pa.binary())], [key, "n_shingles", "node", "proof", "bits"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles long, node long, proof long, bits binary")


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pairs (larger, smaller) of unlike nodes."""
    both = np.stack([np.maximum(a, b), np.minimum(a, b)], 1)
    return np.unique(both[both[:, 0] != both[:, 1]], axis=0)


def shared_keys(docs: DataFrame, text: str, k: int, num: int, den: int, seed: int, shards: int) -> DataFrame:
    """(u, v, key): sets u and v share a segment key (key is null), or set u has a key that several sets share (v is null).

    Every set of a shared key is in a pair of it, and the pairs of a key connect its sets.
    """
    names = ["shard", "nodes", "owners", "keys", "many", "edges"]
    out_names = ["u", "v", "key"]

    def block(shard, nodes=None, owners=None, keys=None, many=None, edges=None):
        blob = lambda x: pa.array([None if x is None else x.tobytes()], pa.binary())
        return pa.record_batch([pa.array([shard], pa.int32()), blob(nodes), blob(owners), blob(keys), blob(many), blob(edges)], names)

    def post(batches):
        held, seen, at = [], set(), 0

        def deal():
            nodes, keys = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            order = np.argsort(keys)
            keys, nodes = keys[order], nodes[order]
            head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            many = np.zeros(len(keys), bool)
            if not head.all():  # what meets here is told here; one posting goes on
                start = np.flatnonzero(head)
                size = np.diff(np.append(start, len(keys)))
                many = np.repeat(size > 1, size)
                yield block(at % shards, edges=_pairs(nodes[~head], np.repeat(nodes[start], size)[~head]))
                yield block(at % shards, nodes[many], None, keys[many])
                keys, nodes, many = keys[head], nodes[head], many[head]
            shard = ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(keys) else []
            for a, b in pairwise([*cuts, len(keys)]):
                part = order[a:b]
                own, local = np.unique(nodes[part], return_inverse=True)
                yield block(int(shard[part[0]]), own, local.astype(np.uint16), keys[part], many[part])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                values, bounds, _ = shingles(data, offsets, k)
                nodes = _digests(values, bounds, seed).view(np.int64)
                own, first = np.unique(nodes, return_index=True)
                fresh = np.zeros(len(nodes), bool)
                fresh[first[~np.isin(own, list(seen))]] = True
                keys, owners = segment_keys(values, bounds, num, den)
                mine = fresh[owners]
                held.append((nodes[owners[mine]], keys[mine]))
                seen.update(own.tolist())
                at += 1
                if len(seen) + len(nodes) > POSTED_SETS or sum(len(h[1]) for h in held) > POSTED_KEYS:
                    yield from deal()
                    seen.clear()
        if held:
            yield from deal()

    def meet(batches):
        held, now, size = [], None, 0

        def told(u, v, key):
            column = lambda x: pa.nulls(len(u), pa.int64()) if x is None else pa.array(x.view(np.int64))
            for at in range(0, len(u), 50_000):
                yield pa.record_batch([column(x).slice(at, 50_000) for x in (u, v, key)], out_names)

        def combined(last):
            """Tells what is held; one posting a key stays. Two sets that are all of a key are one pair, and told as such."""
            nodes, keys, many = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            order = np.argsort(keys)
            keys, nodes, many = keys[order], nodes[order], many[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(keys)))
            lead = np.repeat(nodes[start], size)
            some = nodes != lead
            pairs = _pairs(nodes[some], lead[some])
            yield from told(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), None)
            known = np.maximum.reduceat(many, start) if len(start) else many[:0]
            several = (size > 2) | ((size > 1) & (known > 0)) if last else size > 1
            again = np.repeat(several, size)
            yield from told(nodes[again], None, keys[again])
            if not last:
                held.append((nodes[start], keys[start], (known | several).astype(np.uint8)))

        for batch in batches:
            shard_of, *blobs = (batch.column(i) for i in range(len(names)))
            for i, shard in enumerate(shard_of.to_pylist()):
                if shard != now:
                    if held:
                        yield from combined(True)
                    now, size = shard, 0
                nodes, owners, keys, many, edges = (b[i].as_buffer() for b in blobs)  # views of the batch, not copies
                if edges is not None:
                    edges = np.frombuffer(edges, np.int64).reshape(-1, 2)
                    yield from told(edges[:, 0].copy(), edges[:, 1].copy(), None)
                elif owners is None:
                    yield from told(np.frombuffer(nodes, np.int64), None, np.frombuffer(keys, np.uint64))
                else:
                    held.append((np.frombuffer(nodes, np.int64)[np.frombuffer(owners, np.uint16)], np.frombuffer(keys, np.uint64), np.frombuffer(many, np.uint8)))
                    size += 17 * len(held[-1][1])
                    if size > HELD_BYTES:  # a key of many sets is told as it comes
                        yield from combined(False)
                        size = 17 * len(held[0][1]) // 2
        if held:
            yield from combined(True)

    blocks = docs.select(text).mapInArrow(post, "shard int, nodes binary, owners binary, keys binary, many binary, edges binary")
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(meet, "u long, v long, key long")


def _may_link(a: np.ndarray, b: np.ndarray, m: int, n: int, num: int, den: int) -> bool:
    """Whether sets of m and n elements with bitmaps a and b can have den * intersection >= num * union."""
    if min(m, n) * den < num * max(m, n):
        return False
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) * (den + num) <= (m + n) * (den - num)


def possible_pairs(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs(u, v) whose sizes and bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            m, a, n, b = (batch.column(i) for i in range(2, 6))
            sizes = zip(m.to_pylist(), n.to_pylist(), strict=True)
            keep = [_may_link(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64), x, y, num, den) for i, (x, y) in enumerate(sizes)]
            at = pa.array(np.flatnonzero(np.array(keep, bool)))
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at)], ["u", "v"])

    of = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("bits").alias(f"bits{name}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "nu", "bitsu", "nv", "bitsv")
    return both.mapInArrow(run, "u long, v long")


def grid(of: str, chunk: str):
    """The tasks (a, b), a <= b, in which one of `of` chunks meets each, itself included."""
    step = lambda i: F.struct(F.least(F.col(chunk), i).alias("a"), F.greatest(F.col(chunk), i).alias("b"))
    return F.explode(F.transform(F.sequence(F.lit(0), F.col(of) - 1), step)).alias("task")


def open_pairs(shared: DataFrame, roots: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): a forest of the possible pairs of each key between sets that have different roots so far.

    Keys of sets of one root have nothing to add. More than KEY_SETS sets of a key are cut into chunks that meet.
    """
    placed = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("sets")).where("low <> high and sets > 2")
    several = several.select("key", F.ceil(F.col("sets") / KEY_SETS).cast("int").alias("chunks"))
    asked = placed.join(several, "key").distinct().withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    asked = asked.join(nodes.select("node", "n", "bits"), "node")
    tasks = asked.select("key", grid("chunks", "chunk"), "node", "root", "n", "bits").select("key", "task.a", "task.b", "node", "root", "n", "bits")

    def work(table: pa.Table):
        node, root, n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
        bits = table.column("bits").to_pylist()
        order = np.argsort(n, kind="stable")
        node, n = node[order], n[order]
        _, root = np.unique(root[order], return_inverse=True)
        words = min(map(len, bits)) // 8
        whole = np.stack([folded(np.frombuffer(bits[i], np.uint64), words) for i in order.tolist()])
        found = []
        for i in range(len(n) - 1):
            end = int(np.searchsorted(n, n[i] * den // num, "right"))
            other = np.flatnonzero(root[i + 1 : end] != root[i]) + i + 1
            if len(other):
                unlike = np.bitwise_count(whole[other] ^ whole[i]).sum(1).astype(np.int64)
                for j in other[unlike * (den + num) <= (n[other] + n[i]) * (den - num)].tolist():
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        found.append((node[j], node[i]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return by_group(tasks, ["key", "a", "b"], work, "u long, v long").distinct()


class PrefixTree:
    """Sets of ascending ranks, stored by their common beginnings; a node holds the ranks up to its next fork.

    A set may be given without elements that no other set has; `full` then has its whole size.
    """

    def __init__(self, sets: list[np.ndarray], full: list[int]):
        self.sets, self.full = sets, full
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        # Parallel lists by node: ranks on it, depth at its end, children, sets that end there; below it, the smallest
        # and largest size and the most ranks of a set.
        self.ranks, self.depth, self.children, self.ends, self.sizes = [], [], [], [], []
        root = self._node(np.zeros(0, np.int64), 0)
        path, before = [root], None
        for i in order:
            own = sets[i]
            common = 0
            if before is not None:
                n = min(len(own), len(before))
                unlike = np.flatnonzero(own[:n] != before[:n])
                common = int(unlike[0]) if len(unlike) else n
            last = None
            while self.depth[path[-1]] > common:
                last = path.pop()
            if self.depth[path[-1]] < common:  # fork inside `last`
                at = common - self.depth[path[-1]]
                upper = self._node(self.ranks[last][:at], common)
                self.ranks[last] = self.ranks[last][at:]
                self.children[path[-1]].remove(last)
                self.children[path[-1]].append(upper)
                self.children[upper].append(last)
                path.append(upper)
            if len(own) > common:
                leaf = self._node(own[common:], len(own))
                self.children[path[-1]].append(leaf)
                path.append(leaf)
            self.ends[path[-1]].append(i)
            before = own
        walk = [root]
        for node in walk:
            walk.extend(self.children[node])
        for node in reversed(walk):
            below = [(full[i], full[i], len(sets[i])) for i in self.ends[node]] + [self.sizes[c] for c in self.children[node]]
            if below:
                low, high, most = zip(*below, strict=True)
                self.sizes[node] = (min(low), max(high), max(most))

    def _node(self, ranks, depth):
        for column, value in zip((self.ranks, self.depth, self.children, self.ends, self.sizes), (ranks, depth, [], [], (0, 0, 0)), strict=True):
            column.append(value)
        return len(self.ranks) - 1

    def similar(self, own: np.ndarray, n: int, member: np.ndarray, num: int, den: int, skip):
        """Sets i with den * overlap >= num * union. n: whole size of own; member: whether a rank is in own; skip(i):
        need not be tested."""
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            low, high, most = self.sizes[node]
            if high * den < num * n or low * num > den * n:
                continue
            ranks = self.ranks[node]
            if len(ranks):
                overlap += int(np.count_nonzero(member[ranks]))
                left = len(own) - int(np.searchsorted(own, ranks[-1], "right"))
            else:
                left = len(own)
            # The overlap needed with the smallest set below, against the most that can still be reached.
            if (overlap + min(left, most - self.depth[node])) * (den + num) < num * (n + max(low, -(-num * n // den))):
                continue
            for i in self.ends[node]:
                if overlap * (den + num) >= num * (n + self.full[i]) and not skip(i):
                    yield i
            stack.extend((c, overlap) for c in self.children[node])


def link_sets(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A forest of pairs (i, j) that connects sets of hashes exactly as all links between them would."""
    # Few copies of the elements at a time: they are sorted in place, and ranks are 32 bits wide.
    held = np.concatenate(sets)
    held.sort()
    start = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    known, often = held[start], np.diff(np.append(start, len(held))).astype(np.int32)
    del held, start
    rank = np.empty(len(often), np.uint32)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often), dtype=np.uint32)
    # An element of one set alone is in no overlap: a set with too few others has no links and stays out of the tree.
    ranked, full, place = [], [], []
    for i, own in enumerate(sets):
        at = np.searchsorted(known, own)
        at = at[often[at] > 1]
        if len(at) * den >= num * len(own):
            ranked.append(np.sort(rank[at]))
            full.append(len(own))
            place.append(i)
    del known, rank
    tree, member, root = PrefixTree(ranked, full), np.zeros(len(often), bool), list(range(len(ranked)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest, groups = [], len(ranked)
    for i, own in enumerate(ranked):
        if groups <= 1:
            break
        member[own] = True
        for j in tree.similar(own, full[i], member, num, den, lambda j, i=i: find(i) == find(j)):
            root[find(j)] = find(i)
            forest.append((place[i], place[j]))
            groups -= 1
        member[own] = False
    return forest


def _sets_of(asked: DataFrame, k: int, seed: int, names: tuple[str, ...]) -> DataFrame:
    """(*names, set) of asked(text, node, ...): the set of each row whose text has it; a repeated key may bring others."""

    def fetch(batches):
        for batch in batches:
            nodes = np.asarray(batch.column(1))
            for lo, hi, data, offsets in slices(batch.column(0)):
                values, bounds, _ = shingles(data, offsets, k)
                right = _digests(values, bounds, seed).view(np.int64) == nodes[lo:hi]
                sets = [values[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(right)]
                at = pa.array(np.flatnonzero(right) + lo)
                yield pa.record_batch([*(batch.column(i).take(at) for i in range(1, len(names) + 1)), pa.array(sets, pa.binary())], [*names, "set"])

    kinds = ", ".join(f"{n} {asked.schema[n].dataType.simpleString()}" for n in names)
    return asked.select(asked.columns[0], *names).mapInArrow(fetch, f"{kinds}, set binary")


def _tree_join(num: int, den: int):
    def join(table: pa.Table):
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        column = table.column("set")
        forest = link_sets([np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in first], num, den) if len(first) > 1 else []
        pairs = nodes[np.array(forest, np.int64).reshape(-1, 2)]
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return join


def _large_blocks(large: DataFrame, pairs: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The links of blocks that no task can hold, from large(node, block, n, set).

    Each set first meets its PARTNERS smallest partners: sets with the same partner are joined in tasks of bounded size
    that all hold the partner. Blocks that this leaves in parts are dealt by class of size and chunk: linked sets lie in
    the same class or in adjacent ones, and a task joins two chunks of a class, or one with one of the next class.
    """
    join = _tree_join(num, den)
    inside = pairs.join(large.select(F.col("node").alias("u")), "u")
    near = inside.withColumn("__n", F.row_number().over(W.partitionBy("u").orderBy("v"))).where(F.col("__n") <= PARTNERS).drop("__n")
    tokens = large.agg(F.max("n")).first()[0]
    most = max(2, min(CHUNK_SETS, CHUNK_TOKENS // tokens))
    hubs = near.groupBy("v").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    dealt = near.join(hubs, "v").select("v", F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int").alias("chunk"), F.col("u").alias("node"))
    around = dealt.union(dealt.select("v", "chunk", F.col("v").alias("node")).distinct()).join(large.select("node", "set"), "node")
    links = scratch.stage(by_group(around, ["v", "chunk"], join, "u long, v long"), "links-around")
    groups = components(links, scratch, "groups-around")
    parts = large.select("node", "block").join(groups, "node", "left").groupBy("block").agg(F.count_distinct(F.coalesce("root", "node")).alias("parts"))
    rest = large.join(parts.where("parts > 1").select("block"), "block", "left_semi")
    # A class's sizes reach up to the least size that a set linked to its smallest may have.
    width = max(math.log(den / num), 0.01) * 1.000001
    rest = rest.withColumn("class", F.floor(F.log(F.col("n")) / width).cast("int"))
    need = F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("int")
    counts = scratch.stage(rest.groupBy("block", "class").agg(need.alias("chunks")), "chunks")
    beside = lambda step, name: counts.select("block", (F.col("class") + step).alias("class"), F.col("chunks").alias(name))
    places = counts.join(beside(-1, "above"), ["block", "class"], "left").join(beside(1, "below"), ["block", "class"], "left").fillna(0, ["above", "below"])
    wanted = rest.join(places, ["block", "class"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # (class, a) is the first of a task's two chunks, (class + step, b) the second.
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda c, step, a, b: F.struct(c.alias("class"), F.lit(step).alias("step"), a.alias("a"), b.alias("b"))
    own = F.transform(up_to("chunks"), lambda i: task(F.col("class"), 0, F.least(F.col("chunk"), i), F.greatest(F.col("chunk"), i)))
    higher = F.transform(up_to("above"), lambda i: task(F.col("class"), 1, F.col("chunk"), i))
    lower = F.transform(up_to("below"), lambda i: task(F.col("class") - 1, 1, i, F.col("chunk")))
    # Chunks that meet others need no task of their own.
    alone = F.filter(own, lambda x: (x["a"] != x["b"]) | (F.col("chunks") + F.col("above") + F.col("below") == 1))
    tasks = wanted.select("block", "node", "set", F.explode(F.concat(alone, higher, lower)).alias("task")).select("block", "task.*", "node", "set")
    return links.union(by_group(tasks, ["block", "class", "step", "a", "b"], join, "u long, v long"))


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component): component is the smallest key that links lead to, the row's own included.

    Rows are linked when den * |intersection| >= num * |union| of their sets of distinct k-word shingles (A-Z lowered;
    a text of fewer words is one shingle). Texts without words have no links. Equal sets are linked whatever their
    number. Rows that repeat a key stay rows, and each has the component of its own text; a row with a null key, and
    nothing but such rows around it, has a null component. Keys are of a type that has an order. Other columns are
    ignored; empty input gives an empty result. Sets are told apart by 128 bits of hash, their elements by 64.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(key, text)
    for seed in range(100):  # another seed in the unlikely case that two sets have the same node
        with small_batches(spark):
            sets = scratch.stage(shingle_sets(docs, key, text, k, seed), "sets")
        nodes = sets.where("node is not null").groupBy("node").agg(F.min(key).alias(key), F.max("n_shingles").alias("n"), F.min("proof").alias("low"), F.max("proof").alias("high"), F.first("bits").alias("bits"))
        nodes = scratch.stage(nodes, "nodes")
        if nodes.where("low <> high").isEmpty():
            break
        scratch.close()
    tokens = nodes.agg(F.sum("n")).first()[0] or 0
    with small_batches(spark):
        found = scratch.stage(shared_keys(docs, text, k, num, den, seed, spread(spark, 11 * tokens)), "keys")
        pairs = scratch.stage(possible_pairs(found.where("key is null").select("u", "v").distinct(), nodes, num, den), "pairs")
    blocks = components(pairs, scratch, "blocks")
    shared = found.where("key is not null").select("key", F.col("u").alias("node"))
    more = scratch.stage(open_pairs(shared, blocks, nodes, num, den), "open-pairs")
    scratch.drop("keys")
    if not more.isEmpty():
        pairs = pairs.union(more)
        blocks = components(pairs, scratch, "more-blocks")
    owners = nodes.select("node", key, "n").join(blocks.withColumnRenamed("root", "block"), "node")
    sizes = owners.groupBy("block").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    wanted = scratch.stage(owners.join(sizes.select("block", ((F.col("sets") > CHUNK_SETS) | (F.col("tokens") > CHUNK_TOKENS)).alias("large")), "block"), "owners")
    asked = docs.join(wanted.withColumnRenamed(key, "__key"), docs[key] == F.col("__key")).select(text, "node", "block", "n", "large")
    # Sets that rows without a key alone hold are fetched by node, one text of each.
    keyless = shingle_sets(docs.where(F.col(key).isNull()).select(F.col(text).alias("__text"), text), "__text", text, k, seed)
    keyless = keyless.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("__text").alias(text))
    asked = asked.union(keyless.join(wanted.where(F.col(key).isNull()), "node").select(text, "node", "block", "n", "large"))
    full = lambda large: _sets_of(asked.where("large" if large else "not large"), k, seed, ("node", "block", "n"))
    with small_batches(spark):
        links = scratch.stage(by_group(full(False), ["block"], _tree_join(num, den), "u long, v long"), "links")
        if not wanted.where("large").isEmpty():
            large = scratch.stage(full(True).dropDuplicates(["node"]), "large")
            links = scratch.stage(links.union(_large_blocks(large, pairs, scratch, num, den)), "all-links")
    groups = components(links)
    scratch.close("sets")
    rows = sets.select(key, "n_shingles", "node").join(groups, "node", "left").withColumn("__root", F.coalesce("root", "node"))
    least = rows.where(F.col("__root").isNotNull()).groupBy("__root").agg(F.min(key).alias("__least"))
    rows = rows.join(least, "__root", "left")
    return rows.select(F.col(key), "n_shingles", F.coalesce(F.col("__least"), F.col(key)).alias("component"))
