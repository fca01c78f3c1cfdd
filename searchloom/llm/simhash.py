"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint is a ring of SEGMENTS bytes. If two fingerprints differ in at most `most` bits, some segment starts a chain
in which the differences of the first l segments add up to at most l * most / SEGMENTS, for every l (pigeonring). The
chain fixes where its equal segments may lie, so pairs meet on keys of a start and its first two equal segments. Keys of
too many fingerprints are split by the chain's third equal segment, then by its fourth. In a group, pairs whose chain
exceeds a budget are pruned before all 64 bits are compared; a large group is searched only between what is not yet
connected, and gives a forest. What four equal segments still leave in one large group is linked through the values
within half the distance of each fingerprint, which two fingerprints share exactly if they are that near.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm._shared import Scratch, components, join_unique, spread
from searchloom.llm._text import LOWER, inside, slices, words

SEED = 42
SEGMENTS, WIDTH = 8, 8  # a ring of eight bytes
GROUP = 8192  # fingerprints that a task compares with each other
SMALL = 16  # groups up to this size are compared by place, all groups of a batch at once
HOT_KEYS = 100_000  # keys to split that are broadcast; more are joined by shuffle
UNPACKED = 1 << 16  # hashes whose bits are counted at once


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row of hashes, the number whose bits are those set in over half of them; zero for an empty row."""
    counts = np.zeros((len(bounds) - 1, 64), np.int64)
    for at in range(0, len(h), UNPACKED):
        part = h[at : at + UNPACKED]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low = np.clip(bounds - at, 0, len(part))
        mine = np.flatnonzero(low[1:] > low[:-1])
        counts[mine] += np.add.reduceat(bits, low[mine], axis=0, dtype=np.int32)
    over = 2 * counts > np.diff(bounds)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each k-word shingle of each row, repeats included, words joined by a blank, and the bounds of rows.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets)
    sizes = ends - starts + 1
    at = np.cumsum(sizes) - sizes
    source = np.arange(at[-1] + sizes[-1] if len(at) else 0) - np.repeat(at - starts, sizes)
    joined = low[np.minimum(source, len(low) - 1)] if len(low) else low
    joined[at + sizes - 1] = 0x20
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - (k - 1), counts > 0)
    cuts = np.concatenate([[0], np.cumsum(n)])
    first, last = np.zeros(cuts[-1], np.int64), np.zeros(cuts[-1], np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = np.ones(len(first), bool)
    whole[cuts[short]] = False
    first[whole] = inside(bounds, k)[0]
    last[whole] = first[whole] + k - 1
    first[cuts[short]], last[cuts[short]] = bounds[short], bounds[short + 1] - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    found = (digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at + sizes - 1)[last].tolist(), strict=True))
    return np.fromiter(found, np.uint64, len(first)), cuts


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(key, fingerprint long) of each row's lower-cased (A-Z) k-word shingles; zero for a text without words or null."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                found = majority(*shingle_hashes(data, offsets, k)).view(np.int64)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(found)], [key, "fingerprint"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fingerprint", T.LongType())]))


def budgets(most: int) -> list[int]:
    """How many bits the first l segments of a chain may differ in, for l from 0."""
    return [n * most // SEGMENTS for n in range(SEGMENTS + 1)]


def patterns(equal: int, most: int) -> list[tuple[int, ...]]:
    """Where a viable chain's first `equal` equal segments may lie: each one before them that differs costs a bit."""
    allowed, found = budgets(most), [(0,)]
    for _ in range(equal - 1):
        found = [(*f, p) for f in found for p in range(f[-1] + 1, SEGMENTS) if p - len(f) <= allowed[p]]
    return found


def _keys(equal: int, most: int) -> Column:
    """All keys of a fingerprint with that many equal segments: an array of (start, pattern, key)."""
    part = [F.shiftrightunsigned("fingerprint", WIDTH * s).bitwiseAND(255) for s in range(SEGMENTS)]
    found = []
    for start in range(SEGMENTS):
        for number, pattern in enumerate(patterns(equal, most)):
            key = F.lit(number * SEGMENTS + start).cast("long")
            for p in pattern:
                key = F.shiftleft(key, WIDTH) + part[(start + p) % SEGMENTS]
            found.append(key)
    return F.array(*found)


def start_of(keys: np.ndarray, equal: int) -> np.ndarray:
    return (keys >> (WIDTH * equal)) % SEGMENTS


def near(a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """Which pairs have a chain from their start that keeps within every budget, the last being the whole distance."""
    shift = (start * WIDTH).astype(np.uint64)
    x = a ^ b
    x = (x >> shift) | (x << ((np.uint64(64) - shift) & np.uint64(63)))
    live = np.arange(len(x))
    for n, budget in enumerate(budgets(most)[1:], 1):
        ok = np.bitwise_count(x & np.uint64((1 << WIDTH * n) - 1)) <= budget
        x, live = x[ok], live[ok]
    return live


def small_links(fps: np.ndarray, keys: np.ndarray, start: np.ndarray, most: int, largest: int) -> list[np.ndarray]:
    """Links inside the groups of equal keys (which are sorted), by distance between places."""
    found = []
    for step in range(1, largest):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(at):
            break
        at = at[near(fps[at], fps[at + step], start[at], most)]
        found.append(np.stack([fps[at], fps[at + step]], 1))
    return found


def forest_of(fps: np.ndarray, start: int, most: int) -> np.ndarray:
    """Links that connect what the links inside one group connect: a row meets only those not yet connected with it."""
    label, found = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(others):
            continue
        hit = others[near(fps[others], np.full(len(others), fps[i]), np.full(len(others), start), most)]
        roots, first = np.unique(label[hit], return_index=True)
        if len(roots):
            found.append(np.stack([np.full(len(roots), fps[i]), fps[hit[first]]], 1))
            label[np.isin(label, roots)] = label[i]
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def _links_in_groups(rows: DataFrame, equal: int, most: int, parts: int) -> DataFrame:
    """Links (u, v) of rows(key, fingerprint) with equal keys: groups are dealt by key, sorted and streamed."""

    def work(keys, fps):
        fps, start = fps.view(np.uint64), start_of(keys, equal)
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(cuts)
        small = np.repeat(sizes <= SMALL, sizes)
        found = small_links(fps[small], keys[small], start[small], most, SMALL)
        found += [forest_of(fps[cuts[g] : cuts[g + 1]], int(start[cuts[g]]), most) for g in np.flatnonzero(sizes > SMALL)]
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
        pairs = np.unique(pairs, axis=0).view(np.int64)
        return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, fps = np.concatenate([keys, np.asarray(batch.column(0))]), np.concatenate([fps, np.asarray(batch.column(1))])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on
            if whole > UNPACKED:
                yield work(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield work(keys, fps)

    return rows.select("key", "fingerprint").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _links_by_flips(rows: DataFrame, equal: int, most: int) -> DataFrame:
    """Edges from each of rows(key, fingerprint) to all values within most / 2 bits of it outside the key's segments.

    Fingerprints that share such a value differ in at most `most` bits, and those that do share one, so a group's links
    connect the same fingerprints; the number of edges grows with the fingerprints, not with their pairs.
    """
    half = most // 2
    table = patterns(equal, most)

    def run(batches):
        for batch in batches:
            for key, fp in zip(batch.column(0).to_pylist(), np.asarray(batch.column(1)).view(np.uint64), strict=True):
                start, pattern = key >> (WIDTH * equal), table[(key >> (WIDTH * equal)) // SEGMENTS]
                fixed = {(start + p) % SEGMENTS for p in pattern}
                free = [1 << b for b in range(64) if b // WIDTH not in fixed]
                masks = [0, *(sum(c) for n in range(1, half + 1) for c in combinations(free, n))]
                near = (fp ^ np.array(masks, np.uint64)).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(near), fp).view(np.int64)), pa.array(near)], ["u", "v"])

    return rows.repartition(spread(rows.sparkSession)).mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, most: int, scratch: Scratch, group: int = GROUP, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of nodes(fingerprint) as all pairs within `most` bits do."""
    spark, found, parts = nodes.sparkSession, [], spread(nodes.sparkSession)
    dealt = nodes.select(F.explode(_keys(2, most)).alias("key"), "fingerprint")
    for equal in (2, 3, 4):
        large = scratch.stage(dealt.groupBy("key").count().where(F.col("count") > group).select("key"), f"large-{equal}")
        n = large.count()
        if not n:
            found.append(_links_in_groups(dealt, equal, most, parts))
            break
        # Few keys are broadcast; more are joined in eight portions of each, which large ones fill evenly.
        portion = F.pmod(F.xxhash64("fingerprint"), F.lit(8)).cast("int")
        beside = F.broadcast(large) if n <= hot_keys else large.withColumn("portion", F.explode(F.array(*map(F.lit, range(8)))))
        on = ["key"] if n <= hot_keys else ["key", "portion"]
        rows = dealt if n <= hot_keys else dealt.withColumn("portion", portion)
        found.append(_links_in_groups(rows.join(beside, on, "left_anti"), equal, most, parts))
        rest = scratch.stage(rows.join(beside, on, "left_semi").select("key", "fingerprint"), f"rest-{equal}")
        if equal == 4:
            found.append(_links_by_flips(rest, equal, most))
        else:
            dealt = _refined(rest, equal, most)
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def _refined(rows: DataFrame, equal: int, most: int) -> DataFrame:
    """rows(key, fingerprint) with the keys of one equal segment more that go on from each key."""
    table, longer = patterns(equal, most), patterns(equal + 1, most)
    follow = [[n for n, p in enumerate(longer) if p[:equal] == q] for q in table]
    head = F.shiftrightunsigned("key", WIDTH * equal)
    start, number = head % SEGMENTS, (head / SEGMENTS).cast("int")
    part = lambda p: F.expr(f"shiftrightunsigned(fingerprint, cast((({WIDTH}) * ((shiftrightunsigned(key, {WIDTH * equal}) + {p}) % {SEGMENTS})) as int)) & 255")
    held = F.col("key").bitwiseAND((1 << WIDTH * equal) - 1)
    cases = None
    for i, children in enumerate(follow):
        made = F.array(*(F.shiftleft(F.shiftleft((F.lit(n * SEGMENTS) + start).cast("long"), WIDTH * equal) + held, WIDTH) + part(longer[n][-1]) for n in children))
        cases = F.when(number == i, made) if cases is None else cases.when(number == i, made)
    return rows.select(F.explode(cases).alias("key"), "fingerprint")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, most: int = 4, group: int = GROUP, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(key, fingerprint, component): fingerprint as 16 hex digits, component the smallest key that links lead to.

    Rows are linked when their fingerprints differ in at most `most` bits: 0, 2 or 4 (beyond, four segments need not be equal).
    A null text or one without words has fingerprint zero and is linked like any other. Equal fingerprints are one node
    whatever their number. Rows that repeat a key stay rows; a null key is never the smallest, and a component of such
    rows alone is null. Other columns are ignored; empty input gives an empty result.
    """
    if most not in (0, 2, 4):
        raise ValueError("most must be 0, 2 or 4")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stage(fingerprints(docs, key, text, k), "fingerprints")
    nodes = scratch.stage(rows.groupBy("fingerprint").agg(F.min(key).alias("__least"), F.count("*").alias("__n")), "nodes")
    roots = components(links(nodes.select("fingerprint"), most, scratch, group, hot_keys), scratch, "roots")
    placed = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint").select("fingerprint", "root", "__least", "__n")
    least = placed.groupBy("root").agg(F.min("__least").alias("component"), F.count("*").alias("__m"))
    linked = join_unique(placed.drop("__least"), least, "root", "__m").select("fingerprint", "component", "__n")
    alone = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left_anti").select("fingerprint", F.col("__least").alias("component"), "__n")
    found = scratch.stage(linked.unionByName(alone), "groups")
    scratch.close("fingerprints", "groups")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return join_unique(rows, found, "fingerprint", "__n").select(F.col(key), digits.alias("fingerprint"), "component")
