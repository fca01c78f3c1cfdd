"""Staged tables in the folder that all executors share, and connected components of a distributed edge list."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm._text import mix

SHARD_BYTES = 8 << 20  # what a task that holds a shard in memory is dealt, on average


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "searchloom-checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that a job stages in the shared folder; those that nothing reads any more can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors."""
        self.paths[name] = path = new_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, self.paths.pop(name))

    def close(self, *kept: str) -> None:
        """Drops all tables but those kept."""
        self.drop(*(n for n in list(self.paths) if n not in kept))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """One table in the shared folder, for a result that is read lazily: it stays until the folder is cleared."""
    return Scratch(df.sparkSession).stage(df, name)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> str | None:
    """Bounds the session's Arrow batches to `most` bytes, a lower bound stays: for results that are read later. Gives the
    setting before, and for a lower bound the one that stays."""
    before = spark.conf.get(BATCH, None)
    if not (before and before.isdigit() and 0 < int(before) <= most):
        spark.conf.set(BATCH, most)
    return before


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Bounds Arrow batches to `most` bytes for the jobs run inside, so that rows with whole texts or sets pass between
    the JVM and Python a few megabytes at a time. The session's setting is restored; a lower one stays."""
    before = bound_batches(spark, most)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)


def spread(spark: SparkSession, size: float = 0) -> int:
    """How many shards `size` bytes are dealt to: SHARD_BYTES in each, and at least the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // SHARD_BYTES))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str, parts: int | None = None) -> DataFrame:
    """work() on the rows of each combination of keys, as one table: groups are dealt by key, sorted and streamed.

    Groups must be of a size that a task can hold; a small one costs no more than the slicing of its rows.
    """

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys], 1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                first = tuple(marks[a].tolist())
                if held and first != now:
                    yield from out(held)
                    held = []
                now = first
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held)

    def out(held):
        found = work(pa.Table.from_batches(held))
        if found is not None and found.num_rows:
            yield from found.to_batches()

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def join_unique(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """The left join of `left` with right(key, n, ...), which has one row per key and how many rows of `left` have it.

    Keys of more than one in 10,000 rows (and of over 1,000 rows) are broadcast: there are fewer than 10,000 of them
    whatever the size. No other key is large enough to burden the task that it is dealt to.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(n) > max(1000, total // 10_000)).drop(n))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(n) <= max(1000, total // 10_000)).drop(n), key, "left")
    return left.join(hot, key).unionByName(rest)


def _forest(frames):
    """Contracts the edges of a task to (node, smallest node linked to it here, whether this edge is new)."""
    held: list[np.ndarray] = []
    given: list[np.ndarray] = []

    def contract(pairs: np.ndarray) -> np.ndarray:
        nodes, index = np.unique(pairs, return_inverse=True)
        index = index.reshape(pairs.shape)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[index[:, 0]], label[index[:, 1]])
            new = label.copy()
            np.minimum.at(new, index[:, 0], low)
            np.minimum.at(new, index[:, 1], low)
            np.minimum.at(new, label, new)
            new = new[new]
            if (new == label).all():
                break
            label = new
        other = label != np.arange(len(nodes))
        return np.stack([nodes[other], nodes[label[other]]], 1)

    size = 0
    for frame in frames:
        if len(frame):
            held.append(frame[["u", "v"]].to_numpy(np.int64))
            given.append(mix(held[-1][:, 0].view(np.uint64) ^ mix(held[-1][:, 1].view(np.uint64))))
            size += len(frame)
        if size > 1_000_000:  # contract before more is read, so that memory stays within the nodes of this task
            held, given = [contract(np.concatenate(held))], [np.unique(np.concatenate(given))]
            size = 0
    if held:
        out = contract(np.concatenate(held))
        new = ~np.isin(mix(np.ascontiguousarray(out[:, 0]).view(np.uint64) ^ mix(np.ascontiguousarray(out[:, 1]).view(np.uint64))), np.concatenate(given))
        for at in range(0, len(out), 100_000):
            yield pd.DataFrame({"u": out[at : at + 100_000, 0], "v": out[at : at + 100_000, 1], "new": new[at : at + 100_000]})


def components(edges: DataFrame, kept: Scratch | None = None, name: str = "roots") -> DataFrame:
    """Connected components of edges(u long, v long): (node, root), root the smallest node; only nodes with an edge.

    A round deals the edges by their larger end, contracts those of each task to stars, and lets every node jump to
    its parent's parent. Only leaves are dealt by key: a hub's edges lie in many tasks, and the jump is a join whose
    large partitions Spark can split. Rounds are written to the shared folder, and dropped when the next one is there;
    one number a round comes to the driver. The result is a table staged in `kept`.
    """
    scratch = Scratch(edges.sparkSession)
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    links = ends.mapInPandas(_forest, "u long, v long, new boolean")
    turn = 0
    while True:
        local = links.select("u", "v").repartition(spread(edges.sparkSession), "u").mapInPandas(_forest, "u long, v long, new boolean")
        local = scratch.stage(local, f"local-{turn}")
        above = local.groupBy("u").agg(F.min("v").alias("__v")).withColumnRenamed("u", "__u")
        jumped = local.join(above, F.col("v") == F.col("__u"), "left")
        links = scratch.stage(jumped.select("u", F.coalesce("__v", "v").alias("v"), (F.col("new") | F.col("__v").isNotNull()).alias("new")), f"links-{turn}")
        scratch.close(f"links-{turn}")
        turn += 1
        if not links.agg(F.max("new")).first()[0]:
            break
    nodes = links.select("u", F.col("v").alias("root")).union(links.select(F.col("v").alias("u"), F.col("v").alias("root")))
    roots = (kept or Scratch(edges.sparkSession)).stage(nodes.groupBy(F.col("u").alias("node")).agg(F.min("root").alias("root")), name)
    scratch.close()
    return roots
