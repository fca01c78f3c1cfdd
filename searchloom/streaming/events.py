"""Streaming forms of the daily jobs; every function takes a batch or a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.operators import merge


def _timed(rows: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "13 days") -> DataFrame:
    """Events and their values by day and type; late rows count until the watermark passes."""
    days = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return days.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "n", "value")


def rolling_rates(probes: DataFrame, late: str = "13 days") -> DataFrame:
    """Share of probes that name us, over seven days, every day."""
    rows = _timed(probes).withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("w"), "question_id")
    return rows.agg(F.count("*").alias("probes"), (F.sum("mentioned") / F.count("*")).alias("rate")).select(F.to_date("w.start").alias("day"), "question_id", "probes", "rate")


def deduplicated(rows: DataFrame, keys: list[str], late: str = "13 days") -> DataFrame:
    return _timed(rows).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def upsert_batches(rows: DataFrame, path: str, keys: list[str], checkpoint: str, late: str = "13 days", once: bool = False):
    """Starts a stream that merges each batch into the table at path, which has a folder for each day of `ts`.

    A batch reads and rewrites the days that it touches, and no others. Keys must fix the day, as those of dated facts
    do. The rewritten days are staged as a whole before they take the place of the old ones, so a batch that is run
    again ends what it began, or merges the same rows once more, and leaves no double either way. Rows later than the
    watermark allows are not kept out. `once`: the stream stops when it has read what is there.
    """

    def merge_batch(batch: DataFrame, n: int) -> None:
        spark, staged = batch.sparkSession, f"{path}/_batch-{n:09d}"  # readers of the table skip such names
        if not _exists(spark, f"{staged}/_SUCCESS"):
            new = merge.latest(batch, keys, "ts").withColumn("__day", F.to_date("ts")).persist()
            days = [r[0] for r in new.select("__day").distinct().collect()]  # one value for each day of the batch
            old = _table(spark, path)
            out = new if old is None else merge.merge_into(old.where(F.col("__day").isin(days)), new, keys)
            out.write.mode("overwrite").parquet(staged)
            new.unpersist()
        found = spark.read.parquet(staged)
        found.repartition("__day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__day").parquet(path)
        _files(spark, staged).delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    stream = _timed(rows).withWatermark("ts", late).writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge_batch)
    return (stream.trigger(availableNow=True) if once else stream).start()


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    kept = [s for s in _files(spark, path).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) if s.getPath().getName().startswith("__day=")]
    return spark.read.parquet(path) if kept else None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that upsert_batches() has made; None if there is none."""
    found = _table(spark, path)
    return None if found is None else found.drop("__day")
