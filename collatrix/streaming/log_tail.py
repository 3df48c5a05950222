"""The log as a stream: counts per activity in event-time windows, and the latest line of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "append_seq long, prov_id string, activity string, agent string, item_key string, snapshot_id string, params string, ts timestamp, passed boolean"


def read(spark: SparkSession, path: str, kind: str = "parquet", per_trigger: int = 8) -> DataFrame:
    """New files of a log folder as a stream."""
    return spark.readStream.format(kind).schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).load(path)


def windowed_counts(log: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """window, activity, n, passed; repeated lines count once within the watermark, later ones are dropped by it."""
    e = log.filter("ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["prov_id"])
    return e.groupBy(F.window("ts", width), "activity").agg(F.count("*").alias("n"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"))


def upsert_latest(path: str):
    """A ``foreachBatch`` writer that keeps the latest line of each item, as ``audit.latest_per_item`` gives it, at ``path``.

    A line counts by its first append, whenever it is delivered again: the state at ``path`` holds (prov_id, first
    append_seq) with the line's item and activity, one folder an epoch with the lines that are new or were appended
    earlier than known; ``latest`` reads all epochs. An epoch that is delivered again replaces its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        cols = ["append_seq", "item_key", "activity"]
        once = batch.filter("prov_id is not null").groupBy("prov_id").agg(F.min_by(F.struct(*cols), "append_seq").alias("r")).select("prov_id", "r.*")
        once = once.unionByName(batch.filter("prov_id is null").select("prov_id", *cols))
        once.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latest(spark: SparkSession, path: str) -> DataFrame:
    """item_key, append_seq, activity of the last line of each item over all epochs at ``path``."""
    lines = spark.read.parquet(path)
    cols = ["append_seq", "item_key", "activity"]
    once = lines.filter("prov_id is not null").groupBy("prov_id").agg(F.min_by(F.struct(*cols), "append_seq").alias("r")).select("r.*").unionByName(lines.filter("prov_id is null").select(*cols))
    return once.filter("item_key is not null").groupBy("item_key").agg(F.max_by(F.struct("append_seq", "activity"), "append_seq").alias("m")).select("item_key", "m.append_seq", "m.activity")
