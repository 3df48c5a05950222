"""Writers: batches with their results, versioned changes, content-addressed blobs, append-only logs, dated exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 50


def batches(rows: DataFrame, key: str, size: int = BATCH) -> DataFrame:
    """Adds ``batch`` and ``index`` (place in its batch), numbered by key without one task for all rows.

    Rows are counted per hash slice first; slices get their starting points, and numbers run inside each slice.
    """
    x = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(256)))
    starts = x.groupBy("_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    starts = starts.select("_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_slice").orderBy(key)
    n = F.col("_start") + F.row_number().over(inside) - 1
    return x.join(starts, "_slice").withColumn("_i", n).withColumn("batch", F.floor(F.col("_i") / size)).withColumn("index", F.pmod("_i", F.lit(size)).cast("int")).drop("_slice", "_start", "_i")


def failed_again(rows: DataFrame, results: DataFrame) -> DataFrame:
    """The rows whose (batch, index) failed, to be sent again."""
    return rows.join(results.filter("status = 'failed'").select("batch", "index"), ["batch", "index"], "left_semi")


def versioned_patch(target: DataFrame, patch: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table after the patch, conflicts): rows whose version is the target's replace the patched columns and count one version up."""
    cols = [c for c in patch.columns if c not in (key, "version")]
    p = patch.select(key, F.col("version").alias("__version"), *[F.col(c).alias(f"_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    x = target.join(p, key, "left")
    ok = F.col("_hit") & F.col("version").eqNullSafe(F.col("__version"))
    done = x.select(*[F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.when(ok, F.col("version") + 1).otherwise(F.col("version")).alias(c) if c == "version" else F.col(c) for c in target.columns])
    conflicts = patch.join(target.select(key, F.col("version").alias("_now")), key, "left").filter(~F.col("version").eqNullSafe(F.col("_now"))).drop("_now")
    return done, conflicts


def new_blobs(bodies: DataFrame, stored: DataFrame, column: str = "body") -> DataFrame:
    """digest, body of the bodies not stored yet, each once."""
    b = bodies.select(F.sha2(F.col(column).cast("string"), 256).alias("digest"), F.col(column).alias("body")).filter("body is not null").dropDuplicates(["digest"])
    return b.join(stored.select("digest"), "digest", "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """Append log lines as JSON; Spark's commit makes each append whole or absent, so no torn line can arise."""
    rows.write.mode("append").json(path)


def export(rows: DataFrame, path: str) -> None:
    """A dated export that never overwrites."""
    rows.write.mode("errorifexists").json(path)


def missing_blobs(snapshots: DataFrame, blobs: DataFrame) -> DataFrame:
    """snapshot_id whose blob isn't stored."""
    return snapshots.join(blobs.select("digest"), "digest", "left_anti").select("snapshot_id")


def content_id(prefix: str, *parts: Column) -> Column:
    """An id bound to content: prefix and 16 hex digits of the digest of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))
