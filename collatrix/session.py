"""Sessions, table loading and staging of intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own (tests, bench). A session handed in by a driver is used as it is.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine with the settings the engine expects."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("collatrix").config("spark.driver.memory", memory)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a plain Parquet scan, so filters and column choice reach the files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_cluster(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return not (master.startswith("local[") or master == "local")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a purely local session may get its own one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if _on_cluster(spark):
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="collatrix-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage of iterative jobs. The table survives the loss of any executor, and unlike a cached or
    checkpointed plan it has true sizes, so that Spark may choose a broadcast by them. The file is removed when the
    Python process ends, or earlier by ``drop_stages``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what was shuffled for this table isn't needed once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


_STAGED: list[tuple[SparkSession, str]] = []
#: Removes the shuffle files of a query as it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stages() -> None:
    """Delete every staged table; call it when no result that reads one is still to be run."""
    while _STAGED:
        try:
            _delete(*_STAGED.pop())
        except Exception:  # the session may be gone; the folder is then cleaned by its owner
            pass


def release(*tables: DataFrame) -> None:
    """Delete staged tables (as ``stage`` returned them) that nothing still to be run reads; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        entry = next((x for x in _STAGED if x[1] == path), None)
        if entry is not None:
            _STAGED.remove(entry)
            _delete(*entry)


atexit.register(drop_stages)
