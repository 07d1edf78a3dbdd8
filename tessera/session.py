"""Session helpers: builder, table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read; the session names it on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that outlives an executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _remove(context, path: str) -> None:
    """Take a table away when the driver ends; a session that is gone already leaves it to the folder's owner."""
    try:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001
        pass


_STORED: list[str] = []


def release(spark: SparkSession) -> None:
    """Take away the tables that ``stored`` has written so far; for a long session, between queries whose results are written."""
    while _STORED:
        _remove(spark.sparkContext, _STORED.pop())


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, taken away by ``release`` or when the driver ends."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(release, spark)
    _STORED.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder: like ``cut``, for wide rows that are read more than once."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files make fewer splits than there are cores, dealt out to all of them.

    For plain scans before work in Python; larger inputs have more splits and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
