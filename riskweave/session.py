"""Session factory and the few settings the operators read from a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "riskweave", cores: int | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator is tested under (UTC, ANSI, AQE, Arrow).

    Master, memory and shuffle partitions are set for a run on this machine only; under spark-submit
    those of the submission hold.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        cores = cores or os.cpu_count() or 4
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on a single machine that names none (tests).

    On a cluster without one this is an error: executors would write to their own disks.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="riskweave-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_WRITTEN: dict[str, SparkSession] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: later steps start from its files.

    A lost executor then costs no earlier step, joins know the table's size, and a reader of few
    columns reads only those. The files are removed by `release`, else when the process ends.
    """
    spark = df.sparkSession
    folder = f"{shared_checkpoint_dir(spark)}/riskweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN[folder] = spark
    stored = spark.read.schema(df.schema).parquet(folder)
    stored._riskweave_folder = folder
    return stored


def release(*stored: DataFrame | None) -> None:
    """Removes the files of tables stored by `cut_lineage` that nothing will read again (rounds of an iteration)."""
    for df in stored:
        folder = getattr(df, "__dict__", {}).get("_riskweave_folder")
        if folder in _WRITTEN:
            _remove(_WRITTEN.pop(folder), folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_written() -> None:
    while _WRITTEN:
        folder, spark = _WRITTEN.popitem()
        try:
            _remove(spark, folder)
        except Exception:  # noqa: BLE001 - the JVM may be gone; the folder is the cluster's to clean
            continue


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet scan of one named table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """The stored rows with a broadcast hint if they are no more than most_rows, else without one.

    df must be cheap to count (stored by `cut_lineage`); beyond the bound the join is left to the
    optimizer, which shuffles both sides and splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def python_tasks(spark: SparkSession) -> int:
    """Number of partitions for a Python-heavy stage: a few for each core, whatever the rows weigh."""
    return 4 * spark.sparkContext.defaultParallelism
